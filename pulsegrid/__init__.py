"""Event-locked signal analytics on Spark: sequence, pairing, gating, summary, regression and waveform operators."""
