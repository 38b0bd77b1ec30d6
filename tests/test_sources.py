import numpy as np
import pytest

from pulsegrid.sources import acquisition as acq
from pulsegrid.sources import captures, sinks, text, writers


def stim_run(folder, n_blocks=6, t0s=(0, 768)):
    folder.mkdir(parents=True)
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 65536, (3, 128 * n_blocks)).astype(np.uint16)
    words = np.zeros_like(codes)
    words[2, 300:320] = 0x8100 | 50
    for k, t0 in enumerate(t0s):
        data = writers.stim_file(codes, words, ["A-024", "A-025", "A-026"], t0=t0, impedances=[1e5, 2.4e5, 2e6])
        (folder / f"part{k}.rhs").write_bytes(data)
    return codes, words


def test_stim_files_read_exactly(spark, tmp_path):
    codes, words = stim_run(tmp_path / "s" / "run1")
    spark.dataSource.register(acq.RecordingSource)
    spark.dataSource.register(acq.HeaderSource)
    load = spark.read.format("recording").option("path", str(tmp_path / "s")).option("blocksPerTask", 4)
    rows = load.load().orderBy("channel", "block_no").collect()
    assert len(rows) == 3 * 12 and {r.run_id for r in rows} == {"run1"}
    for c, name in enumerate(("A-024", "A-025", "A-026")):
        own = [r for r in rows if r.channel == name]
        got = np.concatenate([r.samples for r in own[:6]])
        want = (codes[c].astype(np.int32) - 32768).astype(np.float32) * np.float32(0.195)
        assert np.array_equal(np.array(got, np.float32), want)
        assert np.array_equal(np.concatenate([r.stim_words for r in own[6:]]), words[c])
        assert [r.t0 for r in own] == [128 * k for k in range(12)] and own[6].file_no == 1
    one = load.option("channels", "A-025").load()
    assert {r.channel for r in one.collect()} == {"A-025"}
    with pytest.raises(Exception, match="no channel Z-9"):
        load.option("channels", "Z-9").load().collect()
    heads = spark.read.format("recording_header").option("path", str(tmp_path / "s")).load().collect()
    assert len(heads) == 2 and heads[0].n_samples == 768 and heads[0].impedance_ohms["A-026"] == 2e6
    assert heads[0].format == "rhs" and heads[0].stim_step_ua == pytest.approx(1.0)


@pytest.mark.parametrize("version,per", [((1, 0), 60), ((3, 0), 128)])
def test_record_files_read_exactly(spark, tmp_path, version, per):
    folder = tmp_path / "r"
    folder.mkdir()
    n, rng = per * 5, np.random.default_rng(2)
    streams = {
        "amp": rng.integers(0, 65536, (2, n)), "aux": rng.integers(0, 65536, (1, n // 4)), "supply": rng.integers(0, 65536, (1, 5)),
        "adc": rng.integers(0, 65536, (1, n)), "din": rng.integers(0, 16, (1, n)),
    }
    names = {"amp": [("A-0", 0), ("A-1", 1)], "aux": [("AUX1", 0)], "supply": [("V1", 0)], "adc": [("ADC0", 0)], "din": [("D0", 0), ("D3", 3)]}
    (folder / "x.rhd").write_bytes(writers.record_file(streams, names, n, version=version, board_mode=1))
    spark.dataSource.register(acq.RecordingSource)

    def read(stream):
        rows = spark.read.format("recording").option("path", str(folder)).option("stream", stream).load().orderBy("channel", "block_no").collect()
        out = {}
        for r in rows:
            out.setdefault(r.channel, []).extend(r.samples)
        return out

    assert np.allclose(read("amplifier")["A-1"], (streams["amp"][1] - 32768) * 0.195, atol=1e-2)
    assert np.allclose(read("aux")["AUX1"], streams["aux"][0] * 37.4e-6, rtol=1e-5)
    assert np.allclose(read("supply")["V1"], streams["supply"][0] * 74.8e-6, rtol=1e-5)
    scale, zero = acq.ADC_V[1] if version >= (1, 3) else acq.ADC_V_ELSE
    assert np.allclose(read("adc")["ADC0"], (streams["adc"][0] - zero) * scale, atol=1e-4)
    din = read("din")
    assert np.array_equal(din["D0"], streams["din"][0] & 1) and np.array_equal(din["D3"], streams["din"][0] >> 3 & 1)


def test_broken_files_are_errors(tmp_path):
    with pytest.raises(ValueError, match="not a recording"):
        acq.parse_header(b"\0" * 64)
    data = writers.stim_file(np.zeros((1, 256), np.uint16), np.zeros((1, 256), np.uint16), ["A-1"])
    h = acq.parse_header(data)
    assert acq.n_blocks(h, len(data)) == 2
    with pytest.raises(ValueError, match="whole number"):
        acq.n_blocks(h, len(data) - 100)


def test_stim_file_hides_record_file(tmp_path):
    for name in ("a.rhs", "a.rhd"):
        (tmp_path / name).write_bytes(b"x")
    assert [f.rsplit(".")[-1] for f in acq.find_files(str(tmp_path))] == ["rhs"]


def test_text_sources(spark, tmp_path):
    run = tmp_path / "run7"
    run.mkdir()
    (run / "settings.xml").write_text(
        '<Settings><GeneralConfig StimStepSizeMicroAmps="0.5"/><Channel NativeChannelName="A-1" StimEnabled="False"/>'
        '<Channel NativeChannelName="A-2" StimEnabled="True" FirstPhaseAmplitudeMicroAmps="50" FirstPhaseDurationMicroseconds="200" NumberOfStimPulses="3"/></Settings>'
    )
    r = text.settings(spark, str(run / "settings.xml")).first()
    assert (r.run_id, r.stim_channel, r.amplitude_ua, r.phase_us, r.n_pulses, r.step_ua) == ("run7", "A-2", 50.0, 200.0, 3, 0.5)
    assert r.n_stim_channels == 1 and r.sample_rate_hz is None
    (run / "settings.xml").write_text(
        '<Settings SampleRateHertz="30000" StimStepSizeMicroAmps="2"><GeneralConfig StimStepSizeMicroAmps="5"/><SignalGroup><StimChannel NativeChannelName="A-3" StimEnabled="1" Polarity="NegativeFirst" '
        'EnableAmpSettle="True" PostStimAmpSettleMicroseconds="1000"/><StimChannel NativeChannelName="A-4" StimEnabled="True"/></SignalGroup></Settings>'
    )
    r = text.settings(spark, str(run / "settings.xml")).first()
    assert (r.stim_channel, r.n_stim_channels, r.step_ua, r.sample_rate_hz, r.polarity, r.amp_settle, r.post_settle_us, r.charge_recovery) == ("A-3", 2, 5.0, 30000.0, "NegativeFirst", True, 1000.0, None)
    (run / "spikes.txt").write_text("1.5\n 2 \nx\n\n3e-1\n")
    assert sorted(x.t for x in text.spike_times(spark, str(run / "spikes.txt")).collect()) == [0.3, 1.5, 2.0]
    (tmp_path / "z.csv").write_text("Channel Number,Impedance Magnitude at 1000 Hz (ohms),Impedance Phase at 1000 Hz (degrees)\nA-1,1e5,-60\n")
    assert text.impedances(spark, str(tmp_path / "z.csv")).first() == ("A-1", 1e5, -60.0)
    (tmp_path / "m.csv").write_text("run_id,block\nrun1,block2\n")
    assert text.manifest(spark, str(tmp_path / "m.csv")).first() == ("run1", "block2", True)
    (tmp_path / "cap.txt").write_text("epoch a b c\n10.0 1 2 3\n11.0 4 5 6\n12.0 7 8 9\nbad line\n")
    got = captures.scope_capture(spark, str(tmp_path / "cap.txt"), 10.5, 12.0).collect()
    assert [(g.epoch_s, g.lead) for g in got] == [(11.0, 6.0)]
    (tmp_path / "onset.txt").write_text("a=1\npulse_onset_epoch_s=123.5\npulse_onset_epoch_s=9\n")
    assert text.onset(spark, str(tmp_path / "onset.txt")).first().onset_s == 123.5


def test_sink_is_all_or_nothing(spark, tmp_path):
    good = spark.range(5)
    sinks.write_tables(spark, {"a": good, "b": good.withColumn("k", good.id % 2)}, str(tmp_path / "out"), by={"b": "k"})
    assert spark.read.parquet(str(tmp_path / "out" / "a")).count() == 5
    bad = good.selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception):
        sinks.write_tables(spark, {"a": spark.range(1), "b": bad}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "a")).count() == 5
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_stage")]


def test_sink_puts_old_tables_back(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    sinks.write_tables(spark, {"a": spark.range(5), "b": spark.range(5)}, out)
    (tmp_path / "out" / "c").write_text("of someone else")
    class Store:
        def __init__(self, store):
            self.store, self.n = store, 0

        def __getattr__(self, name):
            return getattr(self.store, name)

        def rename(self, a, b):
            self.n += 1
            return False if self.n == 4 else self.store.rename(a, b)

    stores = []
    plain = sinks.open_store
    monkeypatch.setattr(sinks, "open_store", lambda spark, path: stores.append(Store(plain(spark, path))) or stores[-1])
    with pytest.raises(OSError):
        sinks.write_tables(spark, {"a": spark.range(1), "b": spark.range(1)}, out)
    assert spark.read.parquet(out + "/a").count() == 5 and spark.read.parquet(out + "/b").count() == 5
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a", "b", "c"]


def test_tables_for_text_formats(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, float("inf"), None), (3, 1.5, "y")], "k long, v double, s string")
    assert [r.v for r in sinks.without_non_finite(df).orderBy("k").collect()] == [None, None, 1.5]
    runs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run string")
    done = spark.createDataFrame([("a", 3, None), ("b", 0, None), ("c", None, "broken")], "run string, n long, error string")
    assert {r.run: r.status for r in sinks.batch_summary(runs, done, "run", "n").collect()} == {"a": "ok", "b": "empty", "c": "error", "d": "empty"}


def test_disabled_groups_have_no_channels():
    codes = np.arange(512, dtype=np.uint16).reshape(2, 256)
    data = writers.stim_file(codes, np.zeros_like(codes), ["A-1", "A-2"], disabled=3)
    h = acq.parse_header(data)
    assert [c.name for c in h.channels] == ["A-1", "A-2"] and acq.n_blocks(h, len(data)) == 2


def test_runs_of_one_name_stay_apart(spark, tmp_path):
    from pulsegrid.operators.sequence import run_scan

    stim_run(tmp_path / "s" / "x" / "run1", t0s=(0, 1768))
    stim_run(tmp_path / "s" / "y" / "run1", t0s=(0, 768))
    spark.dataSource.register(acq.RecordingSource)
    df = spark.read.format("recording").option("path", str(tmp_path / "s")).load()
    got = {r.run_id: r for r in run_scan(df, 128).collect()}
    assert set(got) == {"x/run1", "y/run1"} and acq.run_name("/a/b/c.rhs", "/a/b") == "b" and acq.run_name("file:///a/b/r/c.rhs", "/a/b/") == "r"
    x, y = got["x/run1"], got["y/run1"]
    assert (x.n_files, x.n_samples, x.file_boundaries, x.n_gaps, x.n_gaps_at_joins) == (2, 1536, [0, 768], 1, 1)
    assert (y.n_gaps, y.file_boundaries) == (0, [0, 768])


def test_bands_and_windows_from_text(spark):
    from pyspark.sql import functions as F

    from pulsegrid.functions import parsing

    df = spark.createDataFrame([("theta 4-8; 8\u201313 Hz\n\nhigh gamma: 80 to 150hz;nothing;5-5",)], "t string")
    got = [tuple(b) for b in df.select(parsing.power_bands(F.col("t"))).first()[0]]
    assert got == [("theta", 4.0, 8.0), ("band2_8-13Hz", 8.0, 13.0), ("high_gamma", 80.0, 150.0)]
    texts = spark.createDataFrame([("-500 to -50",), ("20-300 ms",), ("-1.5 - 2",), ("300 to 20",), ("none",)], "t string")
    got = [r[0] and tuple(r[0]) for r in texts.select(parsing.window_ms(F.col("t"))).collect()]
    assert got == [(-500.0, -50.0), (20.0, 300.0), (-1.5, 2.0), None, None]


def test_old_tables_that_cannot_be_moved_back_stay_aside(spark, tmp_path, monkeypatch):
    target = tmp_path / "out"
    sinks.write_tables(spark, {"a": spark.range(3), "b": spark.range(4)}, str(target))
    real = sinks.open_store(spark, str(target))

    class Failing:
        """Moves of new table b fail, and then the one that brings a back."""

        def __getattr__(self, name):
            return getattr(real, name)

        def rename(self, a, b):
            back = "_aside" in a.toString() and a.getName() == "a"
            return False if back or ("_stage" in a.toString() and a.getName() == "b") else real.rename(a, b)

    monkeypatch.setattr(sinks, "open_store", lambda *_: Failing())
    with pytest.raises(OSError, match="old tables are left"):
        sinks.write_tables(spark, {"a": spark.range(5), "b": spark.range(6)}, str(target))
    (aside,) = [p for p in target.iterdir() if p.name.startswith("_aside")]
    assert spark.read.parquet(str(aside / "a")).count() == 3 and spark.read.parquet(str(target / "b")).count() == 4
    assert not [p for p in target.iterdir() if p.name.startswith("_stage")]
