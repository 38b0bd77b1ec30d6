import datetime as dt

from pulsegrid.operators.sequence import merge_intervals
from pulsegrid.streaming import markers


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_trains_on_a_stream_equal_the_batch(spark, tmp_path):
    base = dt.datetime(2026, 1, 1)
    rows = [("c1", base + dt.timedelta(seconds=s)) for s in (0, 2, 3, 30, 31, 100, 400)] + [("c2", base + dt.timedelta(seconds=s)) for s in (5, 300, 500)]
    df = spark.createDataFrame(rows, "channel string, ts timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, drain(markers.trains(stream, "channel", "ts", "10 seconds", "1 second"), "trains").collect()))
    want = sorted(map(tuple, markers.trains(df, "channel", "ts", "10 seconds", "1 second").collect()))
    assert got == [w for w in want if w[2] < base + dt.timedelta(seconds=489)]  # later ones wait for the watermark
    t = df.selectExpr("channel", "unix_micros(ts) AS s", "unix_micros(ts) AS e")
    merged = merge_intervals(t, ["channel"], "s", "e", 9_999_999)
    assert merged.count() == len(want)


def test_open_pulses_survive_micro_batches(spark, tmp_path):
    samples = [("a", k, 5.0 if 10 <= k < 25 or 40 <= k < 42 else 0.0) for k in range(60)] + [("b", k, -3.0 * (k == 7)) for k in range(60)]
    for part in range(4):
        own = [x for x in samples if x[1] // 15 == part]
        spark.createDataFrame(own, "channel string, sample long, ua double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel string, sample long, ua double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, drain(markers.pulses(stream, 1), "pulses").collect()))
    assert got == [("a", 10, 25, 5.0), ("a", 40, 42, 5.0), ("b", 7, 8, 3.0)]


def test_idle_channels_give_out_their_open_pulse(spark, tmp_path):
    import time

    rows = [("a", k, 5.0 if k >= 12 else 0.0) for k in range(15)]
    spark.createDataFrame(rows, "channel string, sample long, ua double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel string, sample long, ua double").parquet(str(tmp_path / "in"))
    q = markers.pulses(stream, 1, idle_ms=500).writeStream.format("memory").queryName("idle").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("idle").count():
                break
        assert [tuple(r) for r in spark.table("idle").collect()] == [("a", 12, 15, 5.0)]
    finally:
        q.stop()
