from pyspark.sql import functions as F
from test_signals import frame, random_rows

from loomtrace.operators import signals
from loomtrace.schemas import RAW_PAYLOAD
from loomtrace.streaming.batch_sinks import IngestSink, SignalSink


def test_signal_sink_equals_batch(spark, tmp_path):
    rows = [(f"t{s}", *r[1:]) for s in range(4) for r in random_rows(s)]
    df = frame(spark, rows)
    sink = SignalSink(str(tmp_path))
    cuts = [0, 11, 12, 40, 99]
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = df.filter((F.col("seq") >= lo) & (F.col("seq") < hi))
        sink(part, i)
        sink(part, i)  # a retried batch leaves one result
    key = lambda d: {r["trajectory_id"]: r.asDict() for r in d.collect()}
    assert key(sink.state(spark)) == key(signals.state(df))


def test_signal_sink_as_stream(spark, tmp_path):
    df = frame(spark, random_rows(3))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    sink = SignalSink(str(tmp_path / "out"))
    q = (spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(sink)
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sink.state(spark).collect()[0]["event_count"] == 60


def payload(org, eid, seq, message, at="2024-01-01T10:00:00"):
    return (org, eid, None, None, "u", "c", None, at, None, None, None, message, None, None, None, None, None, seq)


def test_late_across_batches_and_zones(spark, tmp_path):
    """10:00+05:00 is 05:00Z: the latest time so far is 06:00Z, so 05:30Z of the next batch is late."""
    sink = IngestSink(str(tmp_path))
    frame_ = lambda rows: spark.createDataFrame(rows, RAW_PAYLOAD)
    sink(frame_([payload("a", "1", 1, "x", "2024-01-01T10:00:00+05:00"), payload("a", "2", 2, "y", "2024-01-01T06:00:00Z")]), 0)
    sink(frame_([payload("a", "3", 3, "z", "2024-01-01T05:30:00Z")]), 1)
    assert {r["event_id"]: r["late_event"] for r in sink.read(spark, "accepted").collect()}["3"] is True


def test_ingest_sink(spark, tmp_path):
    sink = IngestSink(str(tmp_path))
    frame_ = lambda rows: spark.createDataFrame(rows, RAW_PAYLOAD)
    sink(frame_([payload("a", "1", 1, "x"), payload("a", "1", 2, "x"), payload("b", "1", 3, "y"), payload("a", "2", 4, "z", "2024-01-01T09:00:00")]), 0)
    second = frame_([payload("a", "1", 5, "x"), payload("a", "1", 6, "other"), payload("a", "3", 7, "late", "2024-01-01T08:00:00")])
    sink(second, 1)
    sink(second, 1)
    accepted = {(r["organization_id"], r["event_id"]): r["late_event"] for r in sink.read(spark, "accepted").collect()}
    assert accepted == {("a", "1"): False, ("b", "1"): False, ("a", "2"): True, ("a", "3"): True}
    assert [(r["event_id"], r["text"]) for r in sink.read(spark, "conflicts").collect()] == [("1", "other")]
