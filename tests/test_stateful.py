import random

import pandas as pd
from pyspark.sql import Row
from test_signals import frame, random_rows
from test_streaming import payload

from loomtrace.operators import ingest, signals
from loomtrace.schemas import RAW_PAYLOAD
from loomtrace.session import durable
from loomtrace.streaming import stateful


def test_state_in_batches_equals_the_batch_operator(spark):
    rows = [(f"t{s}", *r[1:]) for s in range(5) for r in random_rows(s)]
    df = frame(spark, rows)
    stream, root = stateful.replayed(spark, df, "seq", ["trajectory_id"], batches=5)
    sink = stateful.LatestSink(root, "trajectory_id")
    out = stateful.trajectory_state(stream)
    stateful.run_all(out, sink, root)
    assert spark.read.parquet(f"{root}/rows").select("batch").distinct().count() >= 3
    rows_of = lambda d: {r["trajectory_id"]: r.asDict() for r in d.collect()}
    assert rows_of(sink.read(spark)) == rows_of(signals.state(df).select(out.columns))


def test_a_stream_goes_on_from_its_checkpoint(spark):
    """Rows that arrive after a stop continue from the stored values; nothing is read again."""
    df = frame(spark, random_rows(7))
    root = stateful.new_folder(spark)
    session = stateful.stateful_session(spark)
    sink = stateful.LatestSink(root, "trajectory_id")
    for low, high in ((0, 20), (20, 41), (41, 99)):
        df.filter(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(f"{root}/source")
        stateful.run_all(stateful.trajectory_state(session.readStream.schema(df.schema).parquet(f"{root}/source")), sink, root)
    out = sink.read(spark)
    assert [r.asDict() for r in out.collect()] == [r.asDict() for r in signals.state(df).select(out.columns).collect()]


def plain(deliveries):
    """First delivery of an id wins; per digest its first delivery and their number."""
    accepted, seen = {}, {}
    for org, eid, text, seq in sorted(deliveries, key=lambda d: d[3]):
        accepted.setdefault((org, eid), text)
        first, n = seen.get((org, eid, text), (seq, 0))
        seen[org, eid, text] = (first, n + 1)
    return {(o, e, t, first, n, "accepted" if accepted[o, e] == t else "conflict") for (o, e, t), (first, n) in seen.items()}


def test_ingest_is_exactly_once_across_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), str(rng.randrange(12)), rng.choice(["x", "y", "z"]), seq) for seq in range(150)]
    rows += [("a", "hot", "x", 150 + seq) for seq in range(300)]
    good, bad = ingest.normalize(spark.createDataFrame([payload(o, e, seq, t, "2024-02-01T00:00:00") for o, e, t, seq in rows], RAW_PAYLOAD))
    assert bad.count() == 0
    stream, root = stateful.replayed(spark, good, "ingest_seq", ["organization_id", "event_id"], batches=4)
    sink = stateful.LateSink(root)
    stateful.run_all(stateful.idempotent(stream), sink, root)
    names = ["organization_id", "event_id", "text", "first_seq", "deliveries", "status"]
    hashed = good.withColumn("payload_hash", ingest.payload_hash()).select("organization_id", "event_id", "payload_hash", "text").distinct()
    got = {tuple(r) for r in sink.deliveries(spark).join(hashed, ["organization_id", "event_id", "payload_hash"]).select(names).collect()}
    assert got == plain(rows)
    assert sink.accepted(spark).count() == len({(o, e) for o, e, *_ in rows})
    batch = durable(spark.read.parquet(f"{root}/deliveries").filter("batch = 1").drop("batch"))
    before = sorted(map(str, sink.accepted(spark).collect()))
    sink(batch, 1)  # a retried batch leaves one result
    assert sorted(map(str, sink.accepted(spark).collect())) == before


def test_late_across_batches(spark):
    rows = [payload("a", str(i), i, "m", f"2024-01-{day:02d}T00:00:00") for i, day in enumerate([5, 3, 9, 9, 8, 10, 1])] + [payload("b", "x", 9, "m", "2024-01-01T00:00:00")]
    good, _ = ingest.normalize(spark.createDataFrame(rows, RAW_PAYLOAD))
    stream, root = stateful.replayed(spark, good, "ingest_seq", ["organization_id", "event_id"], batches=3)
    sink = stateful.LateSink(root)
    stateful.run_all(stateful.idempotent(stream), sink, root)
    assert {r.event_id: r.late_event for r in sink.accepted(spark).collect()} == {
        "0": False, "1": True, "2": False, "3": False, "4": True, "5": False, "6": True, "x": False}


def test_old_state_is_dropped(spark):
    """With a time to live the store keeps only what was updated lately; a counter starts anew afterwards."""
    df = frame(spark, random_rows(2))
    stream, root = stateful.replayed(spark, df, "seq", ["trajectory_id"], batches=3)
    sink = stateful.LatestSink(root, "trajectory_id")
    stateful.run_all(stateful.trajectory_state(stream, ttl_ms=1), sink, root)
    assert sink.read(spark).first()["event_count"] < df.count()


class Store:
    """Stands for a state store and counts what is asked of it."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    getValueState = getMapState = lambda self, name, *schemas: self

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("update", "updateValue"):
                self.kept[args[0] if len(args) > 1 else None] = args[-1]
            key = args[0] if args else None
            return key in self.kept if name in ("exists", "containsKey") else self.kept.get(key)
        return call


def test_an_id_with_copies_asks_the_store_twice_a_batch():
    store, names = Store(), ["event_id", "ingest_seq", "payload_hash"]
    processor = stateful.Deliveries(names)
    processor.init(store)
    for batch, deliveries in enumerate((7, 14)):
        rows = [Row(*names)("e", 10 * batch + k, "d") for k in (3, 1, 2, 4, 5, 6, 0)]
        out = [r.asDict() for r in processor.handleInputRows(("o", "e"), iter(rows), None)]
        assert out == [{"event_id": "e", "ingest_seq": 10 * batch, "payload_hash": "d", "first_seq": 0, "deliveries": deliveries, "status": "accepted", "is_new": not batch}]
    assert store.calls == 4


def test_an_agent_is_looked_up_once_a_batch():
    columns = ["ts", "seq", "conversation_id", "actor_type", "actor_id", "tool_name", "status", "fp", "behaves", "primitive", "confidence"]
    store, processor = Store(), stateful.TrajectoryCounters()
    processor.init(store)
    rows = pd.DataFrame([(k, k, "c", "agent", f"a{k % 2}", None, None, None, False, None, 0.0) for k in range(50)], columns=columns)
    out = next(iter(processor.handleInputRows(("t",), iter([rows]), None)))
    assert out["agent_count"][0] == 2 and out["agent_handoffs"][0] == 49 and store.calls <= 3 + 2 * 3
