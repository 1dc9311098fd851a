import random
from datetime import datetime
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Row, functions as F

from loomtrace.streaming import pages, stateful


class Store:
    """A map state that counts what is asked of it."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def getMapState(self, *_):
        return self

    def getValue(self, key):
        self.calls += 1
        return self.kept.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.kept[key] = value


def at(ms):
    return SimpleNamespace(getCurrentProcessingTimeInMs=lambda: ms)


def test_pages_hold_what_was_put(monkeypatch):
    monkeypatch.setattr(pages, "HELD", 5)  # pages are written and read again within a batch
    rng, store, plain = random.Random(1), Store(), {}
    held = pages.Pages(store, None)
    value, entries = held.getValueState("v", "n int"), held.getMapState("m", "k string", "n int")
    for batch in range(12):
        held.open(None)
        for n in range(700):
            held.key = (rng.choice("ab"), str(rng.randrange(3000)))
            user = rng.choice([None, ("x",), ("y",)])
            state = value if user is None else entries
            assert (state.get() if user is None else state.getValue(user)) == plain.get((held.key, user))
            plain[held.key, user] = (batch, n)
            state.update((batch, n)) if user is None else state.updateValue(user, (batch, n))
        held.close()
    assert held.n > 10 and len(store.kept) == held.n + 1


def test_a_batch_reads_the_pages_of_its_keys_only():
    store = Store()
    held = pages.Pages(store, None)
    value = held.getValueState("v", "n int")
    for k in range(40_000):
        if k % 5000 == 0:
            held.open(None)
        held.key = (k,)
        value.update((k,))
        if k % 5000 == 4999:
            held.close()
    before = store.calls
    held.open(None)
    held.key = (17,)
    assert value.get() == (17,)
    value.update((18,))
    held.close()
    assert store.calls - before <= 8


def test_an_entry_is_dropped_after_its_own_time():
    held = pages.Pages(Store(), 100)
    value = held.getValueState("v", "n int", 100)
    for ms, keys in ((0, "ab"), (60, "b"), (120, "c")):
        held.open(at(ms))
        for held.key in keys:
            value.update((ms,))
        held.close()
    held.open(at(130))
    found = {}
    for held.key in "abc":
        found[held.key] = value.get()
    assert found == {"a": None, "b": (60,), "c": (120,)}


def test_many_ids_and_trajectories_ask_the_store_a_few_times():
    names = ["organization_id", "event_id", "ingest_seq", "payload_hash"]
    store, processor = Store(), stateful.CellsOfDeliveries(names)
    processor.init(store)
    for batch, new in ((0, True), (1, False)):
        rows = pd.DataFrame([("o", f"e{i}", str(10_000 * batch + 3 * i + k), "d") for i in range(400) for k in range(2)], columns=names)
        out = pd.concat(processor.handleInputRows((7,), iter([rows[:500], rows[500:]]), None))
        assert len(out) == 400 and set(out["is_new"]) == {new} and set(out["deliveries"]) == {2 + 2 * batch}
        assert sorted(out["first_seq"]) == [3 * i for i in range(400)]
    assert store.calls < 20

    columns = ["trajectory_id", "ts", "seq", "conversation_id", "actor_type", "actor_id", "tool_name", "status", "fp", "behaves", "primitive", "confidence"]
    store, processor = Store(), stateful.CellsOfTrajectories()
    processor.init(store)
    for batch in range(2):
        rows = [(f"t{t}" if t else None, batch, k, f"c{batch}{k}", "agent", f"a{k}", None, None, None, False, None, 0.0) for k in range(3) for t in range(50)]
        out = pd.concat(processor.handleInputRows((7,), iter([pd.DataFrame(rows, columns=columns)]), None))
        assert len(out) == 50 and out["trajectory_id"].isna().sum() == 1
        assert set(out["conversation_count"]) == {3 + 3 * batch} and set(out["agent_count"]) == {3} and set(out["agent_handoffs"]) == {2 + 3 * batch}
    assert store.calls < 30


def test_columns_of_all_kinds_pass_the_ingest_as_they_are(spark):
    texts = ["organization_id", "event_id", "workspace_id", "surface", "external_user_id", "conversation_id", "type", "occurred_at", "source_sequence", "text", "goal", "metadata_json"]
    schema = ", ".join(f"{c} string" for c in texts) + ", entities array<string>, artifacts array<string>, ingest_seq bigint, _at timestamp, n bigint, class boolean"
    row = lambda i, **more: Row(**(dict.fromkeys(texts, None) | {"organization_id": "o", "event_id": str(i), "metadata_json": "{}", "text": 'a "b"\né'} | more))
    rows = [row(i, entities=["x", None, ""] if i else None, artifacts=[], ingest_seq=2**60 + i, _at=datetime(2024, 1, 2, 3, 4, 5, 678901) if i % 2 else None,
                n=2**62 + i if i % 3 else None, **{"class": [True, False, None][i % 3]}) for i in range(9)]
    df = spark.createDataFrame(rows, schema)
    stream, root = stateful.replayed(spark, df, "ingest_seq", ["event_id"], batches=2)
    sink = stateful.LatestSink(root, "event_id")
    stateful.run_all(stateful.idempotent(stream), sink, root)
    got = sink.read(spark)
    assert got.filter("is_new AND deliveries = 1 AND status = 'accepted' AND first_seq = ingest_seq").count() == 9
    assert {f.name: f.dataType for f in got.schema if f.name in df.columns} == {f.name: f.dataType for f in df.schema}
    order = lambda d: [tuple(r) for r in d.select(*(F.col(c) for c in df.columns)).orderBy("event_id").collect()]
    assert order(got) == order(df)
