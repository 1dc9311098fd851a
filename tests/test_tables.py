import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import audit, corpus, evaluate, identity, ingest, workstate
from loomtrace.schemas import WORK_STATE
from loomtrace.sources import tables


def test_jsonl_and_array(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a INT").collect()) == [1, 2]
    body = json.dumps([{"a": 1}, {"a": 3}])
    (tmp_path / "b.json").write_text(body)
    assert sorted(r["a"] for r in tables.read_json_array(spark, str(tmp_path / "b.json"), "a INT").collect()) == [1, 3]
    expected = spark.createDataFrame([("b.json", hashlib.sha256(body.encode()).hexdigest())], "file STRING, sha256 STRING")
    assert tables.verify_digests(spark, str(tmp_path / "b.json"), expected).collect()[0]["match"]


def test_append_snapshot_and_audit(spark, tmp_path):
    rows = spark.createDataFrame([("o1", "e1", 2), ("o2", "e1", 1), ("o1", "e0", 1)], "organization_id STRING, event_id STRING, created_at INT")
    tables.append_audit(rows, str(tmp_path), "decisions")
    tables.append_audit(rows.limit(0), str(tmp_path), "decisions")
    assert [r["event_id"] for r in tables.read_audit(spark, str(tmp_path), "decisions", "o1").collect()] == ["e0", "e1"]
    with pytest.raises(ValueError):
        tables.append_audit(rows, str(tmp_path), "nope")
    anchor = [("ticket", "OPS-1", "strong")]
    state = spark.createDataFrame([("o", "w", "p", "t", "g", "s", "active", [], [], anchor, *[[] for _ in range(9)], 3)], WORK_STATE)
    tables.save_snapshot(state, str(tmp_path / "snap"), 1)
    back = tables.load_snapshot(spark, str(tmp_path / "snap"), 1)
    assert back.collect()[0]["anchors"][0]["value"] == "OPS-1" and workstate.set_difference(state, back).isEmpty()
    tables.append_jsonl(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).select("record_id").distinct().count() == 3
    tables.append_events(rows, str(tmp_path / "ev"), ["organization_id"])
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 3
    f = spark.createDataFrame([([1.0, 2.0], "x")], "feature ARRAY<FLOAT>, label STRING")
    tables.save_features(f, str(tmp_path / "feat"))
    assert spark.read.parquet(str(tmp_path / "feat")).collect()[0]["feature"] == [1.0, 2.0]


def test_idempotency_with_a_hot_id(spark):
    hot = [("o", "hot", "h1", i) for i in range(500)] + [("o", "hot", "h2", 1000), ("p", "hot", "h2", 1001)]
    df = spark.createDataFrame(hot, "organization_id STRING, event_id STRING, payload_hash STRING, ingest_seq BIGINT").repartition(6)
    got = {(r["organization_id"], r["payload_hash"]): (r["status"], r["deliveries"]) for r in ingest.idempotency(df).collect()}
    assert got == {("o", "h1"): ("accepted", 500), ("o", "h2"): ("conflict", 1), ("p", "h2"): ("accepted", 1)}
    twice = df.unionByName(df)
    assert ingest.accepted_events(twice).count() == ingest.accepted_events(df).count() == 2


def test_late_flags_parse_offsets(spark):
    rows = [("o", 1, "2024-01-01T10:00:00Z"), ("o", 2, "2024-01-01T10:30:00+01:00"), ("o", 3, None), ("o", 4, "2024-01-01T10:00:01Z")]
    df = spark.createDataFrame(rows, "organization_id STRING, ingest_seq BIGINT, occurred_at STRING")
    for size in (1, 2, 100):
        got = [r["late_event"] for r in ingest.late_flags(df, F.floor(F.col("ingest_seq") / size)).orderBy("ingest_seq").collect()]
        assert got == [False, True, False, False]


def test_identity(spark):
    ids = spark.createDataFrame([("o", "w", "slack", "u1", "p1")], "organization_id STRING, workspace_id STRING, surface STRING, external_user_id STRING, person_id STRING")
    ev = spark.createDataFrame([("o", "w", "slack", "u1", 1), ("o", "w", "chat", "u1", 2)], "organization_id STRING, workspace_id STRING, surface STRING, external_user_id STRING, n INT")
    got = [r["person_id"] for r in identity.resolve(ev, ids).orderBy("n").collect()]
    assert got[0] == "p1" and got[1].startswith("person_") and len(got[1]) == 23
    asks = spark.createDataFrame([("o", "w", "slack", "u1", "p2", 1), ("o", "w", "x", "u1", "p2", 2), ("o", "w", "x", "u1", "p3", 3)],
                                 "organization_id STRING, workspace_id STRING, surface STRING, external_user_id STRING, person_id STRING, at INT")
    out = sorted((r["surface"], r["person_id"], r["outcome"]) for r in identity.link(ids, asks, "at").collect())
    assert out == [("slack", "p2", "conflict"), ("x", "p2", "linked"), ("x", "p3", "conflict")]


def test_surface_policy_empty_list_allows_all(spark):
    ev = spark.createDataFrame([("a", "slack"), ("b", "slack"), ("c", "slack")], "organization_id STRING, surface STRING")
    conf = spark.createDataFrame([("a", []), ("b", ["chat"])], "organization_id STRING, allowed_surfaces ARRAY<STRING>")
    assert {r["organization_id"]: r["allowed"] for r in ingest.allowed_surfaces(ev, conf).collect()} == {"a": True, "b": False, "c": True}


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_order_statistics(spark, n):
    values = [((i * 37) % 11) / 11 for i in range(n)]
    r = evaluate.order_statistics(spark.createDataFrame([(v,) for v in values], "m DOUBLE"), "m", 0.0, 1.0, cells=4).collect()[0]
    assert r["median_margin"] == round(sorted(values)[n // 2], 6) and r["max_margin"] == round(max(values), 6)


def test_derangement(spark):
    out = corpus.derangement(spark.range(200).withColumnRenamed("id", "k"), "k", F.col("k"), "other").collect()
    assert all(r["k"] != r["other"] for r in out) and sorted(r["other"] for r in out) == list(range(200))


def test_pair_counts_equal_brute_force(spark):
    rows = [(i % 3, i % 4) for i in range(30)]
    r = evaluate.pair_counts(spark.createDataFrame(rows, "g INT, p INT"), "g", "p").collect()[0]
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1:]]
    assert r["true_pairs"] == sum(a == b for a, b in pairs)
    assert r["false_merge_pairs"] == sum(a[1] == b[1] and a[0] != b[0] for a, b in pairs)
    assert r["false_split_pairs"] == sum(a[0] == b[0] and a[1] != b[1] for a, b in pairs)
    empty = evaluate.pair_counts(spark.createDataFrame([], "g INT, p INT"), "g", "p").collect()[0]
    assert (empty["pair_precision"], empty["pair_recall"]) == (1.0, 0.0)


def test_audit(spark):
    rows = spark.createDataFrame([(str(i), "p", "g", "s") for i in range(30)], "event_id STRING, pred STRING, gold STRING, source STRING")
    sample = audit.audit_sample(rows, 5)
    assert [(r["audit_id"], r["event_id"]) for r in sample.orderBy("audit_id").collect()][:3] == [("audit_001", "0"), ("audit_002", "1"), ("audit_003", "10")]
    assert audit.sample_digest(sample).collect() == audit.sample_digest(audit.audit_sample(rows.repartition(3), 5)).collect()
    assert audit.score_audit(sample).collect()[0]["status"] == "INCOMPLETE"
    done = sample.withColumns({"human_correct": F.lit(True), "human_false_merge": F.lit(False)})
    assert audit.score_audit(done).collect()[0]["milestone_pass"]


def test_modal_first_seen_wins(spark):
    rows = [(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4), (2, "x", 1)]
    got = {r["k"]: (r["modal"], r["stable"]) for r in evaluate.modal(spark.createDataFrame(rows, "k INT, v STRING, run INT"), ["k"], "v", "run").collect()}
    assert got == {1: ("b", False), 2: ("x", True)}
