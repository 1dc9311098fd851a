import pytest
from pyspark.sql import functions as F

from loomtrace.operators import corpus, ingest


def test_payloads_with_one_sequence_number(spark):
    rows = [("o", "e", h, 1) for h in ("b", "a", "a")] + [("o", "f", "z", 2), ("o", "f", "y", 3)]
    df = spark.createDataFrame(rows, "organization_id string, event_id string, payload_hash string, ingest_seq bigint")
    got = {(r.event_id, r.payload_hash): (r.status, r.deliveries) for r in ingest.idempotency(df.repartition(3)).collect()}
    assert got == {("e", "a"): ("accepted", 2), ("e", "b"): ("conflict", 1), ("f", "z"): ("accepted", 1), ("f", "y"): ("conflict", 1)}
    one = {r.event_id: r.payload_hash for r in ingest.accepted_events(df).collect()}
    assert one == {r.event_id: r.payload_hash for r in ingest.accepted_events(df.repartition(5, F.rand(1))).collect()} and one["f"] == "z"


def test_a_changed_taxonomy_is_refused(spark):
    table = corpus.taxonomy_table(spark, "1", {"a": "L1", "b": "L2"})
    assert corpus.verified_taxonomy(table).count() == 2
    with pytest.raises(ValueError):
        corpus.verified_taxonomy(table.withColumn("maturity", F.lit("L1")))
