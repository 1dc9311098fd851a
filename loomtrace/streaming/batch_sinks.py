"""Streaming sinks built on the batch operators (``foreachBatch``).

Every write goes to the folder of its batch id and replaces it, so a batch that is retried leaves one result. Reads of
earlier results only take folders of earlier batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtrace.operators import ingest, signals
from loomtrace.session import durable, release


def _write(rows: DataFrame, root: str, table: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch_id}")


def _earlier(spark, root: str, table: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of the earlier batches of a table, empty before the first write."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, batch INT").parquet(f"{root}/{table}").filter(F.col("batch") < batch_id).drop("batch")


class SignalSink:
    """Incremental counters: each batch leaves one summary row per trajectory it touches; reading merges them in order.

    ``state`` of all summaries equals the batch operator over the same events in arrival order.
    """

    def __init__(self, root: str):
        self.root = root

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        _write(signals.chunk_summaries(batch, F.lit(batch_id)), self.root, "summaries", batch_id)
        pairs = batch.select("trajectory_id", "conversation_id", "actor_type", "actor_id").distinct()
        _write(pairs, self.root, "members", batch_id)

    def state(self, spark) -> DataFrame:
        merged = signals.merge_summaries(spark.read.parquet(f"{self.root}/summaries"))
        counts = signals.distinct_counts(spark.read.parquet(f"{self.root}/members"))
        return merged.join(counts, signals.TID, "left")


class IngestSink:
    """Exactly-once ingestion: the first payload of an event id is accepted, repeats are dropped, others are conflicts.

    Late events are flagged against the latest time seen per organisation, in the batch or before it.
    """

    IDS = "organization_id STRING, event_id STRING, payload_hash STRING"
    LATEST = "organization_id STRING, latest TIMESTAMP"

    def __init__(self, root: str):
        self.root = root

    def __call__(self, payloads: DataFrame, batch_id: int) -> None:
        spark = payloads.sparkSession
        good, bad = ingest.normalize(payloads)
        hashed = durable(good.withColumn("payload_hash", ingest.payload_hash()))  # read by every output below
        known = _earlier(spark, self.root, "ids", batch_id, self.IDS).withColumnRenamed("payload_hash", "known_hash")
        first = ingest.accepted_events(hashed)
        keys = ["organization_id", "event_id"]
        new = first.join(known, keys, "left_anti")
        holder = first.select(*keys, "payload_hash").join(known, keys, "left").select(
            *keys, F.coalesce("known_hash", "payload_hash").alias("holder_hash"))
        conflicts = hashed.join(holder, keys).filter("payload_hash <> holder_hash")
        seen = _earlier(spark, self.root, "latest", batch_id, self.LATEST).groupBy("organization_id").agg(
            F.max("latest").alias("before"))
        flagged = ingest.late_flags(new).join(seen, "organization_id", "left").withColumn("late_event", F.col("late_event") | F.coalesce(
            F.try_to_timestamp("occurred_at") < F.col("before"), F.lit(False)))
        _write(flagged.drop("before", "history_disordered", "recompute_recommended"), self.root, "accepted", batch_id)
        _write(conflicts, self.root, "conflicts", batch_id)
        _write(bad, self.root, "rejected", batch_id)
        _write(new.select(*keys, "payload_hash"), self.root, "ids", batch_id)
        _write(new.filter("occurred_at is not null").groupBy("organization_id").agg(
            F.max(F.try_to_timestamp("occurred_at")).alias("latest")), self.root, "latest", batch_id)

        release(hashed)

    def read(self, spark, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.root}/{table}")
