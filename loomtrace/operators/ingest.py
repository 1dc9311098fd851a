"""Ingestion: normalization, validation, idempotency, lateness and import order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.functions.canonical import struct_digest
from loomtrace.operators import ordered

EVENT_TYPES = [  # Fixed values: accepted event types.
    "human_message", "agent_message", "tool_call", "tool_result", "product_event", "business_event", "feedback",
    "outcome",
]
IMPORT_ORDER = ["occurred_key", "sequence_kind", "sequence_number", "sequence_text", "event_id"]


def late_flags(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Flag events that occurred before an event of the organisation ingested earlier. History is not rewritten."""
    cut = chunk if chunk is not None else F.floor(F.col("ingest_seq") / 50_000)
    occurred = F.try_to_timestamp("occurred_at")
    seen = ordered.running_max_before(events, ["organization_id"], ["ingest_seq"], cut, occurred, "_latest")
    late = F.coalesce(occurred < F.col("_latest"), F.lit(False))
    return seen.withColumns({"late_event": late, "history_disordered": late, "recompute_recommended": late}).drop("_latest")


def import_key(events: DataFrame) -> DataFrame:
    """Columns whose order is the import order: time, numeric before textual sequence, event id."""
    number = F.col("source_sequence").try_cast("bigint")
    return events.withColumns({
        "occurred_key": F.coalesce("occurred_at", F.lit("")),
        "sequence_kind": F.when(number.isNull(), 1).otherwise(0),
        "sequence_number": number,
        "sequence_text": F.when(number.isNull(), F.coalesce("source_sequence", F.lit(""))).otherwise(""),
    })


def normalize(payloads: DataFrame, expected_org: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Payloads as canonical events, and the rejected rows with a reason.

    ``content`` defaults to the message text, the workspace, surface and type have defaults, metadata falls back to the
    properties. Content that is no object, missing ids and another organisation are rejected.
    """
    content = F.coalesce("content_json", F.to_json(F.struct(F.coalesce("message", F.lit("")).alias("text"))))
    reason = (
        F.when(F.coalesce("event_id", F.lit("")) == "", "event_id is required")
        .when(F.col("external_user_id").isNull(), "external_user_id is required")
        .when(F.col("conversation_id").isNull(), "conversation_id is required")
        .when(~F.coalesce(F.schema_of_variant(F.try_parse_json(content)).startswith("OBJECT"), F.lit(False)),
              "content must be an object")
    )
    if expected_org is not None:
        reason = F.when(F.col("organization_id") != expected_org, "organization mismatch").otherwise(reason)
    marked = payloads.withColumns({"_content": content, "reject_reason": reason})
    empty = F.array().cast("array<string>")
    good = marked.filter("reject_reason is null").select(
        "organization_id", "event_id", F.coalesce("workspace_id", F.lit("default")).alias("workspace_id"),
        F.coalesce("surface", F.lit("generic_chatbot")).alias("surface"), "external_user_id", "conversation_id",
        F.coalesce("type", F.lit("human_message")).alias("type"), "occurred_at", "received_at", "source_sequence",
        F.coalesce(F.get_json_object("_content", "$.text"), F.lit("")).alias("text"),
        F.coalesce("goal", F.lit("")).alias("goal"), F.coalesce("entities", empty).alias("entities"),
        F.coalesce("artifacts", empty).alias("artifacts"),
        F.coalesce("metadata_json", "properties_json", F.lit("{}")).alias("metadata_json"), "ingest_seq")
    bad = marked.filter("reject_reason is not null").drop("_content")
    return good, bad


def split_by_type(events: DataFrame, column: str = "event_type") -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col(column).isin(*EVENT_TYPES), F.lit(False))
    return events.filter(ok), events.filter(~ok).withColumn(
        "reject_reason", F.concat(F.lit("Unsupported event_type: "), F.coalesce(column, F.lit(""))))


def allowed_surfaces(events: DataFrame, config: DataFrame) -> DataFrame:
    """Add ``allowed`` and ``reason`` from the organisation's surface list; an empty list allows all."""
    open_ = F.coalesce(F.size("allowed_surfaces") <= 0, F.lit(True))
    allowed = open_ | F.array_contains("allowed_surfaces", F.col("surface"))
    return events.join(config.select("organization_id", "allowed_surfaces"), "organization_id", "left").withColumn(
        "allowed", allowed).withColumn("reason", F.when(F.col("allowed"), "surface allowed").otherwise(
            "surface is not enabled for organization")).drop("allowed_surfaces")


def payload_hash(metadata: str = "metadata_json") -> Column:
    """Digest of the logical payload; ``received_at`` is transport data and left out."""
    return struct_digest(
        "organization_id", "event_id", "workspace_id", "surface", "external_user_id", "conversation_id", "type",
        "occurred_at", "source_sequence", "text", "goal", "entities", "artifacts",
        F.coalesce(F.to_json(F.try_parse_json(metadata)), metadata).alias("metadata"))


def idempotency(events: DataFrame, hash_column: str = "payload_hash", order: str = "ingest_seq") -> DataFrame:
    """One row per (organisation, event id, payload): accepted, duplicates of it, or a conflicting payload.

    The first delivery of an event id wins; of payloads with one sequence number the smaller digest. Copies are counted by partial aggregation, so an id delivered millions of
    times does not gather in one task.
    """
    payloads = events.groupBy("organization_id", "event_id", hash_column).agg(
        F.min(order).alias("first_seq"), F.count("*").alias("deliveries"))
    firsts = payloads.groupBy("organization_id", "event_id").agg(F.min(F.struct("first_seq", hash_column)).alias("accepted"))
    return payloads.join(firsts, ["organization_id", "event_id"]).select(
        "organization_id", "event_id", hash_column, "first_seq", "deliveries",
        F.when(F.col(hash_column) == F.col(f"accepted.{hash_column}"), "accepted").otherwise("conflict").alias("status"))


def accepted_events(events: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """The first delivery of each (organisation, event id)."""
    rest = [c for c in events.columns if c not in ("organization_id", "event_id")]
    return events.groupBy("organization_id", "event_id").agg(
        F.min_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("e")).select("organization_id", "event_id", "e.*")


def first_wins(rows: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows to append to a cache table: new keys only, the first row of each."""
    rest = [c for c in rows.columns if c not in keys]
    firsts = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
    return firsts.join(existing.select(*keys), keys, "left_anti")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def provider_metadata(provider: str, model: Column, external_id: Column, extra: dict[str, Column] | None = None) -> Column:
    """Metadata JSON of a provider adapter; empty model and external id are left out."""
    fields = [F.lit(provider).alias("provider"), F.nullif(model, F.lit("")).alias("model"),
              F.nullif(external_id, F.lit("")).alias("external_id")]
    fields += [c.alias(n) for n, c in (extra or {}).items()]
    return F.to_json(F.struct(*fields))


def fill_from_trace(events: DataFrame, conversation: Column, thread: Column, goal: Column) -> DataFrame:
    return events.withColumns({
        "conversation_id": F.coalesce("conversation_id", conversation),
        "thread_id": F.coalesce("thread_id", thread), "goal_id": F.coalesce("goal_id", goal)})
