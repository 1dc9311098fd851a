"""Structural signals over the ordered events of a trajectory.

``state`` needs one heavy shuffle, by ``(trajectory, chunk)``: every chunk is reduced to one summary row of counters
and border facts, and the summaries of a trajectory are then merged in order. No task sees more than one chunk of a
trajectory, so a hot trajectory is spread out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtrace.functions.canonical import metadata_fingerprint
from loomtrace.operators import ordered

ORDER = ["ts", "seq"]
TID = "trajectory_id"
BEHAVIOUR_COUNTERS = {
    "repair_count": "repair", "refinement_count": "refine", "topic_switch_count": "new_topic",
    "clarification_count": "clarify", "correction_count": "correct", "resistance_count": "resist",
    "disagreement_count": "disagree",
}


def day_chunk() -> Column:
    """Default cut of a trajectory: one chunk per day."""
    return F.date_trunc("DAY", "ts")


def in_pieces(events: DataFrame, most: int = 50_000) -> DataFrame:
    """``events`` with a column ``piece`` to be passed as ``chunk``: days, and a busy day of a trajectory cut so that a piece has about
    ``most`` rows."""
    return ordered.bounded_pieces(events, [TID], "ts", "seq", day_chunk(), most)


def truthy(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def behaviour(metadata: str = "metadata_json") -> Column:
    """The behaviour record of an event, null when absent or empty."""
    raw = F.get_json_object(metadata, "$.behavior")
    present = raw.isNotNull() & ~raw.isin("", "{}", "null", "false", "0", "[]")
    return F.when(present, F.struct(
        F.get_json_object(metadata, "$.behavior.primitive").alias("primitive"),
        F.coalesce(F.get_json_object(metadata, "$.behavior.confidence").cast("double"), F.lit(0.0)).alias("confidence"),
    ))


def primitive(metadata: str = "metadata_json") -> Column:
    return F.get_json_object(metadata, "$.behavior.primitive")


def _same(a: Column, b: Column) -> Column:
    return a["tool_name"].eqNullSafe(b["tool_name"]) & (a["fp"] == b["fp"])


def _switched(a: Column, b: Column) -> Column:
    return (a["tool_name"] != "") & (b["tool_name"] != "") & (a["tool_name"] != b["tool_name"])


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def chunk_summaries(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """One row per (trajectory, chunk): counters inside the chunk and the facts needed at its borders."""
    position = F.struct(*ORDER)
    human, agent, tool = (F.col("actor_type") == a for a in ("human", "agent", "tool"))
    outcome = F.when(F.col("status").isin("failed", "success"), F.col("status"))
    base = events.select(
        TID, *ORDER, (chunk if chunk is not None else day_chunk()).alias("_chunk"), "actor_type", "status",
        F.when(agent, F.struct("actor_id")).alias("agent"),
        F.when(agent, truthy("actor_id")).alias("agent_id"),
        F.when(tool, outcome).alias("outcome"),
        F.when(tool, F.struct("tool_name", metadata_fingerprint(F.col("metadata_json")).alias("fp"))).alias("call"),
        behaviour().alias("behaviour"),
    )
    inside = Window.partitionBy(TID, "_chunk").orderBy(*ORDER)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = base.select(
        "*",
        F.last("agent", True).over(before).alias("agent_before"),
        F.last("agent_id", True).over(before).alias("agent_id_before"),
        F.last("outcome", True).over(before).alias("outcome_before"),
        F.count_if(F.col("outcome") == "failed").over(upto).alias("failed_so_far"),
    ).withColumn("tool_row", F.when(F.col("call").isNotNull(), F.struct(
        F.col("call.tool_name").alias("tool_name"), F.col("call.fp").alias("fp"),
        F.col("agent_before").alias("agent"))))
    rows = rows.withColumn("prev", F.last("tool_row", True).over(before))

    now, prev = F.col("tool_row"), F.col("prev")
    repeated = now.isNotNull() & prev.isNotNull() & _same(now, prev)
    at = lambda c: F.when(c, position)
    success = F.col("outcome") == "success"
    out = rows.groupBy(TID, "_chunk").agg(
        F.count("*").alias("event_count"),
        *[F.count_if(F.col("actor_type") == a).alias(f"{a}_events") for a in ("human", "agent", "tool")],
        _count(repeated).alias("dup"),
        _count(repeated & now["agent"].isNotNull() & prev["agent"].isNotNull()
               & ~now["agent"]["actor_id"].eqNullSafe(prev["agent"]["actor_id"])).alias("cross"),
        F.max_by(now["agent"], at(repeated & prev["agent"].isNull() & now["agent"].isNotNull())).alias("cross_open"),
        _count(_switched(now, prev)).alias("switches"),
        _count(F.col("agent_id") != F.col("agent_id_before")).alias("handoffs"),
        F.min_by("agent_id", at(F.col("agent_id").isNotNull())).alias("first_agent_id"),
        F.max_by("agent_id", at(F.col("agent_id").isNotNull())).alias("last_agent_id"),
        F.max_by("agent", at(F.col("agent").isNotNull())).alias("last_agent"),
        F.min_by("tool_row", at(now.isNotNull())).alias("first_tool"),
        F.max_by("tool_row", at(now.isNotNull())).alias("last_tool"),
        F.min_by("outcome", at(F.col("outcome").isNotNull())).alias("first_outcome"),
        F.max_by("outcome", at(F.col("outcome").isNotNull())).alias("last_outcome"),
        _count(success & (F.col("outcome_before") == "failed")).alias("recoveries"),
        _count(F.col("outcome") == "failed").alias("failures"),
        _count(success).alias("successes"),
        F.max_by("failed_so_far", at(success)).alias("failed_at_success"),
        F.max_by("behaviour", at(F.col("behaviour").isNotNull())).alias("last_behaviour"),
        *[_count(F.col("behaviour.primitive") == p).alias(n) for n, p in BEHAVIOUR_COUNTERS.items()],
    )
    return out.withColumn("tail_failures", F.col("failures") - F.coalesce("failed_at_success", F.lit(0)))


def merge_summaries(summaries: DataFrame) -> DataFrame:
    """Merge chunk summaries of each trajectory in order into the final counters."""
    per_key = Window.partitionBy(TID).orderBy("_chunk")
    before = per_key.rowsBetween(Window.unboundedPreceding, -1)
    whole = per_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = summaries.select(
        "*",
        F.last("last_agent", True).over(before).alias("in_agent"),
        F.last("last_agent_id", True).over(before).alias("in_agent_id"),
        F.last("last_outcome", True).over(before).alias("in_outcome"),
        F.max(F.when(F.col("successes") > 0, F.col("_chunk"))).over(whole).alias("success_chunk"),
    ).withColumn("out_tool", F.when(F.col("last_tool").isNotNull(), F.struct(
        F.col("last_tool.tool_name").alias("tool_name"), F.col("last_tool.fp").alias("fp"),
        F.coalesce("last_tool.agent", "in_agent").alias("agent"))))
    s = s.withColumn("in_tool", F.last("out_tool", True).over(before))

    first, incoming = F.col("first_tool"), F.col("in_tool")
    first_agent = F.coalesce("first_tool.agent", "in_agent")
    border = first.isNotNull() & incoming.isNotNull() & _same(first, incoming)
    differ = lambda a, b: a.isNotNull() & b.isNotNull() & ~a["actor_id"].eqNullSafe(b["actor_id"])
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)
    last_at = lambda n: F.max_by(n, F.when(F.col(n).isNotNull(), F.col("_chunk")))
    long = lambda c: c.cast("long")
    tail = (F.when(F.col("success_chunk").isNull() | (F.col("_chunk") > F.col("success_chunk")), F.col("failures"))
            .when(F.col("_chunk") == F.col("success_chunk"), F.col("tail_failures")).otherwise(0))
    total = lambda n: long(F.sum(n)).alias(n)
    merged = s.groupBy(TID).agg(
        total("event_count"), total("human_events"), total("agent_events"), total("tool_events"),
        long(F.sum(F.col("handoffs") + one(F.col("first_agent_id") != F.col("in_agent_id")))).alias("agent_handoffs"),
        long(F.sum(F.col("dup") + one(border))).alias("duplicate_tool_calls"),
        long(F.sum(F.col("cross") + one(differ(F.col("cross_open"), F.col("in_agent")))
                   + one(border & differ(first_agent, F.col("in_tool.agent"))))).alias("cross_agent_duplicate_actions"),
        long(F.sum(F.col("switches") + one(_switched(first, incoming)))).alias("tool_switches"),
        long(F.sum("failures")).alias("tool_failures"),
        long(F.sum(tail)).alias("consecutive_tool_failures"),
        long(F.sum(F.col("recoveries") + one((F.col("first_outcome") == "success") & (F.col("in_outcome") == "failed")))
             ).alias("recovery_count"),
        last_at("last_outcome").alias("_outcome"),
        last_at("last_agent_id").alias("last_agent_id"),
        last_at("last_tool").alias("_tool"),
        last_at("last_behaviour").alias("_behaviour"),
        *[total(n) for n in BEHAVIOUR_COUNTERS],
    )
    return merged.select(
        TID, "event_count", "human_events", "agent_events", "tool_events", "agent_handoffs", "duplicate_tool_calls",
        "cross_agent_duplicate_actions", "tool_switches", "tool_failures", "consecutive_tool_failures",
        "recovery_count", (F.coalesce("_outcome", F.lit("")) == "failed").alias("unresolved"),
        ((F.coalesce("_outcome", F.lit("")) == "success") & (F.col("tool_failures") > 0)).alias("recovered"),
        "last_agent_id", F.col("_tool.tool_name").alias("last_tool_name"), *BEHAVIOUR_COUNTERS,
        F.col("_behaviour.primitive").alias("last_behavior"),
        F.coalesce("_behaviour.confidence", F.lit(0.0)).alias("behavior_confidence"),
    )


def distinct_counts(events: DataFrame) -> DataFrame:
    """Distinct conversations and agents per trajectory, deduplicated before counting."""
    pairs = events.select(TID, F.explode(F.array(
        F.struct(F.lit("c").alias("kind"), truthy("conversation_id").alias("value")),
        F.struct(F.lit("a").alias("kind"), F.when(F.col("actor_type") == "agent", truthy("actor_id")).alias("value")),
    )).alias("p")).select(TID, "p.kind", "p.value").filter(F.col("value").isNotNull()).distinct()
    return pairs.groupBy(TID).agg(
        F.count_if(F.col("kind") == "c").alias("conversation_count"),
        F.count_if(F.col("kind") == "a").alias("agent_count"),
    )


def state(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """The full counter row per trajectory."""
    merged = merge_summaries(chunk_summaries(events, chunk))
    return merged.join(distinct_counts(events), TID, "left").withColumns({
        "conversation_count": F.coalesce("conversation_count", F.lit(0)).cast("long"),
        "agent_count": F.coalesce("agent_count", F.lit(0)).cast("long"),
    })


def duplicate_calls(events: DataFrame, window: int = 1, chunk: Column | None = None) -> DataFrame:
    """Tool calls whose fingerprint is among the previous ``window`` tool calls of the trajectory."""
    tools = events.filter(F.col("actor_type") == "tool").select(
        TID, "event_id", *ORDER, "tool_name",
        F.to_json(F.struct(F.coalesce("tool_name", F.lit("\0")).alias("t"),
                           metadata_fingerprint(F.col("metadata_json")).alias("m"))).alias("fp"))
    cut = chunk if chunk is not None else day_chunk()
    # each chunk also receives the last `window` calls before it, so the bounded frame is complete inside the chunk
    base = tools.withColumn("_chunk", cut)
    tails = ordered.top_rows(base, [TID, "_chunk"], [F.desc("ts"), F.desc("seq")], window)
    chunk_tails = tails.groupBy(TID, "_chunk").agg(F.transform(
        F.sort_array(F.collect_list(F.struct(*ORDER, "fp"))), lambda c: c["fp"]).alias("tail"))
    per_key = Window.partitionBy(TID).orderBy("_chunk").rowsBetween(-window, -1)
    carried = chunk_tails.select(TID, "_chunk", F.flatten(F.collect_list("tail").over(per_key)).alias("carried"))
    inside = Window.partitionBy(TID, "_chunk").orderBy(*ORDER).rowsBetween(-window, -1)
    local = base.select("*", F.collect_list("fp").over(inside).alias("_near"))
    joined = local.join(carried, [TID, "_chunk"], "left")
    earlier = F.coalesce("carried", F.array().cast("array<string>"))
    joined = joined.withColumn("_recent", _last_n(F.concat(earlier, F.col("_near")), window))
    return joined.select(TID, "event_id", "seq", "tool_name", F.array_contains("_recent", F.col("fp")).alias("duplicate"))


def _last_n(values: Column, n: int) -> Column:
    return F.when(F.size(values) > n, F.slice(values, -n, n)).otherwise(values)


def resolutions(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Successful tool events with the last agent event before them."""
    cut = chunk if chunk is not None else day_chunk()
    agent = F.when(F.col("actor_type") == "agent", F.struct("event_id", "actor_id"))
    slim = events.select(TID, *ORDER, cut.alias("_cut"), "event_id", "actor_type", "actor_id", "status", "thread_id", "goal_id", "tool_name")
    rows = ordered.last_before(slim, [TID], ORDER, F.col("_cut"), {"agent_event": agent})
    return rows.filter((F.col("actor_type") == "tool") & (F.col("status") == "success")).select(
        TID, "event_id", "tool_name", "thread_id", "goal_id", F.col("agent_event.event_id").alias("agent_event_id"),
        F.col("agent_event.actor_id").alias("agent_id"))


def agents(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Per agent: own events, and tool failures and successes while it was the most recent agent."""
    cut = chunk if chunk is not None else day_chunk()
    own = F.when(F.col("actor_type") == "agent", truthy("actor_id"))
    slim = events.select(TID, *ORDER, cut.alias("_cut"), "actor_type", "actor_id", "status")
    rows = ordered.last_before(slim, [TID], ORDER, F.col("_cut"), {"current": own})
    agent = F.when(F.col("actor_type") == "agent", truthy("actor_id")).when(
        F.col("actor_type") == "tool", F.col("current"))
    tool = F.col("actor_type") == "tool"
    return rows.select(TID, agent.alias("agent_id"), "actor_type", "status").filter("agent_id is not null").groupBy(
        TID, "agent_id").agg(
        F.count_if(F.col("actor_type") == "agent").alias("events"),
        F.count_if(tool & (F.col("status") == "failed")).alias("tool_failures_after"),
        F.count_if(tool & (F.col("status") == "success")).alias("tool_successes_after"))


def previous_text(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """For each human event the last non-empty human or agent text before it."""
    cut = chunk if chunk is not None else day_chunk()
    spoken = F.when(F.col("actor_type").isin("human", "agent"), truthy("text"))
    slim = events.select(TID, *ORDER, cut.alias("_cut"), "event_id", "actor_type", "text")
    rows = ordered.last_before(slim, [TID], ORDER, F.col("_cut"), {"previous": spoken})
    return rows.filter("actor_type = 'human'").select(
        TID, "event_id", F.col("text"), F.coalesce("previous", F.lit("")).alias("previous_text"))


def thread_recoveries(events: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Successes that follow a failure inside one thread."""
    cut = chunk if chunk is not None else day_chunk()
    outcome = F.when((F.col("actor_type") == "tool") & F.col("status").isin("failed", "success"), F.col("status"))
    slim = events.filter(truthy("thread_id").isNotNull()).select(TID, "thread_id", *ORDER, outcome.alias("outcome"))
    slim = slim.filter("outcome is not null")
    rows = ordered.last_before(slim, [TID, "thread_id"], ORDER, cut, {"before": F.col("outcome")})
    return rows.groupBy(TID, "thread_id").agg(
        F.count_if((F.col("outcome") == "success") & (F.col("before") == "failed")).alias("recoveries"))


def transitions(events: DataFrame, index: str, chunk: Column) -> DataFrame:
    """Human events that are not the first of their trajectory, with the text of the event just before."""
    rows = ordered.last_before(events, [TID], [index], chunk, {"previous_text": F.col("text")})
    return rows.filter((F.col("actor_type") == "human") & (F.col(index) >= 1) & F.col("previous_text").isNotNull())


def history_of(events: DataFrame, targets: DataFrame, chunk: Callable[[Column], Column] = lambda ts: F.date_trunc("DAY", ts)) -> DataFrame:
    """Strictly earlier events of each target's trajectory; ``local`` marks the target's own conversation.

    ``targets`` holds any set of target events (``trajectory_id``, ``target_id``, ``target_conversation``, ``target_ts``). The result
    has a row per target and earlier event, so it is as long as the targets' histories together. ``chunk`` cuts time into pieces: a
    target meets the pieces of its trajectory that there are up to its own, one row each, and events are joined by (trajectory, piece).
    Pieces before its own count as a whole, times are compared in its own only, and a long trajectory is spread over its pieces.
    """
    own = targets.select(TID, "target_id", "target_conversation", "target_ts", chunk(F.col("target_ts")).alias("_own"))
    placed = events.select(TID, "event_id", "ts", "conversation_id", chunk(F.col("ts")).alias("_piece"))
    wanted = own.join(placed.select(TID, "_piece").distinct(), TID).filter(F.col("_piece") <= F.col("_own"))
    rows = placed.join(wanted, [TID, "_piece"]).filter((F.col("_piece") < F.col("_own")) | (F.col("ts") < F.col("target_ts")))
    return rows.select(TID, "target_id", "event_id", "ts", (F.col("conversation_id") == F.col("target_conversation")).alias("local"))


def sampled(rows: DataFrame, key: Column, share: float) -> DataFrame:
    """A sample by the hash of ``key``: the same rows on every run, independent of partitioning; ``share`` in steps of 1/256."""
    return rows.filter(F.substring(F.sha2(key.cast("string"), 256), 1, 2) < f"{round(share * 256):02x}")
