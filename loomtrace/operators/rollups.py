"""Thread, goal and trajectory roll-ups.

Roll-ups that list distinct values first reduce the events to one row per distinct value, so that the second step
gathers values, never events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.functions.text import fixed3
from loomtrace.operators import signals
from loomtrace.operators.signals import TID, primitive, truthy

TIMELINE = ["event_id", "conversation_id", "thread_id", "goal_id", "actor_type", "actor_id", "text", "tool_name",
            "status", "behavior", "ts"]


def timeline(events: DataFrame, thread_id: str | None = None, goal_id: str | None = None) -> DataFrame:
    rows = events.withColumn("behavior", F.get_json_object("metadata_json", "$.behavior"))
    if thread_id is not None:
        rows = rows.filter(F.col("thread_id") == thread_id)
    if goal_id is not None:
        rows = rows.filter(F.col("goal_id") == goal_id)
    return rows.select(TID, "seq", *TIMELINE)


def failures(events: DataFrame) -> DataFrame:
    return events.filter((F.col("actor_type") == "tool") & (F.col("status") == "failed"))


def repairs(events: DataFrame) -> DataFrame:
    return events.filter((F.col("actor_type") == "human") & (primitive() == "repair"))


def _counts() -> list[Column]:
    actor, status = F.col("actor_type"), F.col("status")
    human, tool = actor == "human", actor == "tool"
    return [
        F.count("*").alias("events"),
        F.count_if(human).alias("human_events"),
        F.count_if(actor == "agent").alias("agent_events"),
        F.count_if(tool).alias("tool_events"),
        *[F.count_if(human & (primitive() == p)).alias(n)
          for n, p in (("repairs", "repair"), ("refinements", "refine"), ("corrections", "correct"))],
        F.count_if(tool & (status == "failed")).alias("failures"),
        F.count_if(tool & (status == "success")).alias("successes"),
    ]


_COUNTERS = ["events", "human_events", "agent_events", "tool_events", "repairs", "refinements", "corrections",
             "failures", "successes"]


def _distinct_list(name: str) -> Column:
    return F.sort_array(F.collect_set(truthy(name)))


def thread_facts(events: DataFrame) -> DataFrame:
    """Counters and the sorted distinct conversations and goals of every thread."""
    fine = events.filter(truthy("thread_id").isNotNull()).groupBy(
        TID, "thread_id", "conversation_id", "goal_id").agg(*_counts())
    return fine.groupBy(TID, "thread_id").agg(
        *[F.sum(c).cast("long").alias(c) for c in _COUNTERS],
        _distinct_list("conversation_id").alias("conversations"), _distinct_list("goal_id").alias("goals"))


def threads(events: DataFrame) -> DataFrame:
    return thread_facts(events).select(
        TID, "thread_id", "events", "conversations", "goals", "human_events", "agent_events", "tool_events")


def goals(events: DataFrame) -> DataFrame:
    fine = events.filter(truthy("goal_id").isNotNull()).groupBy(
        TID, "goal_id", "thread_id", "conversation_id").agg(F.count("*").alias("events"))
    return fine.groupBy(TID, "goal_id").agg(
        F.sum("events").cast("long").alias("events"), _distinct_list("thread_id").alias("threads"),
        _distinct_list("conversation_id").alias("conversations"))


def summary(events: DataFrame) -> DataFrame:
    """Twelve-field roll-up per trajectory."""
    state = signals.state(events)
    sets = events.select(TID, F.explode(F.array(
        F.struct(F.lit("t").alias("kind"), truthy("thread_id").alias("value")),
        F.struct(F.lit("g").alias("kind"), truthy("goal_id").alias("value")))).alias("p")).select(
        TID, "p.kind", "p.value").filter("value is not null").distinct().groupBy(TID).agg(
        F.count_if(F.col("kind") == "t").alias("threads"), F.count_if(F.col("kind") == "g").alias("goals"))
    return state.join(sets, TID, "left").select(
        TID, F.col("event_count").alias("events"), F.col("conversation_count").alias("conversations"),
        F.col("agent_count").alias("agents"), F.coalesce("threads", F.lit(0)).cast("long").alias("threads"),
        F.coalesce("goals", F.lit(0)).cast("long").alias("goals"), F.col("repair_count").alias("repairs"),
        "tool_failures", F.col("cross_agent_duplicate_actions").alias("cross_agent_duplicates"), "agent_handoffs",
        F.col("recovery_count").alias("recoveries"), (~F.col("unresolved")).alias("resolved"))


def thread_analytics(events: DataFrame) -> DataFrame:
    facts = thread_facts(events)
    n = F.size("conversations").cast("long")
    return facts.select(
        TID, "thread_id", "events", F.col("human_events").alias("human_turns"),
        F.col("agent_events").alias("agent_turns"), F.col("tool_events").alias("tool_calls"), "conversations",
        n.alias("conversation_count"), (n > 1).alias("revisited"),
        ((n == 1) & (F.col("human_events") <= 1)).alias("one_off"), "repairs", "refinements", "corrections", "failures",
        "successes")


def first_seen(events: DataFrame, value: Column, name: str) -> DataFrame:
    """Distinct values per thread in the order of their first event."""
    firsts = events.filter(truthy("thread_id").isNotNull()).select(
        TID, "thread_id", F.struct("ts", "seq").alias("pos"), value.alias("v")).filter(
        F.col("v").isNotNull() & (F.col("v") != "")).groupBy(TID, "thread_id", "v").agg(F.min("pos").alias("pos"))
    return firsts.groupBy(TID, "thread_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias(name))


def analysis(events: DataFrame, continuity: DataFrame) -> DataFrame:
    """Full analysis per thread. ``continuity``: (trajectory, thread, continuity, evolution)."""
    empty = F.array().cast("array<string>")
    keys = [TID, "thread_id"]
    provider = F.get_json_object("metadata_json", "$.provider")
    agent = F.when(F.col("actor_type") == "agent", F.col("actor_id"))
    t = (
        thread_analytics(events)
        .join(first_seen(events, provider, "providers"), keys, "left")
        .join(first_seen(events, agent, "agent_ids"), keys, "left")
        .join(signals.thread_recoveries(events), keys, "left")
        .join(continuity, keys, "left")
        .withColumns({
            "providers": F.coalesce("providers", empty), "agent_ids": F.coalesce("agent_ids", empty),
            "recoveries": F.coalesce("recoveries", F.lit(0)).cast("long"),
            "continuity": F.coalesce("continuity", F.lit(0.0)), "evolution": F.coalesce("evolution", F.lit(0.0)),
        })
    )
    state = (F.when(F.col("one_off"), "one_off")
             .when((F.col("failures") > 0) & (F.col("successes") == 0), "stalled")
             .when(F.col("recoveries") > 0, "recovered").when(F.col("revisited"), "evolving").otherwise("active"))

    def counted(name: str, label: str) -> Column:
        return F.when(F.col(name) > 0, F.concat(F.col(name).cast("string"), F.lit(label)))

    evidence = F.array_compact(F.array(
        F.when(F.col("revisited"), F.concat(F.lit("revisited across "), F.col("conversation_count").cast("string"),
                                            F.lit(" conversations"))),
        F.when(F.col("one_off"), F.lit("observed in only one conversation")),
        F.when(F.size("providers") > 1, F.concat(F.lit("cross-provider trajectory: "),
                                                 F.array_join("providers", " -> "))),
        counted("repairs", " repair transition(s)"), counted("refinements", " refinement transition(s)"),
        counted("corrections", " correction transition(s)"), counted("failures", " failed tool action(s)"),
        counted("recoveries", " recovery event(s)"),
        F.when(F.col("human_turns") > 1, F.concat(F.lit("continuity="), fixed3(F.col("continuity")),
                                                  F.lit(", evolution="), fixed3(F.col("evolution")))),
    ))
    return t.withColumn("state", state).withColumn("evidence", evidence)


def trajectory_titles(events: DataFrame) -> DataFrame:
    """Thread listing with a title: the first human text (55 characters), else the thread id."""
    said = F.when((F.col("actor_type") == "human") & truthy("text").isNotNull(), F.struct("ts", "seq"))
    return events.filter(truthy("thread_id").isNotNull()).groupBy(TID, "thread_id").agg(
        F.min_by("text", said).alias("first_text"), F.count("*").alias("events")).select(
        TID, "thread_id", F.coalesce(F.substring("first_text", 1, 55), "thread_id").alias("title"), "events")
