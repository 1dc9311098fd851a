"""Thread, goal and trajectory roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import ordered, rollups, signals, similarity
from loomtrace.plans.oracle import TRACE
from loomtrace.plans.registry import Section
from loomtrace.plans.signals_queries import _STATE_CTE
from loomtrace.plans.similarity_sql import continuity_ctes
from loomtrace.sources import drivers

SECTION = Section()


def _flat(df, *names):
    return df.withColumns({n: F.array_join(n, "|") for n in names})


_LIST = "coalesce(string_agg(DISTINCT {0}, '|' ORDER BY {0}), '')"
_COUNTS = """count(*) AS events, count(*) FILTER (actor_type = 'human') AS human_events,
  count(*) FILTER (actor_type = 'agent') AS agent_events, count(*) FILTER (actor_type = 'tool') AS tool_events"""


@SECTION.add("d1a_threads", f"""WITH {TRACE} SELECT trajectory_id, thread_id, {_COUNTS},
  {_LIST.format('conversation_id')} AS conversations, {_LIST.format('goal_id')} AS goals FROM te GROUP BY 1, 2""")
def _(spark, sf):
    return _flat(rollups.threads(drivers.trace_events(spark, sf)), "conversations", "goals")


@SECTION.add("d2a_goals", f"""WITH {TRACE} SELECT trajectory_id, goal_id, count(*) AS events,
  {_LIST.format('thread_id')} AS threads, {_LIST.format('conversation_id')} AS conversations FROM te GROUP BY 1, 2""")
def _(spark, sf):
    return _flat(rollups.goals(drivers.trace_events(spark, sf)), "threads", "conversations")


@SECTION.add("d3a_summary", f"""WITH {_STATE_CTE}, s AS (SELECT trajectory_id, count(DISTINCT thread_id) AS threads,
    count(DISTINCT goal_id) AS goals FROM te GROUP BY 1)
  SELECT trajectory_id, event_count AS events, conversation_count AS conversations, agent_count AS agents, threads, goals,
    repair_count AS repairs, tool_failures, cross_agent_duplicate_actions AS cross_agent_duplicates, agent_handoffs,
    recovery_count AS recoveries, NOT unresolved AS resolved FROM state JOIN s USING (trajectory_id)""")
def _(spark, sf):
    return rollups.summary(drivers.trace_events(spark, sf))


_ANALYTICS = """th AS (SELECT trajectory_id, thread_id, count(*) AS events,
  count(*) FILTER (actor_type = 'human') AS human_turns, count(*) FILTER (actor_type = 'agent') AS agent_turns,
  count(*) FILTER (actor_type = 'tool') AS tool_calls, string_agg(DISTINCT conversation_id, '|' ORDER BY conversation_id)
    AS conversations, count(DISTINCT conversation_id) AS conversation_count,
  count(*) FILTER (actor_type = 'human' AND primitive = 'repair') AS repairs,
  count(*) FILTER (actor_type = 'human' AND primitive = 'refine') AS refinements,
  count(*) FILTER (actor_type = 'human' AND primitive = 'correct') AS corrections,
  count(*) FILTER (actor_type = 'tool' AND status = 'failed') AS failures,
  count(*) FILTER (actor_type = 'tool' AND status = 'success') AS successes FROM te GROUP BY 1, 2)"""


@SECTION.add("d4a_thread_analytics", f"""WITH {TRACE}, {_ANALYTICS} SELECT *, conversation_count > 1 AS revisited,
  conversation_count = 1 AND human_turns <= 1 AS one_off FROM th""")
def _(spark, sf):
    return _flat(rollups.thread_analytics(drivers.trace_events(spark, sf)), "conversations")


def thread_texts(events):
    """Non-blank human texts of every thread with their ordinal."""
    said = events.filter((F.col("actor_type") == "human") & (F.trim("text") != "")).select(
        "trajectory_id", "thread_id", "ts", "seq", F.trim("text").alias("text"))
    return ordered.ordinal(said, ["trajectory_id", "thread_id"], ["ts", "seq"], signals.day_chunk(), "n")


def thread_continuity(events):
    return similarity.continuity(thread_texts(events), ["trajectory_id", "thread_id"], "n")


_TEXTS = """tx AS (SELECT trajectory_id, thread_id, trim(text) AS text, row_number() OVER (
    PARTITION BY trajectory_id, thread_id ORDER BY ts, seq) AS n FROM te
  WHERE actor_type = 'human' AND trim(text) <> '')"""
_EVIDENCE = """concat_ws('|', CASE WHEN revisited THEN 'revisited across ' || conversation_count || ' conversations' END,
  CASE WHEN one_off THEN 'observed in only one conversation' END,
  CASE WHEN provider_count > 1 THEN 'cross-provider trajectory: ' || replace(providers, '|', ' -> ') END,
  CASE WHEN repairs > 0 THEN repairs || ' repair transition(s)' END,
  CASE WHEN refinements > 0 THEN refinements || ' refinement transition(s)' END,
  CASE WHEN corrections > 0 THEN corrections || ' correction transition(s)' END,
  CASE WHEN failures > 0 THEN failures || ' failed tool action(s)' END,
  CASE WHEN recoveries > 0 THEN recoveries || ' recovery event(s)' END,
  CASE WHEN human_turns > 1 THEN printf('continuity=%.3f, evolution=%.3f', continuity, evolution) END)"""


@SECTION.add("d5a_trajectory_analysis", f"""WITH {TRACE}, {_ANALYTICS}, {_TEXTS},
  {continuity_ctes('tx', ['trajectory_id', 'thread_id'])},
  pf AS (SELECT trajectory_id, thread_id, provider, min((ts, seq)) AS p FROM te WHERE provider IS NOT NULL GROUP BY 1, 2, 3),
  pv AS (SELECT trajectory_id, thread_id, string_agg(provider, '|' ORDER BY p) AS providers, count(*) AS provider_count
    FROM pf GROUP BY 1, 2),
  af AS (SELECT trajectory_id, thread_id, actor_id, min((ts, seq)) AS p FROM te WHERE actor_type = 'agent' GROUP BY 1, 2, 3),
  av AS (SELECT trajectory_id, thread_id, string_agg(actor_id, '|' ORDER BY p) AS agent_ids FROM af GROUP BY 1, 2),
  o AS (SELECT trajectory_id, thread_id, status, lag(status) OVER (
    PARTITION BY trajectory_id, thread_id ORDER BY ts, seq) AS p FROM te WHERE status IN ('failed', 'success')),
  rc AS (SELECT trajectory_id, thread_id, count(*) FILTER (status = 'success' AND p = 'failed') AS recoveries
    FROM o GROUP BY 1, 2),
  x AS (SELECT th.* EXCLUDE (conversations, events), conversation_count > 1 AS revisited,
    conversation_count = 1 AND human_turns <= 1 AS one_off, coalesce(providers, '') AS providers,
    coalesce(provider_count, 0) AS provider_count, coalesce(agent_ids, '') AS agent_ids,
    coalesce(recoveries, 0) AS recoveries, coalesce(continuity, 0.0) AS continuity, coalesce(evolution, 0.0) AS evolution
    FROM th LEFT JOIN pv USING (trajectory_id, thread_id) LEFT JOIN av USING (trajectory_id, thread_id)
    LEFT JOIN rc USING (trajectory_id, thread_id) LEFT JOIN cont USING (trajectory_id, thread_id))
  SELECT * EXCLUDE (provider_count), CASE WHEN one_off THEN 'one_off' WHEN failures > 0 AND successes = 0 THEN 'stalled'
    WHEN recoveries > 0 THEN 'recovered' WHEN revisited THEN 'evolving' ELSE 'active' END AS state,
    {_EVIDENCE} AS evidence FROM x""")
def _(spark, sf):
    e = drivers.trace_events(spark, sf)
    return _flat(rollups.analysis(e, thread_continuity(e)), "providers", "agent_ids", "evidence").drop(
        "conversations", "events")


@SECTION.add("j2_thread_continuity", f"""WITH {TRACE}, {_TEXTS}, {continuity_ctes('tx', ['trajectory_id', 'thread_id'])}
  SELECT * FROM cont""")
def _(spark, sf):
    return thread_continuity(drivers.trace_events(spark, sf))


@SECTION.add("j2_conversation_continuity", f"""WITH tx AS (SELECT conv_id, trim(text) AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' AND trim(text) <> ''),
  {continuity_ctes('tx', ['conv_id'])} SELECT * FROM cont""")
def _(spark, sf):
    said = drivers.table(spark, sf, "conversations").filter("role = 'user' and trim(text) <> ''").select(
        "conv_id", "turn", F.trim("text").alias("text"))
    numbered = ordered.ordinal(said, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1000), "n")
    return similarity.continuity(numbered, ["conv_id"], "n")


@SECTION.add("d6a_case_distribution", """SELECT o_orderpriority AS label, o_orderstatus AS difficulty, count(*) AS cases
  FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    return drivers.table(spark, sf, "orders").groupBy(
        F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("difficulty")).agg(
        F.count("*").alias("cases"))


@SECTION.add("d8a_events_per_org", """SELECT 'org_' || (user_id % 3) AS organization_id, count(*) AS events
  FROM events GROUP BY 1""")
def _(spark, sf):
    return drivers.org_events(spark, sf).groupBy("organization_id").agg(F.count("*").alias("events"))


@SECTION.add("d9a_latest_per_event", """SELECT l_orderkey AS event_id, arg_max(l_returnflag, (l_shipdate, l_linenumber,
    l_partkey, l_suppkey)) AS decision, max(l_shipdate)::DATE::VARCHAR AS created_on FROM lineitem GROUP BY 1""")
def _(spark, sf):
    at = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return drivers.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(
        F.max_by("l_returnflag", at).alias("decision"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("created_on"))


@SECTION.add("d11a_margin_order_statistics", """WITH s AS (SELECT (l_discount + l_tax + (l_partkey % 7) / 100.0) / 2 AS m
    FROM lineitem), r AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM s)
  SELECT round(min(m), 6) AS min_margin, round(max(m) FILTER (i = n // 2), 6) AS median_margin,
    round(max(m), 6) AS max_margin, count(*) AS cases FROM r""")
def _(spark, sf):
    from loomtrace.operators.evaluate import order_statistics
    m = drivers.table(spark, sf, "lineitem").select(
        ((F.col("l_discount") + F.col("l_tax") + F.col("l_partkey") % 7 / 100.0) / 2).alias("margin"))
    return order_statistics(m, "margin")


@SECTION.add("b06_timeline", f"""WITH {TRACE} SELECT trajectory_id, seq, event_id, conversation_id, thread_id, goal_id,
  actor_type, actor_id, text, tool_name, status, CASE WHEN primitive IS NOT NULL THEN
    '{{"primitive":"' || primitive || '","confidence":' || confidence || '}}' END AS behavior FROM te
  WHERE thread_id = 'th_2' AND goal_id = 'g_1'""")
def _(spark, sf):
    return rollups.timeline(drivers.trace_events(spark, sf), "th_2", "g_1").drop("ts")


@SECTION.add("b07_failures", f"""WITH {TRACE} SELECT trajectory_id, event_id, tool_name FROM te
  WHERE actor_type = 'tool' AND status = 'failed'""")
def _(spark, sf):
    return rollups.failures(drivers.trace_events(spark, sf)).select("trajectory_id", "event_id", "tool_name")


@SECTION.add("b08_repairs", f"""WITH {TRACE} SELECT trajectory_id, event_id, text FROM te
  WHERE actor_type = 'human' AND primitive = 'repair'""")
def _(spark, sf):
    return rollups.repairs(drivers.trace_events(spark, sf)).select("trajectory_id", "event_id", "text")


@SECTION.add("b24_thread_titles", f"""WITH {TRACE} SELECT trajectory_id, thread_id, coalesce(substr(arg_min(text, (ts, seq))
    FILTER (actor_type = 'human' AND text <> ''), 1, 55), thread_id) AS title, count(*) AS events FROM te GROUP BY 1, 2""")
def _(spark, sf):
    return rollups.trajectory_titles(drivers.trace_events(spark, sf))
