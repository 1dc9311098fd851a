"""Ordered structural signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import ordered, signals
from loomtrace.plans.oracle import ORG, TRACE
from loomtrace.plans.registry import Section
from loomtrace.sources import drivers

SECTION = Section()

_STATE = ["event_count", "human_events", "agent_events", "tool_events", "conversation_count", "agent_count",
          "agent_handoffs", "duplicate_tool_calls", "cross_agent_duplicate_actions", "tool_switches", "tool_failures",
          "consecutive_tool_failures", "recovery_count", "unresolved", "recovered", "last_agent_id", "last_tool_name",
          "repair_count", "refinement_count", "topic_switch_count", "clarification_count", "correction_count",
          "resistance_count", "disagreement_count", "last_behavior", "behavior_confidence"]

# plain windows over the whole trajectory: a different route to the same counters
_STATE_CTE = f"""{TRACE}, w1 AS (
  SELECT *, row_number() OVER t AS n,
    last_value(CASE WHEN actor_type = 'agent' THEN row_id END IGNORE NULLS) OVER tp AS agent_row,
    last_value(CASE WHEN actor_type = 'agent' AND actor_id <> '' THEN actor_id END IGNORE NULLS) OVER tp AS prev_agent,
    last_value(CASE WHEN actor_type = 'tool' AND status IN ('failed', 'success') THEN status END IGNORE NULLS) OVER tp
      AS prev_outcome
  FROM (SELECT *, seq AS row_id FROM te)
  WINDOW t AS (PARTITION BY trajectory_id ORDER BY ts, seq),
    tp AS (PARTITION BY trajectory_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 w2 AS (SELECT w1.*, a.actor_id AS near_agent FROM w1 LEFT JOIN te a ON a.seq = w1.agent_row),
 tools AS (SELECT *, lag(seq) OVER p AS p_seq, lag(tool_name) OVER p AS p_tool, lag(v) OVER p AS p_v,
    lag(agent_row) OVER p AS p_agent_row, lag(near_agent) OVER p AS p_near
  FROM w2 WHERE actor_type = 'tool' WINDOW p AS (PARTITION BY trajectory_id ORDER BY ts, seq)),
 tc AS (SELECT trajectory_id,
    count(*) FILTER (p_seq IS NOT NULL AND tool_name IS NOT DISTINCT FROM p_tool AND v = p_v) AS duplicate_tool_calls,
    count(*) FILTER (p_seq IS NOT NULL AND tool_name IS NOT DISTINCT FROM p_tool AND v = p_v AND agent_row IS NOT NULL
      AND p_agent_row IS NOT NULL AND near_agent IS DISTINCT FROM p_near) AS cross_agent_duplicate_actions,
    count(*) FILTER (p_tool <> tool_name) AS tool_switches,
    count(*) FILTER (status = 'failed') AS tool_failures,
    count(*) FILTER (status = 'success' AND prev_outcome = 'failed') AS recovery_count,
    max(n) FILTER (status = 'success') AS last_success,
    arg_max(status, n) FILTER (status IN ('failed', 'success')) AS last_outcome,
    arg_max(tool_name, n) AS last_tool_name
  FROM tools GROUP BY trajectory_id),
 tail AS (SELECT t.trajectory_id, count(*) AS c FROM tools t JOIN tc USING (trajectory_id)
  WHERE t.status = 'failed' AND t.n > coalesce(tc.last_success, 0) GROUP BY 1),
 st AS (SELECT trajectory_id, count(*) AS event_count,
    count(*) FILTER (actor_type = 'human') AS human_events, count(*) FILTER (actor_type = 'agent') AS agent_events,
    count(*) FILTER (actor_type = 'tool') AS tool_events, count(DISTINCT conversation_id) AS conversation_count,
    count(DISTINCT CASE WHEN actor_type = 'agent' THEN actor_id END) AS agent_count,
    count(*) FILTER (actor_type = 'agent' AND prev_agent <> actor_id) AS agent_handoffs,
    arg_max(actor_id, n) FILTER (actor_type = 'agent') AS last_agent_id,
    count(*) FILTER (primitive = 'repair') AS repair_count, count(*) FILTER (primitive = 'refine') AS refinement_count,
    count(*) FILTER (primitive = 'new_topic') AS topic_switch_count,
    count(*) FILTER (primitive = 'clarify') AS clarification_count,
    count(*) FILTER (primitive = 'correct') AS correction_count,
    count(*) FILTER (primitive = 'resist') AS resistance_count,
    count(*) FILTER (primitive = 'disagree') AS disagreement_count,
    arg_max(primitive, n) FILTER (primitive IS NOT NULL) AS last_behavior,
    coalesce(arg_max(confidence, n) FILTER (primitive IS NOT NULL), 0.0) AS behavior_confidence
  FROM w2 GROUP BY trajectory_id),
 state AS (SELECT st.*, coalesce(tc.duplicate_tool_calls, 0) AS duplicate_tool_calls,
    coalesce(tc.cross_agent_duplicate_actions, 0) AS cross_agent_duplicate_actions,
    coalesce(tc.tool_switches, 0) AS tool_switches, coalesce(tc.tool_failures, 0) AS tool_failures,
    coalesce(tail.c, 0) AS consecutive_tool_failures, coalesce(tc.recovery_count, 0) AS recovery_count,
    coalesce(tc.last_outcome = 'failed', false) AS unresolved,
    coalesce(tc.last_outcome = 'success' AND tc.tool_failures > 0, false) AS recovered, tc.last_tool_name
  FROM st LEFT JOIN tc USING (trajectory_id) LEFT JOIN tail USING (trajectory_id))"""


def _events(spark, sf):
    return drivers.trace_events(spark, sf)


def _state_view(name: str, columns: list[str]):
    @SECTION.add(name, f"WITH {_STATE_CTE} SELECT trajectory_id, {', '.join(columns)} FROM state")
    def run(spark, sf, columns=tuple(columns)):
        pieces = signals.in_pieces(_events(spark, sf)) if name == "c13_state" else None
        states = signals.state(_events(spark, sf)) if pieces is None else signals.state(pieces, F.col("piece"))
        return states.select("trajectory_id", *columns)


_state_view("c13_state", _STATE)
_state_view("c01_event_counts", ["event_count", "human_events", "agent_events", "tool_events"])
_state_view("c02_distinct_counts", ["conversation_count", "agent_count"])
_state_view("c03_agent_handoffs", ["agent_handoffs"])
_state_view("c05_cross_agent_duplicates", ["cross_agent_duplicate_actions"])
_state_view("c06_tool_switches", ["tool_switches"])
_state_view("c07_tool_failures", ["tool_failures"])
_state_view("c08_consecutive_failures", ["consecutive_tool_failures"])
_state_view("c09_recovery_count", ["recovery_count"])
_state_view("c10_resolution_flags", ["unresolved", "recovered"])
_state_view("c11_last_agent_and_tool", ["last_agent_id", "last_tool_name"])
_state_view("c12_behaviour_counters", _STATE[17:])


def _duplicates(window: int) -> str:
    near = " OR ".join(f"(lag(tool_name, {i}) OVER p = tool_name AND lag(v, {i}) OVER p = v)"
                       for i in range(1, window + 1))
    return f"""WITH {TRACE} SELECT trajectory_id, event_id, seq, tool_name, coalesce({near}, false) AS duplicate FROM te
  WHERE actor_type = 'tool' WINDOW p AS (PARTITION BY trajectory_id ORDER BY ts, seq)"""


@SECTION.add("c04_duplicate_tool_calls", _duplicates(1))
def _(spark, sf):
    return signals.duplicate_calls(_events(spark, sf))


@SECTION.add("c04_duplicate_tool_calls_last_3", _duplicates(3))
def _(spark, sf):
    return signals.duplicate_calls(_events(spark, sf), window=3)


_BEFORE = "(PARTITION BY trajectory_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@SECTION.add("c14_resolutions", f"""WITH {TRACE}, w AS (SELECT *,
    last_value(CASE WHEN actor_type = 'agent' THEN event_id END IGNORE NULLS) OVER {_BEFORE} AS agent_event_id FROM te)
  SELECT w.trajectory_id, w.event_id, w.tool_name, w.thread_id, w.goal_id, w.agent_event_id, a.actor_id AS agent_id
  FROM w LEFT JOIN te a ON a.event_id = w.agent_event_id WHERE w.actor_type = 'tool' AND w.status = 'success'""")
def _(spark, sf):
    return signals.resolutions(signals.in_pieces(_events(spark, sf)), F.col("piece"))


@SECTION.add("c15_agents", f"""WITH {TRACE}, w AS (SELECT *,
    last_value(CASE WHEN actor_type = 'agent' THEN actor_id END IGNORE NULLS) OVER {_BEFORE} AS cur FROM te),
  own AS (SELECT trajectory_id, actor_id AS agent_id, count(*) AS events FROM te WHERE actor_type = 'agent' GROUP BY 1, 2),
  after AS (SELECT trajectory_id, cur AS agent_id, count(*) FILTER (status = 'failed') AS f,
    count(*) FILTER (status = 'success') AS s FROM w WHERE actor_type = 'tool' AND cur IS NOT NULL GROUP BY 1, 2)
  SELECT trajectory_id, agent_id, events, coalesce(f, 0) AS tool_failures_after, coalesce(s, 0) AS tool_successes_after
  FROM own LEFT JOIN after USING (trajectory_id, agent_id)""")
def _(spark, sf):
    return signals.agents(signals.in_pieces(_events(spark, sf)), F.col("piece"))


@SECTION.add("c16_previous_text", f"""WITH {TRACE}, w AS (SELECT *, last_value(
    CASE WHEN actor_type IN ('human', 'agent') AND text <> '' THEN text END IGNORE NULLS) OVER {_BEFORE} AS p FROM te)
  SELECT trajectory_id, event_id, text, coalesce(p, '') AS previous_text FROM w WHERE actor_type = 'human'""")
def _(spark, sf):
    return signals.previous_text(_events(spark, sf))


@SECTION.add("c17_thread_recoveries", f"""WITH {TRACE}, o AS (SELECT trajectory_id, thread_id, status, lag(status) OVER (
    PARTITION BY trajectory_id, thread_id ORDER BY ts, seq) AS p FROM te WHERE status IN ('failed', 'success'))
  SELECT trajectory_id, thread_id, count(*) FILTER (status = 'success' AND p = 'failed') AS recoveries
  FROM o GROUP BY 1, 2""")
def _(spark, sf):
    return signals.thread_recoveries(_events(spark, sf))


@SECTION.add("c18_history_before_last_message", f"""WITH {TRACE}, t AS (SELECT trajectory_id,
    arg_max(event_id, (ts, seq)) AS target_id, arg_max(conversation_id, (ts, seq)) AS target_conversation,
    max(ts) AS target_ts FROM te WHERE actor_type = 'human' GROUP BY 1)
  SELECT trajectory_id, target_id, e.event_id, e.conversation_id = target_conversation AS local
  FROM te e JOIN t USING (trajectory_id) WHERE e.ts < t.target_ts""")
def _(spark, sf):
    e = _events(spark, sf)
    last = e.filter("actor_type = 'human'").groupBy("trajectory_id").agg(
        F.max_by(F.struct("event_id", "conversation_id", "ts"), F.struct("ts", "seq")).alias("t"))
    targets = last.select("trajectory_id", F.col("t.event_id").alias("target_id"),
                          F.col("t.conversation_id").alias("target_conversation"), F.col("t.ts").alias("target_ts"))
    return signals.history_of(e, targets).drop("ts")


@SECTION.add("c18_history_of_targets", f"""WITH {TRACE}, t AS (SELECT trajectory_id, arg_max(event_id, (ts, seq)) AS target_id,
    conversation_id AS target_conversation, max(ts) AS target_ts FROM te WHERE actor_type = 'human' GROUP BY trajectory_id, conversation_id)
  SELECT trajectory_id, target_id, e.event_id, e.conversation_id = target_conversation AS local
  FROM te e JOIN t USING (trajectory_id) WHERE e.ts < t.target_ts""")
def _(spark, sf):
    """The history of the last human message of every conversation."""
    e = _events(spark, sf)
    last = e.filter("actor_type = 'human'").groupBy("trajectory_id", "conversation_id").agg(
        F.max_by(F.struct("event_id", "ts"), F.struct("ts", "seq")).alias("t"))
    targets = last.select("trajectory_id", F.col("t.event_id").alias("target_id"),
                          F.col("conversation_id").alias("target_conversation"), F.col("t.ts").alias("target_ts"))
    return signals.history_of(e, targets).drop("ts")


@SECTION.add("c19_transitions", """SELECT conv_id, turn, text, previous_text FROM (
    SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_text FROM conversations)
  WHERE role = 'user' AND turn >= 1 AND previous_text IS NOT NULL""")
def _(spark, sf):
    c = drivers.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("trajectory_id"), "turn", "text",
        F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("actor_type"))
    return signals.transitions(c, "turn", F.floor(F.col("turn") / 1000)).select(
        F.col("trajectory_id").alias("conv_id"), "turn", "text", "previous_text")


@SECTION.add("c20_first_seen_providers", f"""WITH {TRACE}, f AS (SELECT trajectory_id, thread_id, provider,
    min((ts, seq)) AS p FROM te WHERE provider IS NOT NULL GROUP BY 1, 2, 3)
  SELECT trajectory_id, thread_id, string_agg(provider, '|' ORDER BY p) AS providers FROM f GROUP BY 1, 2""")
def _(spark, sf):
    from loomtrace.operators.rollups import first_seen
    provider = F.get_json_object("metadata_json", "$.provider")
    return first_seen(_events(spark, sf), provider, "providers").withColumn("providers", F.array_join("providers", "|"))


@SECTION.add("c21_late_events", f"""WITH {ORG}, w AS (SELECT *, max(occurred_at) OVER (PARTITION BY organization_id
    ORDER BY ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM oe)
  SELECT organization_id, event_id, coalesce(occurred_at < latest, false) AS late_event,
    coalesce(occurred_at < latest, false) AS history_disordered,
    coalesce(occurred_at < latest, false) AS recompute_recommended FROM w""")
def _(spark, sf):
    from loomtrace.operators.ingest import late_flags
    return late_flags(drivers.org_events(spark, sf)).select(
        "organization_id", "event_id", "late_event", "history_disordered", "recompute_recommended")


@SECTION.add("c22_import_order", f"""WITH {ORG} SELECT organization_id, event_id, coalesce(occurred_at, '') AS occurred_key,
    CASE WHEN try_cast(source_sequence AS BIGINT) IS NULL THEN 1 ELSE 0 END AS sequence_kind,
    try_cast(source_sequence AS BIGINT) AS sequence_number,
    CASE WHEN try_cast(source_sequence AS BIGINT) IS NULL THEN coalesce(source_sequence, '') ELSE '' END AS sequence_text
  FROM oe""")
def _(spark, sf):
    from loomtrace.operators.ingest import IMPORT_ORDER, import_key
    keyed = import_key(drivers.org_events(spark, sf))
    return keyed.orderBy(*IMPORT_ORDER).select("organization_id", *IMPORT_ORDER)


@SECTION.add("c23_recent_context", f"""WITH {TRACE}, r AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id
    ORDER BY ts DESC, seq DESC) AS n FROM te WHERE text <> '')
  SELECT trajectory_id, string_agg(text, '|' ORDER BY n DESC) AS recent_context FROM r WHERE n <= 8 GROUP BY 1""")
def _(spark, sf):
    said = _events(spark, sf).filter("text <> ''")
    top = ordered.top_rows(said, ["trajectory_id"], [F.desc("ts"), F.desc("seq")], 8)
    return top.groupBy("trajectory_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("ts", "seq", "text"))), lambda x: x["text"]), "|").alias("recent_context"))
