"""What follows from a stored log of routing decisions: states, deltas, signals, versions, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import audit, workstate
from loomtrace.operators.evaluate import histogram, score_band
from loomtrace.operators.gates import hybrid_gate
from loomtrace.plans.oracle import BASE, words
from loomtrace.plans.registry import Section
from loomtrace.session import durable, new_folder
from loomtrace.sources import drivers
from loomtrace.sources.tables import Snapshots

SECTION = Section()

LOG = f"""{BASE}, lw AS (SELECT *, 'tr_' || user_id || '_' || (event_id // 50) AS work FROM b),
  lf AS (SELECT work, min(event_id) AS first FROM lw WHERE k % 10 NOT IN (1, 2) GROUP BY 1),
  dl AS (SELECT 'org_' || (user_id % 3) AS organization_id, 'u' || user_id AS person_id, 'ev_' || event_id AS event_id, event_id AS arrival,
    CASE WHEN k % 10 = 2 THEN 'clarify' WHEN k % 10 = 1 THEN 'branch' WHEN event_id = first THEN 'new' ELSE 'attach' END AS decision,
    CASE WHEN k % 10 = 1 THEN 'br_' || event_id ELSE work END AS trajectory_id, CASE WHEN k % 10 = 1 THEN work END AS parent_id,
    (k % 31 + 70) / 100.0::DOUBLE AS confidence, ['rule', 'gate', 'judge'][k % 3 + 1] AS source, (k * 37 % 101) / 100.0::DOUBLE AS candidate_score,
    CASE WHEN k % 4 <> 0 THEN (k * 37 % 101) / 100.0::DOUBLE / 2 END AS second_score, 'rule_' || (k % 4) AS rules,
    {words(drivers.SURFACES)}[event_id % 3 + 1] AS surface, CASE WHEN k % 3 <> 0 THEN 'goal ' || (k % 5) ELSE '' END AS goal,
    CASE WHEN k % 4 <> 0 THEN 'note ' || k ELSE '' END AS problem, CASE WHEN k % 6 = 0 THEN 'try ' || (event_id % 2) END AS attempt,
    CASE WHEN k % 5 = 3 THEN 'err ' || (k % 2) END AS failure, CASE WHEN k % 7 = 0 THEN 'q ' || (event_id % 3) END AS question, 'c' || (k % 3) AS conv, k
    FROM lw LEFT JOIN lf USING (work)), a AS (SELECT * FROM dl WHERE decision <> 'clarify')"""

_NEW = ", ".join(f"CASE WHEN {c} IS NOT NULL AND row_number() OVER (PARTITION BY trajectory_id, {c} ORDER BY arrival) = 1 THEN 1 ELSE 0 END AS n_{c}"
                 for c in ("attempt", "failure", "question", "surface", "conv"))
DELTAS = f"""{LOG}, fa AS (SELECT *, {_NEW} FROM a),
  nw AS (SELECT *, row_number() OVER o AS version, first_value(nullif(goal, '') IGNORE NULLS) OVER o AS durable_goal,
    last_value(nullif(problem, '') IGNORE NULLS) OVER o AS current_state, sum(n_attempt) OVER o AS attempts, sum(n_failure) OVER o AS failures,
    sum(n_question) OVER o AS questions, sum(n_surface) OVER o AS surfaces FROM fa
    WINDOW o AS (PARTITION BY trajectory_id ORDER BY arrival ROWS UNBOUNDED PRECEDING)),
  dt AS (SELECT *, coalesce(lag(surfaces) OVER w, 0) AS before, durable_goal IS DISTINCT FROM lag(durable_goal) OVER w AS cg,
    current_state IS DISTINCT FROM lag(current_state) OVER w AS cs FROM nw WINDOW w AS (PARTITION BY trajectory_id ORDER BY arrival)),
  dc AS (SELECT *, concat_ws('|', CASE WHEN version = 1 THEN 'lifecycle' END, CASE WHEN cg THEN 'durable_goal' END, CASE WHEN cs THEN 'current_state' END,
    CASE WHEN n_question > 0 THEN 'open_questions' END, CASE WHEN n_attempt > 0 THEN 'attempts' END, CASE WHEN n_failure > 0 THEN 'failures' END,
    CASE WHEN n_surface > 0 THEN 'surfaces' END, CASE WHEN n_conv > 0 THEN 'conversation_ids' END,
    CASE WHEN problem <> '' OR parent_id IS NOT NULL THEN 'recent_context' END) AS changed FROM dt)"""


def assigned(spark, sf):
    d = drivers.decision_log(spark, sf)
    return workstate.assigned(d.drop("decision", "trajectory_id", "parent_id", "added_anchors"), d).withColumn("surface_name", F.element_at("surface", 1))


@SECTION.add("i1_work_states", f"""WITH {LOG}, core AS (SELECT organization_id, trajectory_id, arg_min(person_id, arrival) AS person_id,
    coalesce(arg_min(goal, arrival) FILTER (goal <> ''), '') AS durable_goal, coalesce(arg_max(problem, arrival) FILTER (problem <> ''), '') AS current_state,
    count(*) AS version FROM a GROUP BY 1, 2),
  su AS (SELECT trajectory_id, string_agg(surface, '|' ORDER BY f) AS surfaces FROM (SELECT trajectory_id, surface, min(arrival) AS f FROM a GROUP BY 1, 2) GROUP BY 1),
  at AS (SELECT trajectory_id, string_agg(attempt, '|' ORDER BY f) AS attempts FROM (SELECT trajectory_id, attempt, min(arrival) AS f FROM a
    WHERE attempt IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  cl AS (SELECT trajectory_id, arrival::DOUBLE AS p, problem AS line FROM a WHERE problem <> '' UNION ALL
    SELECT trajectory_id, arrival - 0.5, 'branched from ' || parent_id FROM a WHERE parent_id IS NOT NULL),
  cx AS (SELECT trajectory_id, string_agg(line, '|' ORDER BY p) AS recent_context FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY p DESC) AS n
    FROM cl) WHERE n <= 8 GROUP BY 1)
  SELECT core.*, coalesce(surfaces, '') AS surfaces, coalesce(attempts, '') AS attempts, coalesce(recent_context, '') AS recent_context
  FROM core LEFT JOIN su USING (trajectory_id) LEFT JOIN at USING (trajectory_id) LEFT JOIN cx USING (trajectory_id)""".replace(" at AS (", " tries AS (").replace("JOIN at USING", "JOIN tries USING"))
def _(spark, sf):
    return _shown(workstate.work_states(assigned(spark, sf)))


def _shown(states):
    return states.select("organization_id", "trajectory_id", "person_id", "durable_goal", "current_state", "version",
                         *(F.array_join(c, "|").alias(c) for c in ("surfaces", "attempts", "recent_context")))


@SECTION.add("i1_snapshot_and_later_log", SECTION["i1_work_states"].oracle)
def _(spark, sf):
    """Three parts of the log: each is merged into the stored summary of what came before, of which only the snapshot is read."""
    rows, store = durable(assigned(spark, sf)), Snapshots(spark, new_folder(spark))
    borders = rows.stat.approxQuantile("arrival", [1 / 3, 2 / 3], 0.001)
    for low, high in zip([None, *borders], [*borders, None]):
        part = rows.filter((F.lit(True) if low is None else F.col("arrival") > low) & (F.lit(True) if high is None else F.col("arrival") <= high))
        new = workstate.summarized(part)
        if store.latest():
            new = workstate.merged(workstate.StateSummary(**{n: store.read(n) for n in new.tables()}), new)
        store.save(new.tables())
    return _shown(workstate.states_of(workstate.StateSummary(**{n: store.read(n) for n in new.tables()})))


@SECTION.add("a6_latest_committed_states", SECTION["i1_work_states"].oracle)
def _(spark, sf):
    """Work states with their anchors saved, replaced, and read back; a third version that never got its manifest is not seen."""
    rows, store = assigned(spark, sf), Snapshots(spark, new_folder(spark))
    store.save({"states": workstate.work_states(rows.filter("arrival % 2 = 0"))})
    store.save({"states": workstate.work_states(rows)})
    store.write({"states": workstate.work_states(rows.filter("arrival % 3 = 0"))})
    return _shown(store.read("states"))


@SECTION.add("i3_structural_deltas", f"WITH {DELTAS} SELECT event_id, trajectory_id, version, version = 1 AS created, changed FROM dc")
def _(spark, sf):
    d = workstate.structural_deltas(assigned(spark, sf))
    return d.select("event_id", "trajectory_id", "version", (F.col("version") == 1).alias("created"), F.array_join("changed", "|").alias("changed"))


@SECTION.add("i4_structural_signals", f"""WITH {DELTAS}, sg AS (SELECT organization_id, event_id, trajectory_id, unnest([
    {{'signal': 'trajectory_created', 'value': (version = 1)::VARCHAR}}, {{'signal': 'state_changed', 'value': (changed <> '')::VARCHAR}},
    {{'signal': 'durable_goal_changed', 'value': cg::VARCHAR}}, {{'signal': 'structurally_inert', 'value': (changed = '')::VARCHAR}},
    {{'signal': 'failure_count', 'value': failures::VARCHAR}}, {{'signal': 'attempt_count', 'value': attempts::VARCHAR}},
    {{'signal': 'unresolved_question_count', 'value': questions::VARCHAR}}, {{'signal': 'surface_count', 'value': surfaces::VARCHAR}},
    {{'signal': 'cross_surface_continuation', 'value': (version > 1 AND before > 0 AND surfaces > before)::VARCHAR}}]) AS s FROM dc)
  SELECT organization_id, event_id, trajectory_id, s.signal AS signal, s.value AS value, 'L1' AS maturity, '{workstate.TAXONOMY_VERSION}' AS taxonomy_version,
    '{workstate.taxonomy_digest()}' AS taxonomy_sha256, '{workstate.PRODUCER_VERSION}' AS producer_version, 'event:' || event_id AS evidence FROM sg""")
def _(spark, sf):
    return workstate.structural_signals(workstate.structural_deltas(assigned(spark, sf)))


@SECTION.add("i5_trajectory_versions", f"WITH {LOG} SELECT organization_id, trajectory_id, count(*) AS version, max(arrival) AS last_arrival FROM a GROUP BY 1, 2")
def _(spark, sf):
    return assigned(spark, sf).groupBy("organization_id", "trajectory_id").agg(F.count("*").alias("version"), F.max("arrival").alias("last_arrival"))


@SECTION.add("i6_proposals", """SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 5 = 4 THEN 'rejected' WHEN o_orderkey % 5 = 3 THEN 'pending'
    WHEN (o_orderkey % 4 <> 0 AND o_custkey % 3 = 0) OR o_orderkey % 7 = 0 THEN 'stale' ELSE 'confirmed' END AS status FROM orders""")
def _(spark, sf):
    o = drivers.table(spark, sf, "orders")
    key, s = F.col("o_orderkey"), lambda c: c.cast("string")
    org = F.lit("org").alias("organization_id")
    tid = F.when(key % 4 != 0, F.concat(F.lit("t"), s(F.col("o_custkey"))))
    d = o.select(org, key.alias("event_id"), F.when(key % 4 == 0, "new").otherwise("attach").alias("decision"), tid.alias("trajectory_id"))
    before = o.select(org, F.concat(F.lit("t"), s(F.col("o_custkey"))).alias("trajectory_id")).distinct().withColumn("version", F.lit(1))
    after = before.withColumn("version", F.when(F.substring("trajectory_id", 2, 20).cast("long") % 3 == 0, 2).otherwise(1))
    actions = o.filter(key % 5 != 3).select(org, key.alias("event_id"), F.when(key % 5 == 4, "reject").otherwise("confirm").alias("action"),
                                           F.lit(1).alias("at"))
    fresh = d.withColumn("decision", F.when(F.col("event_id") % 7 == 0, "clarify").otherwise(F.col("decision")))
    return audit.resolve_proposals(audit.proposals(d, before), actions, after, fresh).select("event_id", "status")


@SECTION.add("i8_instrumentation", f"""WITH {LOG}, v AS (SELECT trajectory_id, count(*) AS n FROM a GROUP BY 1)
  SELECT organization_id, event_id, 'v1' AS instrumentation_version, n AS trajectory_version, decision, source, confidence, candidate_score,
    round(second_score, 6) AS second_score, round(candidate_score - second_score, 6) AS margin, rules FROM dl LEFT JOIN v USING (trajectory_id)""")
def _(spark, sf):
    d = drivers.decision_log(spark, sf)
    versions = d.filter("decision <> 'clarify'").groupBy("organization_id", "trajectory_id").agg(F.count("*").alias("version"))
    out = audit.instrumentation(d.withColumn("margin", F.col("candidate_score") - F.col("second_score")), versions)
    return out.withColumns({"rules": F.array_join("rules", "|"), **{c: F.round(c, 6) for c in ("second_score", "margin")}})


@SECTION.add("i11_gated_clarifications", f"""WITH {LOG}, st AS (SELECT trajectory_id, arg_max(problem, arrival) FILTER (problem <> '') AS state FROM a GROUP BY 1),
  op AS (SELECT event_id, ['attach', 'new', 'abstain', 'branch'][arrival % 4 + 1] AS action, (arrival % 31 + 70) / 100.0::DOUBLE AS c, trajectory_id, st.trajectory_id IS NOT NULL AS known,
    coalesce(dl.problem = st.state, false) AS exact FROM dl LEFT JOIN st USING (trajectory_id) WHERE decision = 'clarify'),
  g AS (SELECT *, CASE WHEN action = 'abstain' THEN 'model_abstained' WHEN action = 'new' THEN CASE WHEN c >= 0.80 THEN 'high_confidence_new' ELSE 'low_confidence_new' END
    WHEN NOT known THEN 'candidate_missing' WHEN action = 'attach' THEN CASE WHEN exact AND c >= 0.75 THEN 'exact_anchor_support' ELSE 'attach_lacks_structural_support' END
    ELSE CASE WHEN exact AND c >= 0.80 THEN 'branch_anchor_support' ELSE 'branch_lacks_structural_support' END END AS gate_reason FROM op)
  SELECT event_id, gate_reason, CASE WHEN gate_reason IN ('high_confidence_new', 'exact_anchor_support', 'branch_anchor_support') THEN action ELSE 'clarify' END AS gated_action,
    CASE WHEN gate_reason IN ('exact_anchor_support', 'branch_anchor_support') THEN trajectory_id END AS gated_candidate FROM g""".replace("st.trajectory_id IS NOT NULL", "st.has IS NOT NULL").replace(
    "AS state FROM a GROUP BY 1)", "AS state, 1 AS has FROM a GROUP BY 1)"))
def _(spark, sf):
    """Clarified events decided by stored opinions; the candidate's current state being the event's own words is the exact anchor."""
    d = drivers.decision_log(spark, sf)
    states = d.filter("decision <> 'clarify'").groupBy("trajectory_id").agg(
        F.max_by("problem", F.when(F.col("problem") != "", F.col("arrival"))).alias("state"), F.lit(True).alias("known"))
    rows = d.filter("decision = 'clarify'").join(states, "trajectory_id", "left").select(
        "event_id", drivers.pick(["attach", "new", "abstain", "branch"], F.col("arrival") % 4).alias("action"),
        ((F.col("arrival") % 31 + 70) / 100.0).alias("confidence"), F.col("trajectory_id").alias("candidate_id"),
        F.col("known").alias("candidate_known"), (F.col("problem") == F.col("state")).alias("exact_anchor"))
    return hybrid_gate(rows).select("event_id", "gate_reason", "gated_action", "gated_candidate")


@SECTION.add("h17_product_outcomes", """WITH p AS (SELECT l_orderkey AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'note ' || (l_partkey % 3)
    ELSE 'deployment_validation=' || CASE WHEN l_suppkey % 5 = 0 THEN 'success' ELSE 'failed' END END AS outcome, l_linenumber % 2 = 1 AND l_suppkey % 5 = 0
    AS ok, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS pos FROM lineitem),
  f AS (SELECT t, outcome, min(pos) AS pos FROM p GROUP BY 1, 2), g AS (SELECT t, string_agg(outcome, '|' ORDER BY pos) AS new_outcomes FROM f
    WHERE outcome <> 'note 1' GROUP BY 1), d AS (SELECT t, bool_or(ok) AS ok FROM p GROUP BY 1)
  SELECT o_orderkey::VARCHAR AS trajectory_id, 'note 1' || coalesce('|' || new_outcomes, '') AS outcomes, CASE WHEN coalesce(ok, false) THEN 'resolved' ELSE 'active' END AS lifecycle,
    CASE WHEN coalesce(ok, false) THEN 'deployment validated successfully' ELSE o_orderstatus END AS current_state
  FROM orders LEFT JOIN g ON g.t = o_orderkey LEFT JOIN d ON d.t = o_orderkey""")
def _(spark, sf):
    li, odd = drivers.table(spark, sf, "lineitem"), F.col("l_linenumber") % 2 == 1
    p = li.select(F.lit("org").alias("organization_id"), F.col("l_orderkey").cast("string").alias("trajectory_id"),
                  F.when(odd, "deployment_validation").otherwise("comment").alias("event_name"),
                  F.when(F.col("l_suppkey") % 5 == 0, "success").otherwise("failed").alias("status"),
                  F.when(odd, " ").otherwise(F.concat(F.lit("note "), (F.col("l_partkey") % 3).cast("string"))).alias("description"),
                  (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("at"))
    states = drivers.table(spark, sf, "orders").select(
        F.lit("org").alias("organization_id"), F.col("o_orderkey").cast("string").alias("trajectory_id"), F.array(F.lit("note 1")).alias("outcomes"),
        F.lit("active").alias("lifecycle"), F.col("o_orderstatus").alias("current_state"), F.array().cast("array<string>").alias("recent_context"))
    return workstate.product_outcomes(states, p).select("trajectory_id", F.array_join("outcomes", "|").alias("outcomes"), "lifecycle", "current_state")


@SECTION.add("d7a_decision_counts", f"""WITH {LOG}, x AS (SELECT unnest([{{'d': 'decision', 'v': decision}}, {{'d': 'clarify_source', 'v': CASE WHEN decision = 'clarify' THEN source ELSE 'none' END}},
    {{'d': 'rules', 'v': rules}}]) AS x FROM dl) SELECT x.d AS dimension, x.v AS value, count(*) AS events FROM x GROUP BY 1, 2""")
def _(spark, sf):
    """Decisions, clarifications by source and rule counts."""
    d = drivers.decision_log(spark, sf)
    return histogram(d, {"decision": F.col("decision"), "clarify_source": F.when(F.col("decision") == "clarify", F.col("source")),
                         "rules": F.array_join("rules", "|")})


def _band(c):
    return f"CASE WHEN {c} IS NULL THEN 'missing' WHEN {c} < 0.12 THEN '<.12' WHEN {c} < 0.30 THEN '.12-.30' WHEN {c} < 0.50 THEN '.30-.50' WHEN {c} < 0.70 THEN '.50-.70' ELSE '>=.70' END"


@SECTION.add("k16_clarification_diagnostics", f"""WITH {LOG}, x AS (SELECT unnest([{{'d': 'top_score', 'v': {_band('candidate_score')}}},
    {{'d': 'margin', 'v': {_band('(candidate_score - second_score)')}}}, {{'d': 'source', 'v': source}}]) AS x FROM dl WHERE decision = 'clarify')
  SELECT x.d AS dimension, x.v AS value, count(*) AS events FROM x GROUP BY 1, 2""")
def _(spark, sf):
    d = drivers.decision_log(spark, sf).filter("decision = 'clarify'")
    return histogram(d, {"top_score": score_band(F.col("candidate_score")), "margin": score_band(F.col("candidate_score") - F.col("second_score")),
                         "source": F.col("source")})
