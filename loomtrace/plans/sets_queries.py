"""Unions, equivalence, samples and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import audit, corpus, ordered, retrieval, workstate
from loomtrace.plans.registry import Section
from loomtrace.sources import drivers

SECTION = Section()


@SECTION.add("f4_candidate_union", """WITH u AS (SELECT l_orderkey AS event_id, 't' || (l_partkey % 5) AS trajectory_id,
    CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS r FROM lineitem)
  SELECT event_id, trajectory_id, min(r) AS source_rank FROM u GROUP BY 1, 2""")
def _(spark, sf):
    li = drivers.table(spark, sf, "lineitem")
    rows = li.select("l_returnflag", F.col("l_orderkey").alias("event_id"),
                     F.concat(F.lit("t"), (F.col("l_partkey") % 5).cast("string")).alias("trajectory_id"))
    own, rescue = rows.filter("l_returnflag = 'N'"), rows.filter("l_returnflag <> 'N'")
    return retrieval.union_candidates(own.drop("l_returnflag"), rescue.drop("l_returnflag"))


def _customer_states(spark, sf, shift=0):
    """A work state per customer from its orders."""
    empty = F.array().cast("array<string>")
    o = drivers.table(spark, sf, "orders").withColumn("status", F.when(
        (F.col("o_orderkey") % 997 == 1) & F.lit(shift > 0), "X").otherwise(F.col("o_orderstatus")))
    distinct = o.select("o_custkey", "o_orderpriority", "status").distinct().groupBy("o_custkey").agg(
        F.sort_array(F.collect_set("o_orderpriority"), asc=shift == 0).alias("entities"),
        F.sort_array(F.collect_set("status"), asc=shift == 0).alias("outcomes"))
    last = o.groupBy("o_custkey").agg(F.max_by("status", "o_orderkey").alias("current_state"), F.min_by("o_orderpriority", "o_orderkey").alias("durable_goal"))
    rest = ["artifacts", "open_questions", "resolved_questions", "decisions", "attempts", "failures", "surfaces", "conversation_ids", "recent_context"]
    return distinct.join(last, "o_custkey").select(
        F.lit("org").alias("organization_id"), F.col("o_custkey").cast("string").alias("trajectory_id"), "durable_goal", "current_state",
        F.lit("active").alias("lifecycle"), "entities", "outcomes", *[empty.alias(c) for c in rest],
        F.array().cast("array<struct<type:string,value:string,strength:string>>").alias("anchors"))


@SECTION.add("f5_state_set_equivalence", """WITH o AS (SELECT *, CASE WHEN o_orderkey % 997 = 1 THEN 'X' ELSE o_orderstatus END AS s2 FROM orders),
  s AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS a_state, arg_max(s2, o_orderkey) AS b_state,
    arg_min(o_orderpriority, o_orderkey) AS goal, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS ents,
    string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS a_out, string_agg(DISTINCT s2, ',' ORDER BY s2) AS b_out FROM o GROUP BY 1),
  a AS (SELECT goal, ents, a_state AS st, a_out AS ou, count(*) AS n FROM s GROUP BY ALL),
  b AS (SELECT goal, ents, b_state AS st, b_out AS ou, count(*) AS n FROM s GROUP BY ALL)
  SELECT coalesce(a.n, 0) AS left_count, coalesce(b.n, 0) AS right_count, count(*) AS states FROM a FULL JOIN b USING (goal, ents, st, ou)
    WHERE coalesce(a.n, 0) <> coalesce(b.n, 0) GROUP BY 1, 2""")
def _(spark, sf):
    d = workstate.set_difference(_customer_states(spark, sf), _customer_states(spark, sf, 1))
    return d.groupBy("left_count", "right_count").agg(F.count("*").alias("states"))


@SECTION.add("f5_field_differences", """WITH o AS (SELECT *, CASE WHEN o_orderkey % 997 = 1 THEN 'X' ELSE o_orderstatus END AS s2 FROM orders),
  s AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS a_state, arg_max(s2, o_orderkey) AS b_state,
    string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS a_out, string_agg(DISTINCT s2, ',' ORDER BY s2) AS b_out FROM o GROUP BY 1)
  SELECT o_custkey::VARCHAR AS trajectory_id, 'current_state' AS field FROM s WHERE a_state <> b_state
  UNION ALL SELECT o_custkey::VARCHAR, 'outcomes' FROM s WHERE a_out <> b_out""")
def _(spark, sf):
    d = workstate.field_differences(_customer_states(spark, sf), _customer_states(spark, sf, 1), ["trajectory_id"],
                                    ["durable_goal", "current_state", "lifecycle", "entities", "outcomes"])
    return d.select("trajectory_id", "field")


@SECTION.add("f6_judge_view", """WITH o AS (SELECT *, lower(o_orderpriority) AS k, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority)
    ELSE ' ' || o_orderpriority || ' ' END AS raw FROM orders), f AS (SELECT o_custkey, k, arg_min(trim(raw), o_orderkey) AS v, min(o_orderkey) AS p
    FROM o GROUP BY 1, 2) SELECT o_custkey AS trajectory_id, string_agg(v, '|' ORDER BY p) AS entities FROM f GROUP BY 1""")
def _(spark, sf):
    from loomtrace.functions.text import unique_ignoring_case
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
    firsts = drivers.table(spark, sf, "orders").select("o_custkey", "o_orderkey", raw.alias("v")).groupBy("o_custkey", "v").agg(
        F.min("o_orderkey").alias("p"))
    listed = firsts.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("l"))
    return listed.select(F.col("o_custkey").alias("trajectory_id"), F.array_join(unique_ignoring_case(F.col("l")), "|").alias("entities"))


@SECTION.add("b21_context_pack", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders),
  s AS (SELECT o_custkey, string_agg('- ' || o_orderkey, chr(10) ORDER BY n DESC) FILTER (n <= 6) AS ctx, max(o_orderstatus) FILTER (n = 1) AS st
    FROM r GROUP BY 1)
  SELECT o_custkey::VARCHAR AS trajectory_id, 'CURRENT STATE' || chr(10) || st || chr(10) || chr(10) || 'LIFECYCLE' || chr(10) || 'active' || chr(10) ||
    chr(10) || 'RECENT EVOLUTION' || chr(10) || ctx AS prompt FROM s""")
def _(spark, sf):
    o = drivers.table(spark, sf, "orders")
    last = ordered.top_rows(o, ["o_custkey"], [F.desc("o_orderkey")], 8).groupBy("o_custkey").agg(F.transform(
        F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")).alias("recent_context"))
    state = o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("current_state")).join(last, "o_custkey")
    empty = F.array().cast("array<string>")
    lists = ["entities", "artifacts", "open_questions", "decisions", "attempts", "failures", "outcomes"]
    full = state.select(F.col("o_custkey").cast("string").alias("trajectory_id"), F.lit("").alias("durable_goal"), "current_state",
                        F.lit("active").alias("lifecycle"), *[empty.alias(c) for c in lists], "recent_context")
    return workstate.context_pack(full).select("trajectory_id", "prompt")


@SECTION.add("g4_audit_sample", """WITH s AS (SELECT o_orderkey::VARCHAR AS event_id, o_orderstatus AS pred, o_orderpriority AS gold FROM orders
    ORDER BY o_orderkey::VARCHAR LIMIT 20)
  SELECT 'audit_' || lpad((row_number() OVER (ORDER BY event_id))::VARCHAR, 3, '0') AS audit_id, event_id, pred AS predicted, gold AS gold_hidden FROM s""")
def _(spark, sf):
    rows = drivers.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderstatus").alias("pred"),
                                                     F.col("o_orderpriority").alias("gold"), F.lit("fold").alias("source"))
    return audit.audit_sample(rows).select("audit_id", "event_id", "predicted", "gold_hidden")


@SECTION.add("g5_clarification_options", """WITH t AS (SELECT o_custkey, o_orderpriority AS tr, min(o_orderkey) AS created FROM orders GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY created, tr) AS n FROM t), e AS (SELECT o_orderkey AS event_id, o_custkey,
    o_orderpriority AS tr FROM orders )
  SELECT event_id, 'attach' AS action, r.tr AS option_trajectory, n AS position FROM e JOIN r USING (o_custkey) WHERE n <= 5
  UNION ALL SELECT event_id, 'new', NULL, 6 FROM e UNION ALL SELECT event_id, 'branch', tr, 7 FROM e""")
def _(spark, sf):
    o = drivers.table(spark, sf, "orders").select(
        F.lit("org").alias("organization_id"), F.lit("ws").alias("workspace_id"), F.col("o_custkey").alias("person_id"),
        F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("trajectory_id"), "o_orderstatus")
    t = o.groupBy("organization_id", "workspace_id", "person_id", "trajectory_id").agg(F.min("event_id").alias("created")).withColumns(
        {"durable_goal": F.lit(""), "current_state": F.col("trajectory_id")})
    return audit.clarification_options(o, t).select("event_id", "action", "option_trajectory", "position")


@SECTION.add("g6_sampled_transitions", """SELECT conv_id, turn, text FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p
    FROM conversations) WHERE role = 'user' AND turn >= 1 AND p IS NOT NULL AND substr(sha256(conv_id || ':' || turn), 1, 2) < '40'""")
def _(spark, sf):
    from loomtrace.operators import signals
    c = drivers.table(spark, sf, "conversations").select(F.col("conv_id").alias("trajectory_id"), "turn", "text", F.when(
        F.col("role") == "user", "human").otherwise(F.col("role")).alias("actor_type"))
    t = signals.transitions(c, "turn", F.floor(F.col("turn") / 1000))
    return signals.sampled(t, F.concat_ws(":", "trajectory_id", "turn"), 0.25).select(F.col("trajectory_id").alias("conv_id"), "turn", "text")


@SECTION.add("k11_derangement", """WITH h AS (SELECT doc_id, text, sha256(doc_id::VARCHAR) AS h FROM documents),
  n AS (SELECT doc_id, coalesce(lead(doc_id) OVER (ORDER BY h), first_value(doc_id) OVER (ORDER BY h)) AS other FROM h)
  SELECT doc_id, other AS shuffled_from, doc_id = other AS self FROM n""")
def _(spark, sf):
    d = drivers.table(spark, sf, "documents").select("doc_id")
    out = corpus.derangement(d, "doc_id", F.col("doc_id"), "shuffled_from")
    return out.withColumn("self", F.col("doc_id") == F.col("shuffled_from"))
