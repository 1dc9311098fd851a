"""Metrics of linkage decisions, clustering, opinions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import audit, evaluate, gates, linkage
from loomtrace.plans.gates_queries import (ASSESS, GATED_MODAL, LINKED, MODAL, NEW_REASON, PAIRED, PAIRS, ROUTED, SAFE, gated_rows, paired,
                                           routed_cases, safe_rows)
from loomtrace.plans.registry import Section
from loomtrace.session import durable
from loomtrace.sources import drivers

SECTION = Section()

_HYBRID = f"""{PAIRS}, hy AS (SELECT *, CASE WHEN coalesce(ic <> cc, false) OR coalesce(ir <> cr, false) OR coalesce(it <> ct, false) THEN 'new'
    WHEN br THEN 'branch' WHEN co AND unresolved THEN 'attach' WHEN co THEN 'uncertain' WHEN score >= 0.72 THEN 'attach'
    WHEN score >= 0.40 THEN 'uncertain' WHEN score < 0.20 THEN 'new' ELSE 'uncertain' END AS d FROM cp)"""


def _hybrid(spark, sf):
    return linkage.hybrid(drivers.candidate_pairs(spark, sf)).select(
        "case_id", "candidate_id", "category", F.col("expected_decision").alias("expected"), F.col("decision").alias("predicted"))


_R = "round(CASE WHEN {1} > 0 THEN {0} / {1} ELSE {2} END, 6)"


def ratio(a, b, default="0.0"):
    return _R.format(a, b, default)


_K1 = """count(*) AS cases, count(*) FILTER (expected_decision = d) AS correct, count(*) FILTER (expected_decision IN ('new', 'branch') AND d = 'attach')
  AS false_merges, count(*) FILTER (expected_decision = 'attach' AND d = 'new') AS false_splits"""


@SECTION.add("k1_linkage_metrics", f"WITH {_HYBRID} SELECT category, {_K1}, {ratio('count(*) FILTER (expected_decision = d)', 'count(*)')} AS accuracy FROM hy GROUP BY 1")
def _(spark, sf):
    return evaluate.linkage_metrics(_hybrid(spark, sf), ["category"])


@SECTION.add("k1_confusion", f"WITH {_HYBRID} SELECT expected_decision AS expected, d AS predicted, count(*) AS cases FROM hy GROUP BY 1, 2")
def _(spark, sf):
    return evaluate.confusion(_hybrid(spark, sf))


_DEC = "count(*) FILTER (d <> 'uncertain')"
_COR = "count(*) FILTER (d <> 'uncertain' AND d = expected_decision)"


@SECTION.add("k2_selective_metrics", f"""WITH {_HYBRID} SELECT category, count(*) AS cases, {_DEC} AS decided, count(*) - {_DEC} AS abstained, {_COR} AS correct,
    count(*) FILTER (d = 'attach' AND expected_decision <> 'attach') AS false_merges, {ratio(_DEC, 'count(*)')} AS coverage, {ratio(_COR, _DEC)} AS precision
  FROM hy GROUP BY 1""")
def _(spark, sf):
    return evaluate.selective_metrics(_hybrid(spark, sf), ["category"])


_K3 = f"""{ROUTED}, ex AS (SELECT r.*, CASE WHEN r.expected_decision <> 'new' THEN g.first_candidate END AS expected_candidate FROM routed r
    JOIN (SELECT case_id, min(candidate_id) AS first_candidate FROM lk GROUP BY 1) g USING (case_id)),
  ok AS (SELECT *, decision <> 'uncertain' AS dec, coalesce(chosen = expected_candidate, false) AS hit, expected_candidate IS NOT NULL AS need FROM ex),
  rg AS (SELECT *, dec AND decision = expected_decision AND (NOT need OR hit) AS r FROM ok)"""


def _expected(spark, sf):
    first = drivers.candidate_pairs(spark, sf).groupBy("case_id").agg(F.min("candidate_id").alias("first_candidate"))
    return routed_cases(spark, sf).join(first, "case_id").withColumn(
        "expected_candidate", F.when(F.col("expected_decision") != "new", F.col("first_candidate")))


@SECTION.add("k3_candidate_metrics", f"""WITH {_K3} SELECT category, count(*) AS cases, count(*) FILTER (dec) AS decided, count(*) FILTER (NOT dec) AS abstained,
    count(*) FILTER (r) AS correct, count(*) FILTER (r AND need) AS correct_candidate, count(*) FILTER (NOT r AND decision = 'attach' AND
      (expected_decision <> 'attach' OR (need AND NOT hit))) AS false_merges, count(*) FILTER (decision = 'new' AND expected_decision = 'attach') AS false_splits,
    {ratio('count(*) FILTER (dec)', 'count(*)')} AS coverage, {ratio('count(*) FILTER (r)', 'count(*) FILTER (dec)')} AS precision FROM rg GROUP BY 1""")
def _(spark, sf):
    return evaluate.candidate_metrics(_expected(spark, sf), ["category"])


@SECTION.add("k3_abstained_cases", f"WITH {ROUTED} SELECT case_id, category, top_candidate, top_score, second_score FROM routed WHERE decision = 'uncertain'")
def _(spark, sf):
    return routed_cases(spark, sf).filter("decision = 'uncertain'").select("case_id", "category", "top_candidate", "top_score", "second_score")


@SECTION.add("k14_escalation_export", f"""WITH {_HYBRID} SELECT case_id, candidate_id, score, round((SELECT count(*) FILTER (d = 'uncertain') / count(*) FROM hy), 6)
    AS escalation_rate FROM hy WHERE d = 'uncertain'""")
def _(spark, sf):
    p = durable(linkage.hybrid(drivers.candidate_pairs(spark, sf)).select("case_id", "candidate_id", "score", "decision"))
    rate = p.agg(F.round(F.count_if(F.col("decision") == "uncertain") / F.count("*"), 6).alias("escalation_rate"))
    return p.filter("decision = 'uncertain'").select("case_id", "candidate_id", "score").join(F.broadcast(rate))  # one row


def _clusters(spark, sf):
    li = drivers.table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("g"), (F.col("l_partkey") % 300).cast("string")).alias("gold"),
        F.concat(F.lit("p"), F.when(F.col("l_suppkey") % 10 == 0, F.col("l_partkey") % 100).otherwise(F.col("l_partkey") % 300).cast("string")).alias("pred"),
        F.when(F.col("l_linenumber") % 4 == 0, "clarify").otherwise("attach").alias("decision"))


_CL = """c AS (SELECT 'g' || (l_partkey % 300) AS gold, 'p' || CASE WHEN l_suppkey % 10 = 0 THEN l_partkey % 100 ELSE l_partkey % 300 END AS pred
    FROM lineitem {0}), t AS (SELECT gold, pred, count(*) AS n FROM c GROUP BY 1, 2),
  x AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS tp, count(DISTINCT gold) AS gg, count(DISTINCT pred) AS pp FROM t),
  g AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS s FROM (SELECT sum(n)::BIGINT AS n FROM t GROUP BY gold)),
  p AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS s FROM (SELECT sum(n)::BIGINT AS n FROM t GROUP BY pred))
  SELECT gg AS gold_groups, pp AS pred_groups, tp AS true_pairs, p.s - tp AS false_merge_pairs, g.s - tp AS false_split_pairs,
    round(tp / p.s, 6) AS pair_precision, round(tp / g.s, 6) AS pair_recall FROM x, g, p"""


@SECTION.add("k4_pairwise_clustering", "WITH " + _CL.format(""))
def _(spark, sf):
    return evaluate.pair_counts(_clusters(spark, sf), "gold", "pred")


@SECTION.add("k4_committed_pairs", "WITH " + _CL.format("WHERE l_linenumber % 4 <> 0"))
def _(spark, sf):
    return evaluate.pair_counts(_clusters(spark, sf).filter("decision <> 'clarify'"), "gold", "pred")


_REPLAY = """r AS (SELECT event_id AS arrival, user_id::VARCHAR AS gold_work, CASE WHEN event_id % 13 = 0 THEN 'clarify' WHEN row_number() OVER w = 1 THEN 'new'
      ELSE 'attach' END AS gold_relation, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'clarify' WHEN row_number() OVER w = 1 THEN 'new'
      ELSE 'attach' END AS decision, 't' || CASE WHEN event_id % 101 = 0 THEN user_id + 1 ELSE user_id END AS trajectory_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  f AS (SELECT gold_work, arg_min(trajectory_id, arrival) AS known, min(arrival) AS known_at FROM r WHERE gold_relation = 'new' AND decision = 'new' GROUP BY 1),
  c AS (SELECT r.*, CASE gold_relation WHEN 'clarify' THEN decision = 'clarify' WHEN 'new' THEN decision = 'new'
    ELSE coalesce(decision = 'attach' AND known = trajectory_id AND known_at < arrival, false) END AS correct FROM r LEFT JOIN f USING (gold_work))"""


def _replay(spark, sf):
    e = drivers.table(spark, sf, "events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    j = e.join(first, "user_id")
    eid, isfirst = F.col("event_id"), F.col("event_id") == F.col("first")
    rel = F.when(eid % 13 == 0, "clarify").when(isfirst, "new").otherwise("attach")
    dec = F.when((eid % 13 == 0) | (eid % 17 == 0), "clarify").when(isfirst, "new").otherwise("attach")
    return evaluate.replay_truth(j.select(
        eid.alias("arrival"), F.col("user_id").cast("string").alias("gold_work"), rel.alias("gold_relation"), dec.alias("decision"),
        F.concat(F.lit("t"), F.when(eid % 101 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).cast("string")).alias("trajectory_id")))


@SECTION.add("k6_learned_gold_ids", f"WITH {_REPLAY} SELECT arrival, gold_work, correct FROM c")
def _(spark, sf):
    return _replay(spark, sf).select("arrival", "gold_work", "correct")


@SECTION.add("k5_work_reconstruction", f"""WITH {_REPLAY}, w AS (SELECT gold_work, bool_and(correct) AS good, bool_and(gold_relation = 'clarify') AS skip
    FROM c GROUP BY 1), m AS (SELECT count(*) AS n FROM (SELECT trajectory_id FROM c WHERE decision <> 'clarify' GROUP BY 1 HAVING count(DISTINCT gold_work) > 1))
  SELECT (SELECT count(*) FROM c) AS events, count(*) FILTER (NOT skip) AS evaluable_works, count(*) FILTER (NOT skip AND good) AS reconstructed_works,
    (SELECT n FROM m) AS false_merge_trajectories, round(count(*) FILTER (NOT skip AND good) / count(*) FILTER (NOT skip), 6) AS reconstruction_rate,
    (SELECT round(avg(correct::INT), 6) FROM c) AS event_accuracy FROM w""")
def _(spark, sf):
    return evaluate.reconstruction(_replay(spark, sf))


@SECTION.add("d10a_repeatability", f"""WITH {ASSESS} SELECT case_id, provider, round(max(confidence) - min(confidence), 6) AS spread, count(DISTINCT action) = 1 AS stable
  FROM asm GROUP BY 1, 2""")
def _(spark, sf):
    return drivers.assessments(spark, sf).groupBy("case_id", "provider").agg(
        F.round(F.max("confidence") - F.min("confidence"), 6).alias("spread"), (F.count_distinct("action") == 1).alias("stable"))


_MODAL = f"""{ASSESS}, {MODAL},
  go AS (SELECT case_id, provider, action, coalesce(candidate_id, '') AS cand, confidence, stable, ['new', 'attach', 'branch', 'attach'][case_id % 4 + 1] AS gold,
    CASE WHEN case_id % 4 = 0 THEN '' ELSE 't' || (case_id % 7) END AS gcand, {drivers.CATEGORIES!r}[case_id % 5 + 1] AS kind FROM mo),
  gh AS (SELECT *, action = 'abstain' AS abstain, action <> 'abstain' AND action = gold AND cand = gcand AS hit FROM go)"""


def _modal(spark, sf):
    """The opinion of every provider over all runs of a case, with what is right and whether it is."""
    key, empty = F.col("case_id"), F.lit("")
    rows = evaluate.modal_opinions(drivers.assessments(spark, sf), ["case_id"]).withColumns({
        "gold": drivers.pick(["new", "attach", "branch", "attach"], key % 4), "kind": drivers.pick(drivers.CATEGORIES, key % 5),
        "gold_candidate": F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("t"), (key % 7).cast("string"))), "abstain": F.col("action") == "abstain"})
    same = (F.col("action") == F.col("gold")) & (F.coalesce("candidate_id", empty) == F.col("gold_candidate"))
    return rows.withColumn("hit", ~F.col("abstain") & same)


_RATES = f"""count(*) AS cases, count(*) FILTER (hit) AS correct, count(*) FILTER (NOT abstain AND NOT hit) AS wrong, count(*) FILTER (abstain) AS abstain,
    {ratio('count(*) FILTER (hit)', 'count(*)')} AS accuracy, {ratio('count(*) FILTER (NOT abstain)', 'count(*)')} AS additional_coverage,
    {ratio('count(*) FILTER (NOT abstain AND NOT hit)', 'count(*)')} AS false_route_rate, {ratio('count(*) FILTER (stable)', 'count(*)')} AS stable_rate"""


def _rates(rows, *keys):
    r = rows.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if("hit").alias("correct"), F.count_if(~F.col("abstain") & ~F.col("hit")).alias("wrong"),
                                F.count_if("abstain").alias("abstain"), F.count_if("stable").alias("_s"))
    share = lambda c: F.round(c / F.col("cases"), 6)
    return r.withColumns({"accuracy": share(F.col("correct")), "additional_coverage": share(F.col("correct") + F.col("wrong")),
                          "false_route_rate": share(F.col("wrong")), "stable_rate": share(F.col("_s"))}).drop("_s")


@SECTION.add("k7_frontier_run", f"WITH {_MODAL} SELECT provider, {_RATES} FROM gh GROUP BY 1")
def _(spark, sf):
    return _rates(_modal(spark, sf), "provider")


@SECTION.add("k7_confident_precision", f"""WITH {_MODAL} SELECT provider, count(*) FILTER (confidence >= 0.80 AND NOT abstain) AS confident,
    {ratio("count(*) FILTER (confidence >= 0.80 AND NOT abstain AND action = gold)", "count(*) FILTER (confidence >= 0.80 AND NOT abstain)")} AS confident_precision
  FROM gh GROUP BY 1""")
def _(spark, sf):
    sure = (F.col("confidence") >= 0.80) & ~F.col("abstain")
    return _modal(spark, sf).groupBy("provider").agg(F.count_if(sure).alias("confident"), F.count_if(sure & (F.col("action") == F.col("gold"))).alias("_c")).select(
        "provider", "confident", F.round(F.col("_c") / F.col("confident"), 6).alias("confident_precision"))


@SECTION.add("k18_gold_frontier_by_kind", f"WITH {_MODAL} SELECT provider, kind, {_RATES} FROM gh GROUP BY 1, 2")
def _(spark, sf):
    return _rates(_modal(spark, sf), "provider", "kind")


@SECTION.add("k8_raw_vs_gated", f"""WITH {SAFE}, k AS (SELECT *, opinion = expected_decision AS raw_ok, ok AND opinion = expected_decision AS acc_ok,
    ok AND opinion = 'attach' AND expected_decision <> 'attach' AS wrong FROM sg WHERE pos = 1)
  SELECT category, count(*) AS cases, count(*) FILTER (raw_ok) AS raw_correct, count(*) FILTER (ok) AS accepted, count(*) FILTER (acc_ok) AS correct_accepted,
    count(*) FILTER (wrong) AS wrong_attach, {ratio('count(*) FILTER (acc_ok)', 'count(*) FILTER (ok)')} AS accepted_precision,
    {ratio('count(*) FILTER (acc_ok)', 'count(*)')} AS recovery_rate FROM k GROUP BY 1""")
def _(spark, sf):
    s, e = safe_rows(spark, sf).filter("is_top"), F.col("expected_decision")
    good = F.col("safe_accepted") & (F.col("safe_decision") == e)
    r = s.groupBy("category").agg(
        F.count("*").alias("cases"), F.count_if(F.col("opinion") == e).alias("raw_correct"), F.count_if("safe_accepted").alias("accepted"),
        F.count_if(good).alias("correct_accepted"),
        F.count_if(F.col("safe_accepted") & (F.col("safe_decision") == "attach") & (e != "attach")).alias("wrong_attach"))
    return r.withColumns({
        "accepted_precision": F.round(F.when(F.col("accepted") > 0, F.col("correct_accepted") / F.col("accepted")).otherwise(0.0), 6),
        "recovery_rate": F.round(F.col("correct_accepted") / F.col("cases"), 6)})


@SECTION.add("k9_annotator_agreement", """SELECT round(avg(abs(quality - toxic)), 6) AS mae, round(avg((quality = toxic)::INT), 6) AS exact_agreement,
    round((0.3713 - avg(abs(quality - toxic))) / 0.3713, 6) AS relative_improvement FROM labels""")
def _(spark, sf):
    mae = F.avg(F.abs(F.col("quality") - F.col("toxic")))
    return drivers.table(spark, sf, "labels").agg(
        F.round(mae, 6).alias("mae"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("exact_agreement"),
        F.round((0.3713 - mae) / 0.3713, 6).alias("relative_improvement"))


@SECTION.add("k10_history_dependence", """SELECT source, count(*) AS probes, count(*) FILTER (quality <> toxic) AS changed, round(avg((quality <> toxic)::INT), 6) AS base_rate
  FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    j = drivers.table(spark, sf, "labels").join(drivers.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    changed = F.col("quality") != F.col("toxic")
    return j.groupBy("source").agg(F.count("*").alias("probes"), F.count_if(changed).alias("changed"), F.round(F.avg(changed.cast("int")), 6).alias("base_rate"))


_CLASS = """p AS (SELECT l_returnflag AS truth, CASE WHEN l_partkey % 5 = 0 THEN 'N' WHEN l_suppkey % 7 = 0 THEN 'X' ELSE l_returnflag END AS pred FROM lineitem),
  l AS (SELECT truth AS label FROM p UNION SELECT pred FROM p),
  c AS (SELECT label, (SELECT count(*) FROM p WHERE truth = label AND pred = label) AS tp, (SELECT count(*) FROM p WHERE truth = label) AS support,
    (SELECT count(*) FROM p WHERE pred = label) AS predicted FROM l),
  r AS (SELECT label, tp, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM c),
  f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM r)"""


def _classes(spark, sf):
    return drivers.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("truth"), F.when(F.col("l_partkey") % 5 == 0, "N").when(
        F.col("l_suppkey") % 7 == 0, "X").otherwise(F.col("l_returnflag")).alias("pred"))


@SECTION.add("k12_class_report", f"WITH {_CLASS} SELECT label, support, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM f")
def _(spark, sf):
    r = evaluate.class_report(_classes(spark, sf), "truth", "pred")
    return r.select("label", F.col("support").cast("long").alias("support"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@SECTION.add("k13_macro_scores", f"""WITH {_CLASS} SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(rc) FILTER (support > 0), 6) AS balanced_accuracy,
    round(avg(f1), 6) AS macro_f1, round(max(support) / sum(support), 6) AS majority_accuracy, round(1 / count(*) FILTER (support > 0), 6) AS majority_balanced FROM f""")
def _(spark, sf):
    return evaluate.macro_scores(evaluate.class_report(_classes(spark, sf), "truth", "pred"))


@SECTION.add("k13_wilson_intervals", """WITH c AS (SELECT source, count(*) AS n, sum(quality) AS k FROM labels JOIN documents USING (doc_id) GROUP BY 1),
  w AS (SELECT *, k / n AS p, 1.96::DOUBLE AS z FROM c)
  SELECT source, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low,
    round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM w""")
def _(spark, sf):
    j = drivers.table(spark, sf, "labels").join(drivers.table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    c = j.groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    low, high = evaluate.wilson(F.col("k"), F.col("n"))
    return c.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@SECTION.add("k12_text_baseline")
def _(spark, sf):
    """TF-IDF and balanced logistic regression on the labelled documents, split by document id hash."""
    j = drivers.table(spark, sf, "labels").select("doc_id", "quality").join(drivers.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    side = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    pred = evaluate.text_baseline(j.filter(side != 0), j.filter(side == 0), "text", "quality")
    return evaluate.macro_scores(evaluate.class_report(pred, "quality", "predicted"))


@SECTION.add("k15_frontier_cases", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)
  SELECT o_custkey::VARCHAR AS user_id, o_orderkey::VARCHAR AS event_id, CASE n WHEN 1 THEN 'new' ELSE 'attach' END AS gold_action,
    CASE n WHEN 1 THEN o_orderpriority END AS excluded_work, CASE n WHEN 2 THEN 'gold_' || o_orderpriority END AS gold_candidate FROM t WHERE n <= 2""")
def _(spark, sf):
    h = drivers.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("work"), F.col("o_orderkey").cast("string").alias("event_id"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("text"))
    cases, _ = evaluate.gold_frontier(h)
    return cases.select("user_id", "event_id", "gold_action", "excluded_work", "gold_candidate")


@SECTION.add("k15_frontier_candidates", """WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders),
  c AS (SELECT *, CASE n WHEN 1 THEN 'new' ELSE 'attach' END AS gold_action, CASE n WHEN 1 THEN o_orderpriority END AS excluded FROM t WHERE n <= 2),
  k AS (SELECT o_custkey, o_orderpriority, o_orderstatus FROM t WHERE n = 1)
  SELECT c.o_custkey::VARCHAR AS user_id, o_orderkey::VARCHAR AS event_id, gold_action, 'gold_' || k.o_orderpriority AS candidate_id, k.o_orderstatus AS durable_goal,
    coalesce(gold_action = 'attach' AND k.o_orderpriority = c.o_orderpriority, false) AS is_gold
  FROM c JOIN k ON k.o_custkey = c.o_custkey WHERE k.o_orderpriority IS DISTINCT FROM excluded""")
def _(spark, sf):
    """The candidates of every frontier case: the works of its user, without the one it is to begin."""
    h = drivers.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("work"), F.col("o_orderkey").cast("string").alias("event_id"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("text"))
    return evaluate.frontier_candidates(*evaluate.gold_frontier(h))


@SECTION.add("k17_gated_frontier", f"""WITH {GATED_MODAL}, g AS (SELECT *, CASE WHEN ok THEN action ELSE 'clarify' END AS ga, CASE WHEN ok AND action <> 'new' THEN candidate_id END AS gc,
    ['new', 'attach', 'branch', 'abstain'][case_id % 4 + 1] AS gold, CASE WHEN case_id % 4 IN (1, 2) THEN 't' || (case_id % 7) END AS gcand,
    {drivers.CATEGORIES!r}[case_id % 5 + 1] AS category FROM hgr),
  h AS (SELECT *, CASE WHEN ga = 'clarify' THEN gold = 'abstain' ELSE ga = gold AND gc IS NOT DISTINCT FROM gcand END AS good FROM g)
  SELECT provider, category, count(*) AS cases, count(*) FILTER (good) AS correct, count(*) FILTER (NOT good AND ga <> 'clarify') AS wrong_committed,
    count(*) FILTER (ga = 'clarify') AS clarify, round(count(*) FILTER (good) / count(*), 6) AS accuracy,
    round(count(*) FILTER (NOT good AND ga <> 'clarify') / greatest(1, count(*) - count(*) FILTER (ga = 'clarify')), 6) AS committed_false_route_rate FROM h GROUP BY 1, 2""")
def _(spark, sf):
    g, key = gated_rows(spark, sf, modal=True), F.col("case_id")
    gold = drivers.pick(["new", "attach", "branch", "abstain"], key % 4)
    gcand = F.when((key % 4).isin(1, 2), F.concat(F.lit("t"), (key % 7).cast("string")))
    clar = F.col("gated_action") == "clarify"
    good = F.when(clar, gold == "abstain").otherwise((F.col("gated_action") == gold) & F.col("gated_candidate").eqNullSafe(gcand))
    r = g.groupBy("provider", drivers.pick(drivers.CATEGORIES, key % 5).alias("category")).agg(
        F.count("*").alias("cases"), F.count_if(good).alias("correct"), F.count_if(~good & ~clar).alias("wrong_committed"), F.count_if(clar).alias("clarify"))
    return r.withColumns({
        "accuracy": F.round(F.col("correct") / F.col("cases"), 6),
        "committed_false_route_rate": F.round(F.col("wrong_committed") / F.greatest(F.lit(1), F.col("cases") - F.col("clarify")), 6)})


@SECTION.add("k20_cache_fill_status", f"""WITH {PAIRED}, c AS (SELECT o_orderkey AS case_id, pa, pf, va, vf FROM orders LEFT JOIN pa ON pa.case_id = o_orderkey)
  SELECT {NEW_REASON} AS reason, count(*) AS cases, count(pa) AS primary_cached, count(va) AS verifier_cached, count(*) - count(va) AS pending_verifier FROM c GROUP BY 1""")
def _(spark, sf):
    cases = drivers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    c = gates.consensus_new(cases.join(paired(spark, sf), "case_id", "left"))
    return c.groupBy("reason").agg(F.count("*").alias("cases"), F.count("primary").alias("primary_cached"), F.count("verifier").alias("verifier_cached"),
                                   F.count_if(F.col("verifier").isNull()).alias("pending_verifier"))


@SECTION.add("h18_milestone_gate", """WITH r AS (SELECT o_orderpriority AS audit, avg((o_orderstatus <> 'P')::INT) AS rate, count(*) FILTER (o_totalprice > 499000) AS merges FROM orders GROUP BY 1)
  SELECT audit, rate >= 0.70 AND merges = 0 AS machine_gate, rate >= 0.70 AND merges < 1 AS human_gate, rate >= 0.70 AND merges = 0 AS milestone_pass FROM r""")
def _(spark, sf):
    r = drivers.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("audit")).agg(
        F.avg((F.col("o_orderstatus") != "P").cast("int")).alias("rate"), F.count_if(F.col("o_totalprice") > 499000).alias("merges"))
    g = audit.milestone_gate(F.col("rate"), F.col("merges"), F.col("rate"), F.col("merges"))
    return r.select("audit", *[c.alias(n) for n, c in g.items()])


@SECTION.add("h18_audit_score", """SELECT 'COMPLETE' AS status, count(*) AS sample_size, count(*) FILTER (quality = 1) AS correct, round(avg(quality), 6) AS correct_rate,
    count(*) FILTER (toxic = 1) AS false_merges, avg(quality) >= 0.70 AND count(*) FILTER (toxic = 1) = 0 AS milestone_pass FROM labels""")
def _(spark, sf):
    rows = drivers.table(spark, sf, "labels").select((F.col("quality") == 1).alias("human_correct"), (F.col("toxic") == 1).alias("human_false_merge"))
    return audit.score_audit(rows)
