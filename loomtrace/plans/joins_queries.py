"""Candidate retrieval and other joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions.anchors import anchors_of
from loomtrace.operators import corpus, retrieval, similarity
from loomtrace.plans.oracle import ORG
from loomtrace.plans.registry import Section
from loomtrace.plans.text_queries import _ANCHORS
from loomtrace.session import durable, new_folder
from loomtrace.sources import drivers

SECTION = Section()


def _sides(spark, sf):
    e = durable(drivers.org_events(spark, sf).select(
        "organization_id", "workspace_id", F.col("external_user_id").alias("person_id"), "event_id", "conversation_id",
        anchors_of(F.col("text")).alias("anchors")))
    t = e.select("organization_id", "workspace_id", "person_id", F.col("conversation_id").alias("trajectory_id"),
                 F.explode("anchors").alias("a")).distinct().groupBy(
        "organization_id", "workspace_id", "person_id", "trajectory_id").agg(F.collect_list("a").alias("anchors"))
    return e, durable(t)


_SIDES = f"""{ORG}, ea AS (SELECT organization_id AS o, workspace_id AS w, external_user_id AS p, event_id, conversation_id AS t,
    unnest(string_split({_ANCHORS}, '|')) AS a FROM oe),
  ek AS (SELECT DISTINCT o, w, p, event_id, t, CASE WHEN split_part(a, ':', 1) IN ('customer', 'tenant') THEN split_part(a, ':', 1)
    ELSE lower(a) END AS k FROM ea WHERE split_part(a, ':', 1) IN ('customer', 'tenant', 'ticket', 'incident', 'pr', 'trace_id')),
  tk AS (SELECT DISTINCT o, w, p, t, k FROM ek),
  pr AS (SELECT DISTINCT ek.event_id, tk.t FROM ek JOIN tk ON ek.o = tk.o AND ek.w = tk.w AND ek.k = tk.k AND ek.p <> tk.p)"""


@SECTION.add("e5_anchor_rescue", f"""WITH {_SIDES}, n AS (SELECT event_id, count(*) AS c FROM pr GROUP BY 1)
  SELECT oe.event_id, coalesce(c, 0) AS rescue_candidates FROM oe LEFT JOIN n ON n.event_id = oe.event_id""")
def _(spark, sf):
    events, trajectories = _sides(spark, sf)
    return retrieval.rescue_counts(events, trajectories).select("event_id", "rescue_candidates")




@SECTION.add("e4_person_candidates", """WITH t AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1)
  SELECT o_orderkey AS event_id, n AS person_candidates FROM orders JOIN t USING (o_custkey)""")
def _(spark, sf):
    o = drivers.table(spark, sf, "orders").select(
        F.lit("org").alias("organization_id"), F.lit("ws").alias("workspace_id"), F.col("o_custkey").alias("person_id"),
        F.col("o_orderkey").alias("event_id"), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("trajectory_id"))
    t = o.select("organization_id", "workspace_id", "person_id", "trajectory_id").distinct()
    return retrieval.person_counts(o, t).select("event_id", "person_candidates")


@SECTION.add("e9_pending_cases", """SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey NOT IN
    (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(spark, sf):
    cases = drivers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"))
    done = drivers.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case_id"))
    return corpus.pending_cases(cases, done, ["case_id"])


@SECTION.add("e9_resume_mismatches", """SELECT o_orderkey AS case_id FROM orders WHERE o_orderkey % 3 = 0 AND
    (o_orderstatus || CASE WHEN o_orderkey % 6 = 0 THEN 'x' ELSE '' END) <> o_orderstatus""")
def _(spark, sf):
    o = drivers.table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.sha2("o_orderstatus", 256).alias("digest"),
                                                  "o_orderstatus")
    done = o.filter("case_id % 3 = 0").withColumn("digest", F.sha2(F.concat("o_orderstatus", F.when(
        F.col("case_id") % 6 == 0, "x").otherwise("")), 256))
    return corpus.resume_mismatches(o, done, ["case_id"], "digest").select("case_id")


@SECTION.add("e10_train_test_leakage", """SELECT DISTINCT o_custkey AS trajectory_id FROM orders WHERE o_orderstatus = 'F' AND
    o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(spark, sf):
    o = drivers.table(spark, sf, "orders").select(F.col("o_custkey").alias("trajectory_id"), "o_orderstatus")
    return corpus.leakage(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "trajectory_id")


#: Signals of the taxonomy and how mature each is.
TAXONOMY = {"state_changed": "L1", "resistance": "L2", "repair": "L2", "topic_switch": "L2"}


@SECTION.add("e12_taxonomy_join", f"""WITH {ORG}, s AS (SELECT event_id, ['state_changed', 'resistance', 'repair', 'unheard_of'][k % 4 + 1] AS signal FROM oe),
  t(signal, maturity) AS (VALUES {', '.join(f"('{n}', '{m}')" for n, m in TAXONOMY.items())})
  SELECT event_id, signal, maturity, CASE WHEN maturity IS NOT NULL THEN '1.0.0' END AS taxonomy_version,
    CASE WHEN maturity IS NOT NULL THEN '{corpus.taxonomy_sha("1.0.0", TAXONOMY)}' END AS taxonomy_sha256 FROM s LEFT JOIN t USING (signal)""")
def _(spark, sf):
    """Signals of events with what a stored, versioned taxonomy says of them; a signal that it does not know gets nulls."""
    path = new_folder(spark)
    corpus.taxonomy_table(spark, "1.0.0", TAXONOMY).write.parquet(path)
    names = ["state_changed", "resistance", "repair", "unheard_of"]
    e = drivers.org_events(spark, sf).select("event_id", drivers.pick(names, F.col("k") % 4).alias("signal"))
    return e.join(corpus.verified_taxonomy(spark.read.parquet(path)), "signal", "left")


@SECTION.add("e13_predictions_with_gold", """WITH p AS (SELECT 'p' || (l_partkey % 500) AS trajectory_id, l_suppkey % 20 AS gold FROM lineitem)
  SELECT trajectory_id, string_agg(DISTINCT gold::VARCHAR, '|' ORDER BY gold::VARCHAR) AS gold_works,
    count(DISTINCT gold) > 1 AS false_merge_hint FROM p GROUP BY 1""")
def _(spark, sf):
    p = drivers.table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), (F.col("l_partkey") % 500).cast("string")).alias("trajectory_id"),
        (F.col("l_suppkey") % 20).cast("string").alias("gold")).distinct()
    return p.groupBy("trajectory_id").agg(F.array_join(F.sort_array(F.collect_list("gold")), "|").alias("gold_works"),
                                          (F.count("*") > 1).alias("false_merge_hint"))


# Every fifth vector is there a second time under another id and label, so that equal vectors occur; of every fiftieth there is a zero vector.
_PAIRS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings UNION ALL
    SELECT vec_id + 1000000000, label + 1, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 5 = 0 UNION ALL
    SELECT vec_id + 2000000000, label, list_transform(embedding, lambda x: 0.0::DOUBLE) FROM embeddings WHERE vec_id % 50 = 0),
  u AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-8)) AS u FROM v),
  p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_dot_product(a.u, b.u) AS s FROM u a JOIN u b ON a.vec_id < b.vec_id
    AND a.label <> b.label WHERE list_dot_product(a.u, b.u) >= 0.88)"""


def _vectors(spark, sf):
    v = drivers.table(spark, sf, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), "embedding")
    again = v.filter("id % 5 = 0").select((F.col("id") + 1000000000).alias("id"), (F.col("label") + 1).alias("label"), "embedding")
    zero = v.filter("id % 50 = 0").select((F.col("id") + 2000000000).alias("id"), "label", F.transform("embedding", lambda x: (x * 0).cast("float")).alias("embedding"))
    return v.union(again).union(zero).select("id", F.col("label").cast("string").alias("trajectory_id"), "embedding")


@SECTION.add("e11_contrastive_pairs", f"WITH {_PAIRS} SELECT id_a, id_b, round(s, 6) AS similarity FROM p")
def _(spark, sf):
    v = durable(_vectors(spark, sf))
    return similarity.expanded_pairs(v, similarity.similar_pairs(v, 0.88)).withColumn("similarity", F.round("similarity", 6))


@SECTION.add("e11_pair_groups", f"""WITH {_PAIRS}, r AS (SELECT vec_id, min(vec_id) OVER (PARTITION BY e) AS rep FROM v)
  SELECT least(x.rep, y.rep) AS id_a, greatest(x.rep, y.rep) AS id_b, count(*) AS pairs FROM p JOIN r x ON x.vec_id = id_a JOIN r y ON y.vec_id = id_b
  GROUP BY 1, 2""")
def _(spark, sf):
    """Pairs of distinct vectors with the number of pairs of copies: what a giant group of copies is reported as."""
    return similarity.similar_pairs(_vectors(spark, sf), 0.88).select("id_a", "id_b", "pairs")


@SECTION.add("e11_contrastive_top_20", f"""WITH {_PAIRS} SELECT id_a, id_b, round(s, 6) AS similarity FROM p
    ORDER BY round(s, 6) DESC, id_a, id_b LIMIT 20""")
def _(spark, sf):
    v = durable(_vectors(spark, sf))
    pairs = similarity.expanded_pairs(v, similarity.similar_pairs(v, 0.88)).withColumn("similarity", F.round("similarity", 6))
    return pairs.orderBy(F.desc("similarity"), "id_a", "id_b").limit(20)
