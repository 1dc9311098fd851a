"""TF-IDF, token and vector similarity, thread resolution by score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomtrace.functions import vectors
from loomtrace.functions.text import jaccard
from loomtrace.operators import ordered, similarity
from loomtrace.plans.gates_queries import PAIRS
from loomtrace.plans.oracle import ORG
from loomtrace.plans.registry import Section
from loomtrace.plans.similarity_sql import terms_cte, weights_cte
from loomtrace.plans.text_queries import _PAIRS, _pairs
from loomtrace.sources import drivers

SECTION = Section()


@SECTION.add("j1_tfidf_weights", f"""WITH {terms_cte('c', 'conversations', ['conv_id', 'turn'])},
  {weights_cte('w', 'c', 'conversations', ['conv_id'], 'turn')}
  SELECT conv_id, turn, count(*) AS terms, round(sum(w), 5) AS weight_sum, round(max(w), 5) AS max_weight FROM w GROUP BY 1, 2""")
def _(spark, sf):
    c = drivers.table(spark, sf, "conversations")
    w = similarity.tfidf(similarity.term_counts(c, ["conv_id", "turn"]), c.select("conv_id", "turn"), ["conv_id"], "turn")
    return w.groupBy("conv_id", "turn").agg(F.count("*").alias("terms"), F.round(F.sum("w"), 5).alias("weight_sum"),
                                            F.round(F.max("w"), 5).alias("max_weight"))


@SECTION.add("j3_token_jaccard", rf"""WITH {_PAIRS}, t AS (SELECT event_id, list_distinct(list_filter(regexp_split_to_array(lower(candidate_text),
    '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS b FROM pr)
  SELECT event_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0 END, 6)
    AS score FROM t""")
def _(spark, sf):
    return _pairs(spark, sf).select("event_id", F.round(jaccard(F.col("candidate_text"), F.col("text")), 6).alias("score"))


def _neighbours(spark, sf):
    """Each vector with its successor by id."""
    v = drivers.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id")


_VEC = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


@SECTION.add("j4_pair_features", f"""SELECT a.vec_id, 4 * len(a.embedding) AS size, round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
    lambda p: 2.0::DOUBLE * p[1] + p[1] * p[2])), 4) AS total, round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
    lambda p: (p[1] - p[2])::DOUBLE)), 4) AS delta_total {_VEC}""")
def _(spark, sf):
    n = _neighbours(spark, sf)
    add = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 4)
    f = n.select("vec_id", vectors.pair_feature(F.col("embedding"), F.col("other")).alias("f"),
                 vectors.delta_feature(F.col("embedding"), F.col("other"), F.lit(True)).alias("d"))
    return f.select("vec_id", F.size("f").cast("long").alias("size"), add("f").alias("total"), add("d").alias("delta_total"))


@SECTION.add("j5_mean_pooling", """WITH t AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings
    WHERE vec_id >= label * 7 AND vec_id < label * 7 + 300), m AS (SELECT label, d, avg(x) AS m FROM t GROUP BY 1, 2)
  SELECT label, count(*) AS dims, round(max(m) FILTER (d = 1), 6) AS first_dim, round(max(m) FILTER (d = 64), 6) AS last_dim FROM m GROUP BY 1""")
def _(spark, sf):
    t = drivers.table(spark, sf, "embeddings").withColumns({"start": F.col("label") * 7, "end": F.col("label") * 7 + 300})
    p = similarity.mean_pool(t, "label", "embedding", "start", "end", "vec_id")
    return p.select("label", F.size("pooled").cast("long").alias("dims"), F.round(F.element_at("pooled", 1), 6).alias("first_dim"),
                    F.round(F.element_at("pooled", 64), 6).alias("last_dim"))


@SECTION.add("j6_vector_cosine", f"""SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine {_VEC}""")
def _(spark, sf):
    return _neighbours(spark, sf).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@SECTION.add("h21_embedding_baseline", f"""SELECT a.vec_id, CASE WHEN list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.55
    THEN 'attach' ELSE 'new' END AS decision {_VEC}""")
def _(spark, sf):
    return _neighbours(spark, sf).select("vec_id", F.when(vectors.cosine(F.col("embedding"), F.col("other")) >= 0.55, "attach").otherwise(
        "new").alias("decision"))


@SECTION.add("h21_tfidf_baseline", f"""WITH {_PAIRS}, s AS (SELECT event_id, 1 AS doc, candidate_text AS text FROM pr UNION ALL
    SELECT event_id, 2, text FROM pr), {terms_cte('c', 's', ['event_id', 'doc'])}, {weights_cte('w', 'c', 's', ['event_id'], 'doc')},
  d AS (SELECT a.event_id, sum(a.w * b.w) AS s FROM w a JOIN w b ON a.event_id = b.event_id AND a.term = b.term AND a.doc = 1 AND b.doc = 2 GROUP BY 1)
  SELECT pr.event_id, round(coalesce(s, 0.0), 5) AS score, CASE WHEN coalesce(s, 0) >= 0.15 THEN 'attach' ELSE 'new' END AS decision
  FROM pr LEFT JOIN d ON d.event_id = pr.event_id""")
def _(spark, sf):
    p = similarity.pair_tfidf(_pairs(spark, sf), "event_id", "candidate_text", "text")
    return p.select("event_id", F.round("score", 5).alias("score"), F.when(F.col("score") >= 0.15, "attach").otherwise("new").alias("decision"))


# a trajectory is five neighbouring conversations, each a thread; the last user turn of all is the message to place
_PLACE = """p AS (SELECT *, conv_id // 5 AS tid, 'th' || conv_id AS thread FROM conversations WHERE trim(text) <> ''),
  q AS (SELECT tid, arg_max(text, (conv_id, turn)) AS text, max((conv_id, turn)) AS at FROM p WHERE role = 'user' GROUP BY 1),
  e AS (SELECT p.* FROM p JOIN q USING (tid) WHERE (p.conv_id, p.turn) < q.at)"""


def _thread_sql(filter_sql: str) -> str:
    return f"""{_PLACE}, f AS (SELECT tid, thread, text, turn FROM e {filter_sql}),
  docs AS (SELECT tid, 't:' || thread AS doc, string_agg(text, ' ' ORDER BY turn) AS text FROM f GROUP BY 1, 2
    UNION ALL SELECT tid, 'q', text FROM q WHERE tid IN (SELECT tid FROM f)),
  {terms_cte('c', 'docs', ['tid', 'doc'])}, {weights_cte('w', 'c', 'docs', ['tid'], 'doc')},
  d AS (SELECT a.tid, a.doc, sum(a.w * b.w) AS s FROM w a JOIN w b ON a.tid = b.tid AND a.term = b.term AND b.doc = 'q' AND a.doc <> 'q' GROUP BY 1, 2),
  sc AS (SELECT docs.tid, substr(docs.doc, 3) AS thread, coalesce(s, 0.0) AS score FROM docs LEFT JOIN d ON d.tid = docs.tid AND d.doc = docs.doc
    WHERE docs.doc <> 'q'),
  rk AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY round(score, 9) DESC, thread) AS n FROM sc),
  best AS (SELECT tid, max(thread) FILTER (n = 1) AS thread, max(score) FILTER (n = 1) AS s1, coalesce(max(score) FILTER (n = 2), 0.0) AS s2
    FROM rk GROUP BY 1)"""


def _placed(spark, sf, recent: int | None):
    c = drivers.table(spark, sf, "conversations").filter("trim(text) <> ''").select(
        "*", F.floor(F.col("conv_id") / 5).alias("tid"), F.concat(F.lit("th"), F.col("conv_id").cast("string")).alias("thread"))
    q = c.filter("role = 'user'").groupBy("tid").agg(
        F.max_by("text", F.struct("conv_id", "turn")).alias("text"), F.max(F.struct("conv_id", "turn")).alias("at"))
    earlier = c.join(q.select("tid", "at"), "tid").filter(F.struct("conv_id", "turn") < F.col("at"))
    if recent is not None:
        earlier = ordered.top_rows(earlier.filter(F.col("role").isin("user", "assistant")), ["tid", "thread"], [F.desc("turn")], recent)
    pieces = earlier.select("tid", "thread", "turn", "text")
    counts = similarity.joined_term_counts(pieces, ["tid", "thread"], "turn", F.floor(F.col("turn") / 1000))
    threads = pieces.select("tid", "thread").distinct()
    scores = similarity.query_scores(q.select("tid", "text"), counts, threads, ["tid"], "thread")
    top = ordered.top_rows(scores.withColumn("key", F.round("score", 9)), ["tid"], [F.desc("key"), F.col("thread")], 2)
    return top.groupBy("tid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("thread"))).alias("thread"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("s2"))


@SECTION.add("h01_thread_resolver", f"""WITH {_thread_sql("WHERE role IN ('user', 'assistant') QUALIFY row_number() OVER (PARTITION BY tid, thread ORDER BY turn DESC) <= 10")}
  SELECT tid, CASE WHEN s1 < 0.15 THEN NULL ELSE thread END AS thread, s1 < 0.15 AS is_new, round(s1, 5) AS score FROM best""")
def _(spark, sf):
    b = _placed(spark, sf, 10)
    new = F.col("s1") < 0.15
    return b.select("tid", F.when(~new, F.col("thread")).alias("thread"), new.alias("is_new"), F.round("s1", 5).alias("score"))


@SECTION.add("h02_trajectory_router", f"""WITH {_thread_sql('')} SELECT tid, CASE WHEN s1 >= 0.30 AND s1 - s2 >= 0.08 THEN 'attach' WHEN s1 >= 0.15
    THEN 'suggest' ELSE 'new' END AS decision, CASE WHEN s1 >= 0.15 THEN thread END AS thread, round(s1, 4) AS score, round(s1 - s2, 4) AS margin FROM best""")
def _(spark, sf):
    b = _placed(spark, sf, None)
    attach = (F.col("s1") >= 0.30) & (F.col("s1") - F.col("s2") >= 0.08)
    return b.select("tid", F.when(attach, "attach").when(F.col("s1") >= 0.15, "suggest").otherwise("new").alias("decision"),
                    F.when(F.col("s1") >= 0.15, F.col("thread")).alias("thread"), F.round("s1", 4).alias("score"),
                    F.round(F.col("s1") - F.col("s2"), 4).alias("margin"))
