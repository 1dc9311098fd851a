"""Steps whose cost once grew with few keys, whole batches or repeated reads; each against a plain form of the same rule."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtrace.functions import language
from loomtrace.functions.anchors import anchors_of
from loomtrace.operators import evaluate, hooks, linkage
from loomtrace.plans.hooks_queries import overlap_model


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_opinions_are_not_moved_by_provider(spark):
    a = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 1, "y"), (2, "a", 1, "z"), (2, "a", 2, "w"), (3, "c", 1, "v"), (3, None, 1, "u")],
                              "case_id INT, provider STRING, run INT, action STRING")
    ranking = spark.createDataFrame([("b", 1), ("a", 2)], "provider STRING, rank INT")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if Spark could not tell that the list is short
    try:
        first = linkage.first_available(a, ranking, ["case_id"])
        assert "SortMergeJoin" not in _plan(first) and "BroadcastHashJoin" in _plan(first)
        assert sorted(tuple(r) for r in first.select("case_id", "action").collect()) == [(1, "y"), (2, "w"), (3, "u")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_texts_are_not_moved_by_label(spark, monkeypatch):
    seen = []
    joined = evaluate.with_small
    monkeypatch.setattr(evaluate, "with_small", lambda *a: seen.append(joined(*a)) or seen[-1])
    rows = spark.createDataFrame([(i, "good words here" if i % 3 else "bad other text", int(i % 3 > 0)) for i in range(30)], "id INT, text STRING, label_ INT")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = evaluate.text_baseline(rows, rows, "text", "label_", 64)
        assert out.filter("label_ <> predicted").count() == 0
        assert "BroadcastHashJoin" in _plan(seen[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_scorers_get_bounded_pieces(spark, monkeypatch):
    monkeypatch.setattr(hooks, "PIECE_ROWS", 3)
    monkeypatch.setattr(hooks, "PIECE_CHARS", 100)
    sizes = pd.Series([10, 10, 10, 10, 500, 60, 60, 1])
    assert hooks._piece_ends(sizes) == [3, 4, 5, 6, 8]
    assert hooks._piece_ends(pd.Series([], dtype="int64")) == []

    def model(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(len(a))] * len(a), index=range(len(a)))

    pairs = spark.range(8, numPartitions=1).select("id", F.lit("x").alias("candidate_text"), F.when(F.col("id") != 2, "y").alias("incoming_text"))
    assert max(r.score for r in hooks.score_pairs(pairs, model).collect()) <= hooks.PIECE_ROWS


def test_overlap_model_is_unchanged():
    a, b = pd.Series(["a b c", "x", ""]), pd.Series(["b c d", "y", ""])
    assert list(overlap_model(a, b)) == [0.5, 0.0, 1.0]


TEXTS = ["still", "STILL failing again", "distill", "now we go, but", "but now", "the same bug is back", "is back, the same", "recurred", "recurrence", "recur",
         "we found it", "turns out", "this revealed", "now design", "let's redesign now let's", "returned", "happening again", "", None, "after the  change",
         "now\nbut", "ﬅill stıll ſtill", "İs back"]


@pytest.mark.parametrize("patterns", [language.CONTINUATION, language.BRANCH, language.REOPEN])
def test_needles_lose_no_signal(spark, patterns):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text STRING")
    lower = F.lower(F.coalesce("text", F.lit("")))
    plain = F.array_compact(F.array(*[F.when(F.regexp_like(lower, F.lit("(?U)" + p)), F.lit(p)) for p in patterns]))
    for got, want in rows.select(language._hits(F.col("text"), patterns), plain).collect():
        assert got == want
    assert all(re.escape(n) and n in p.replace(r"\b", "") for p in patterns for n in language.needles(p))


def test_identity_needles_lose_no_match(spark):
    texts = ["customer acme", "CUSTOMER Acme-1", "cuſtomer acme", "repo: x", "Repository x.y", "PR #12", "pr12", "OPS-1", "ops-1", "none", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text STRING")
    for name, pattern in language.IDENTITY.items():
        plain = F.nullif(F.lower(F.regexp_extract("text", "(?U)" + pattern, 1)), F.lit(""))
        for got, want in rows.select(language._first(F.col("text"), pattern, language._IDENTITY_NEEDLES[name]), plain).collect():
            assert got == want


@pytest.mark.parametrize("text, want", [
    ("commit deadbee now", [("git_sha", "deadbee")]), ("DEADBEEF1", [("git_sha", "deadbeef1")]), ("xdeadbee", []), ("deadbe", []),
    ("éabcdef0", []), (None, []), ("", []), ("OPS-12 deadbee customer: Acme", [("customer", "acme"), ("git_sha", "deadbee"), ("ticket", "OPS-12")])])
def test_anchors_of_one_pass(spark, text, want):
    row = spark.createDataFrame([(text,)], "t STRING").select(anchors_of(F.col("t")).alias("a")).first()
    assert [(a.type, a.value) for a in row.a] == want
