"""Pair decisions: could this message belong to that piece of work? One row per (message, candidate)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.functions import language
from loomtrace.functions.anchors import anchors_of, compare_anchors
from loomtrace.session import with_small

LIVE = ["active", "waiting", "blocked"]


def with_anchors(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({
        "candidate_anchors": anchors_of(F.col("candidate_text")), "incoming_anchors": anchors_of(F.col("incoming_text"))})


def _clean(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def _decide(df: DataFrame, rules: list[tuple[Column | None, str | Column, float]], prefix: str) -> DataFrame:
    """Decision and confidence of the first rule that matches, and its number in the list; the last rule has no condition."""
    steps = {"decision": [d if isinstance(d, Column) else F.lit(d) for _, d, _ in rules], "confidence": [F.lit(c) for *_, c in rules],
             "rule": [F.lit(i) for i in range(1, len(rules) + 1)]}
    out = {}
    for name, values in steps.items():
        chosen = values[-1]
        for (condition, *_), value in zip(reversed(rules[:-1]), reversed(values[:-1]), strict=True):
            chosen = F.when(condition, value).otherwise(chosen)
        out[prefix + name] = chosen
    return df.withColumns(out)


def hybrid(pairs: DataFrame, prefix: str = "") -> DataFrame:
    """Decision from the two texts, the score and whether the candidate is unresolved."""
    ids = language.identity_matches(F.col("candidate_text"), F.col("incoming_text"))
    read = pairs.withColumns({
        "_contra": F.size(ids["contradictions"]) > 0,
        "_branch": F.size(language.branch_signals(F.col("incoming_text"))) > 0,
        "_cont": F.size(language.continuation_signals(F.col("incoming_text"))) > 0})
    score = F.col("score")
    out = _decide(read, [
        (F.col("_contra"), "new", 0.99),
        (F.col("_branch"), "branch", 0.90),
        (F.col("_cont") & F.col("unresolved"), "attach", 0.90),
        (F.col("_cont"), "uncertain", 0.55),
        (score >= 0.72, "attach", 0.80),
        (score >= 0.40, "uncertain", 0.50),
        (score < 0.20, "new", 0.80),
        (None, "uncertain", 0.40),
    ], prefix)
    return out.drop("_contra", "_branch", "_cont")


def structured(pairs: DataFrame, prefix: str = "linker_") -> DataFrame:
    """Decision from anchors, entities, artifacts, goals, lifecycle, language and score.

    Needs ``candidate_*`` and ``incoming_*`` columns (text, anchors, entities, artifacts, goal), ``lifecycle`` and
    ``score``. Adds the anchor evidence and ``strong_identity``.
    """
    seen = compare_anchors(pairs, "candidate_anchors", "incoming_anchors")
    lower = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    seen = seen.withColumns({
        "_ce": _clean(F.col("candidate_entities")), "_ie": _clean(F.col("incoming_entities")),
        "_ca": _clean(F.col("candidate_artifacts")), "_ia": _clean(F.col("incoming_artifacts")),
        "_cg": lower(F.col("candidate_goal")), "_ig": lower(F.col("incoming_goal")),
        "_branch": F.size(language.branch_signals(F.col("incoming_text"))) > 0,
        "_cont": F.size(language.continuation_signals(F.col("incoming_text"))) > 0,
    })

    def shared(a: str, b: str) -> Column:
        return F.size(F.array_intersect(a, b)) > 0

    def conflict(a: str, b: str) -> Column:
        return (F.size(a) > 0) & (F.size(b) > 0) & ~shared(a, b)

    live, score = F.col("lifecycle").isin(*LIVE), F.col("score")
    out = _decide(seen, [
        (F.col("hard_new"), "new", 0.99),
        (F.col("strong_attach"), "attach", 0.99),
        (conflict("_ce", "_ie"), "new", 0.99),
        (conflict("_ca", "_ia"), "new", 0.99),
        (F.col("_branch"), "branch", 0.90),
        ((F.col("_cg") != "") & (F.col("_cg") == F.col("_ig")) & live, "attach", 0.95),
        (shared("_ce", "_ie") | shared("_ca", "_ia"), "uncertain", 0.55),
        (F.col("_cont") & live, "attach", 0.90),
        (F.col("lifecycle") == "resolved", "uncertain", 0.50),
        (score >= 0.72, "uncertain", 0.65),
        ((score < 0.20) & live, "uncertain", 0.45),
        (score < 0.20, "new", 0.80),
        (None, "uncertain", 0.40),
    ], prefix)
    return out.withColumn("strong_identity", F.col("strong_attach")).drop(
        "_ce", "_ie", "_ca", "_ia", "_cg", "_ig", "_branch", "_cont")


def first_available(assessments: DataFrame, ranking: DataFrame, keys: list[str]) -> DataFrame:
    """Per case the latest run of the first provider (by rank) that has an opinion; providers without a rank come last, by name.

    A few providers have all the opinions, so the opinions are never moved by provider.
    """
    rest = [c for c in assessments.columns if c not in keys]
    ranked = with_small(assessments, ranking, "provider")
    order = F.struct(F.col("rank").isNull(), "rank", "provider", -F.col("run"))
    return ranked.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("a")).select(*keys, "a.*")


def cascade(decided: DataFrame, opinions: DataFrame, keys: list[str], local: str = "linker_",
            threshold: float = 0.80) -> DataFrame:
    """Keep the local decision unless uncertain; then the opinion decides if confident, else clarify.

    ``opinions`` has at most one row per key: ``opinion``, ``opinion_confidence``, ``opinion_provider``.
    """
    joined = decided.join(opinions, keys, "left")
    unsure = F.col(f"{local}decision") == "uncertain"
    strong = F.col("opinion").isin("attach", "branch", "new") & (F.col("opinion_confidence") >= threshold)
    strong = F.coalesce(strong, F.lit(False))
    return joined.withColumns({
        "decision": F.when(~unsure, F.col(f"{local}decision")).when(strong, F.col("opinion")).otherwise("clarify"),
        "confidence": F.when(~unsure | F.col("opinion").isNull(), F.col(f"{local}confidence")).otherwise(
            F.col("opinion_confidence")),
        "source": F.when(~unsure, "local").when(strong, F.concat(F.lit("frontier_judge:"), F.col("opinion_provider")))
        .otherwise("user_clarification"),
    })
