"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtrace.session import with_small


def order_statistics(df: DataFrame, value: str, low: float | None = None, high: float | None = None, cells: int = 1024, error: float = 1e-4) -> DataFrame:
    """Minimum, upper median (element n // 2 of the sorted values) and maximum; nulls and NaN are left out. ``low`` and ``high`` say where
    the values are known to lie; they are not needed.

    A quantile sketch of rank error ``error`` brackets the median; one more pass counts what lies below the bracket and the values inside
    it, cut into ``cells`` of which only the totals are added up in order. Nothing is sorted as a whole, and the median is exact.
    """
    placed = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    bracket = placed.approxQuantile("v", [max(0.0, 0.5 - 2 * error), min(1.0, 0.5 + 2 * error)], error)
    low, high = bracket or (low or 0.0, high or 0.0)
    ends = placed.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("cases"), F.count_if(F.col("v") < low).alias("below"))
    cell = F.floor((F.col("v") - low) / ((high - low) or 1.0) * cells).alias("cell")
    inside = placed.filter((F.col("v") >= low) & (F.col("v") <= high)).groupBy("v").agg(F.count("*").alias("n")).select("v", "n", cell)
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = inside.groupBy("cell").agg(F.sum("n").alias("n")).select(  # at most ``cells`` + 1 rows
        "cell", F.coalesce(F.sum("n").over(earlier(F.lit(0)).orderBy("cell")), F.lit(0)).alias("before"))
    ranked = inside.withColumn("smaller", F.coalesce(F.sum("n").over(earlier("cell").orderBy("v")), F.lit(0))).join(F.broadcast(totals), "cell")
    first = F.col("below") + F.col("before") + F.col("smaller")
    middle = F.floor(F.col("cases") / 2)
    median = ranked.join(F.broadcast(ends.select("below", "cases"))).filter((first <= middle) & (middle < first + F.col("n"))).agg(F.max("v").alias("median"))
    return ends.join(F.broadcast(median)).select(  # one row each
        F.round("lo", 6).alias("min_margin"), F.round("median", 6).alias("median_margin"),
        F.round("hi", 6).alias("max_margin"), "cases")


def _ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.round(F.when(den > 0, num / den).otherwise(F.lit(default)), 6)


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def linkage_metrics(p: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, false merges (new or branch taken as attach) and false splits (attach taken as new)."""
    e, d = F.col("expected"), F.col("predicted")
    return p.groupBy(*by).agg(
        F.count("*").alias("cases"), _n(e == d).alias("correct"), _n(e.isin("new", "branch") & (d == "attach")).alias("false_merges"),
        _n((e == "attach") & (d == "new")).alias("false_splits")).withColumn("accuracy", _ratio(F.col("correct"), F.col("cases")))


def confusion(p: DataFrame) -> DataFrame:
    return p.groupBy("expected", "predicted").agg(F.count("*").alias("cases"))


def selective_metrics(p: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and precision on decided cases when ``uncertain`` abstains."""
    e, d = F.col("expected"), F.col("predicted")
    decided = d != "uncertain"
    return p.groupBy(*by).agg(
        F.count("*").alias("cases"), _n(decided).alias("decided"), _n(~decided).alias("abstained"), _n(decided & (e == d)).alias("correct"),
        _n((d == "attach") & (e != "attach")).alias("false_merges")).withColumns({
            "coverage": _ratio(F.col("decided"), F.col("cases")), "precision": _ratio(F.col("correct"), F.col("decided"))})


def candidate_metrics(p: DataFrame, by: list[str]) -> DataFrame:
    """Like ``selective_metrics`` but the right candidate is required where one is expected."""
    d, e = F.col("decision"), F.col("expected_decision")
    decided = d != "uncertain"
    need = F.col("expected_candidate").isNotNull()
    hit = F.coalesce(F.col("chosen") == F.col("expected_candidate"), F.lit(False))
    right = decided & (d == e) & (~need | hit)
    return p.groupBy(*by).agg(
        F.count("*").alias("cases"), _n(decided).alias("decided"), _n(~decided).alias("abstained"), _n(right).alias("correct"),
        _n(right & need).alias("correct_candidate"),
        _n(~right & (d == "attach") & ((e != "attach") | (need & ~hit))).alias("false_merges"),
        _n(decided & (d == "new") & (e == "attach")).alias("false_splits")).withColumns({
            "coverage": _ratio(F.col("decided"), F.col("cases")), "precision": _ratio(F.col("correct"), F.col("decided"))})


def pair_counts(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Pairwise clustering counts from the contingency table; no pair of events is ever formed."""
    pairs = lambda c: (c * (c - 1) / 2).cast("decimal(38,0)")
    table = rows.groupBy(gold, pred).agg(F.count("*").alias("n"))
    both = table.agg(F.sum(pairs(F.col("n"))).alias("same_both"))
    by_gold = table.groupBy(gold).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("same_gold"), F.count("*").alias("gold_groups"))
    by_pred = table.groupBy(pred).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("same_pred"), F.count("*").alias("pred_groups"))
    one = both.join(F.broadcast(by_gold)).join(F.broadcast(by_pred))  # one row each
    tp, fs, fm = F.col("same_both"), F.col("same_gold") - F.col("same_both"), F.col("same_pred") - F.col("same_both")
    long = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
    return one.select(
        "gold_groups", "pred_groups", long(tp, "true_pairs"), long(fm, "false_merge_pairs"), long(fs, "false_split_pairs")).withColumns({
            "pair_precision": _ratio(F.col("true_pairs"), F.col("true_pairs") + F.col("false_merge_pairs"), 1.0),
            "pair_recall": _ratio(F.col("true_pairs"), F.col("true_pairs") + F.col("false_split_pairs"), 0.0)})


def replay_truth(rows: DataFrame) -> DataFrame:
    """Correctness of routed events against gold work ids that are learned on the way.

    The first correct ``new`` of a work fixes its trajectory; a later attach must name it. ``gold_relation`` is new, attach,
    clarify or ambiguous_cross_person.
    """
    fixed = "gold_relation = 'new' and decision = 'new' and trajectory_id is not null"
    first = rows.filter(fixed).groupBy("gold_work").agg(
        F.min_by("trajectory_id", "arrival").alias("known"), F.min("arrival").alias("known_at"))
    joined = rows.join(first, "gold_work", "left")
    ok = (F.when(F.col("gold_relation").isin("clarify", "ambiguous_cross_person"), F.col("decision") == "clarify")
          .when(F.col("gold_relation") == "new", F.col("decision") == "new")
          .when(F.col("gold_relation") == "attach", (F.col("decision") == "attach") & (F.col("known") == F.col("trajectory_id"))
                & (F.col("known_at") < F.col("arrival"))).otherwise(F.lit(False)))
    return joined.withColumn("correct", F.coalesce(ok, F.lit(False))).drop("known", "known_at")


def reconstruction(rows: DataFrame) -> DataFrame:
    """Rate of works whose events are all correct, and predicted trajectories that span several works."""
    skip = F.col("gold_relation").isin("clarify", "ambiguous_cross_person")
    works = rows.groupBy("gold_work").agg(F.bool_and("correct").alias("good"), F.bool_and(skip).alias("skipped"),
                                          F.count("*").alias("n"), _n(F.col("correct")).alias("c"))
    merged = rows.filter("decision <> 'clarify' and trajectory_id is not null").select("trajectory_id", "gold_work").distinct().groupBy(
        "trajectory_id").agg(F.count("*").alias("works")).agg(_n(F.col("works") > 1).alias("false_merge_trajectories"))
    total = works.agg(F.sum("n").cast("long").alias("events"), _n(~F.col("skipped")).alias("evaluable_works"),
                      _n(~F.col("skipped") & F.col("good")).alias("reconstructed_works"), F.sum("c").alias("_c"))
    return total.join(F.broadcast(merged)).withColumns({  # one row each
        "reconstruction_rate": _ratio(F.col("reconstructed_works"), F.col("evaluable_works")),
        "event_accuracy": _ratio(F.col("_c"), F.col("events"))}).drop("_c")


def modal(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value per key (the earliest seen wins ties) and whether all runs agree."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias("modal"),
                                     (F.count("*") == 1).alias("stable"))


def modal_opinions(assessments: DataFrame, keys: list[str]) -> DataFrame:
    """One opinion per case and provider over all its runs: the most frequent pair of action and candidate (the earliest seen wins ties), the
    least ``confidence`` with which it was given, and ``stable`` where all runs agree."""
    counts = assessments.groupBy(*keys, "provider", "action", "candidate_id").agg(
        F.count("*").alias("n"), F.min("run").alias("first"), F.min("confidence").alias("confidence"))
    opinion = F.struct("action", "candidate_id", "confidence")
    best = counts.groupBy(*keys, "provider").agg(F.max_by(opinion, F.struct(F.col("n"), -F.col("first"))).alias("o"), (F.count("*") == 1).alias("stable"))
    return best.select(*keys, "provider", "o.*", "stable")


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k successes in n."""
    p = k / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def class_report(p: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined ratios are 0."""
    hits = p.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    sides = hits.select(F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.lit("t").alias("side")),
        F.struct(F.col(predicted).alias("label"), F.lit("p").alias("side")))).alias("s"), "n", (F.col(truth) == F.col(predicted)).alias("hit"))
    c = sides.groupBy("s.label").agg(
        F.sum(F.when((F.col("s.side") == "t") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s.side") == "t", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.side") == "p", F.col("n")).otherwise(0)).alias("predicted"))
    pr = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rc = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return c.select("label", "tp", "support", pr.alias("precision"), rc.alias("recall"),
                    F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0).alias("f1"))


def macro_scores(report: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1 and the majority baseline from a class report."""
    return report.agg(
        F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"),
        F.round(F.avg(F.when(F.col("support") > 0, F.col("recall"))), 6).alias("balanced_accuracy"),
        F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.max("support") / F.sum("support"), 6).alias("majority_accuracy"),
        F.round(1 / F.count_if(F.col("support") > 0), 6).alias("majority_balanced"))


def text_baseline(train: DataFrame, test: DataFrame, text: str, label: str, features: int = 1 << 16):
    """TF-IDF with a class-balanced logistic regression (Spark ML): predictions for ``test``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    n = train.groupBy(label).agg(F.count("*").alias("_n"))
    total = train.agg(F.count("*").alias("_t"), F.count_distinct(label).alias("_k"))
    weights = n.join(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("_w"))  # one row per class
    weighted = with_small(train, weights, label, "inner").withColumn("label", F.col(label).cast("double"))
    pipeline = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", weightCol="_w", maxIter=20)])
    return pipeline.fit(weighted).transform(test).select(*test.columns, F.col("prediction").cast("int").alias("predicted"))


def score_band(score: Column) -> Column:
    return (F.when(score.isNull(), "missing").when(score < 0.12, "<.12").when(score < 0.30, ".12-.30").when(score < 0.50, ".30-.50")
            .when(score < 0.70, ".50-.70").otherwise(">=.70"))


def histogram(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Counts per (dimension, value) of several columns in one pass."""
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("dimension"), F.coalesce(c.cast("string"), F.lit("none")).alias("value")) for n, c in columns.items()])).alias("x"))
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("events"))


def gold_frontier(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frontier cases from gold history: per work a *new* case (first event) and an *attach* case (second event).

    Returns the cases and the candidates per user, stored once: the candidates of a case are those of its user, without
    ``excluded_work``. ``history`` has ``user_id, work, event_id, seq, text``.
    """
    from loomtrace.operators.ordered import top_rows
    two = top_rows(history, ["user_id", "work"], [F.col("seq")], 2).groupBy("user_id", "work").agg(
        F.max(F.when(F.col("rank") == 1, F.col("event_id"))).alias("first_event"),
        F.max(F.when(F.col("rank") == 2, F.col("event_id"))).alias("second_event"),
        F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("text"))
    candidates = two.select("user_id", "work", F.concat(F.lit("gold_"), "work").alias("candidate_id"), F.col("text").alias("durable_goal"))
    none = F.lit(None).cast("string")
    cases = two.select("user_id", "work", F.explode(F.array_compact(F.array(
        F.struct(F.col("first_event").alias("event_id"), F.lit("new").alias("kind"), F.col("work").alias("excluded_work"),
                 none.alias("gold_candidate")),
        F.when(F.col("second_event").isNotNull(), F.struct(
            F.col("second_event").alias("event_id"), F.lit("attach").alias("kind"), none.alias("excluded_work"),
            F.concat(F.lit("gold_"), "work").alias("gold_candidate")))))).alias("c"))
    return cases.select("user_id", "c.event_id", "c.kind", F.col("c.kind").alias("gold_action"), "c.excluded_work", "c.gold_candidate"), candidates


def frontier_candidates(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row per frontier case and candidate of its user, without the work that a *new* case is to begin; ``is_gold`` marks the right one.

    As long as the answer: a user of n works has about 2 n cases of n candidates each.
    """
    both = cases.join(candidates, "user_id").filter(~F.col("work").eqNullSafe(F.col("excluded_work")))
    return both.select("user_id", "event_id", "gold_action", "candidate_id", "durable_goal",
                       F.coalesce(F.col("candidate_id") == F.col("gold_candidate"), F.lit(False)).alias("is_gold"))
