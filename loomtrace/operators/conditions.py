"""How much a history helps: one classifier on the current message alone, with the right history, and with that of another message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.operators import corpus

CONDITIONS = ("current_only", "wrong_history", "correct_history")


def in_test(key: Column, share: float = 0.25) -> Column:
    """Grouped split: all rows of a key are on one side, by the first two digits of its hash."""
    return F.substring(F.sha2(key.cast("string"), 256), 1, 2) < f"{round(share * 256):02x}"


def balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """``label, n, weight``: rows / (classes * rows of the class), so that every class weighs the same."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    return counts.join(F.broadcast(total)).select(label, "n", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))  # one row


def with_wrong_history(rows: DataFrame, id_: str, previous: str) -> DataFrame:
    """``wrong_previous``: the history of another row of the same side, the next in order of a hash; a row alone on its side gets its own."""
    sides = [corpus.derangement(rows.filter(F.col("is_test") == side), id_, F.col(previous), "wrong_previous") for side in (False, True)]
    return sides[0].unionByName(sides[1])


def texts(rows: DataFrame, previous: str, current: str) -> DataFrame:
    """A row per condition with the text that the classifier sees, ``seen``."""
    both = lambda c: F.concat_ws("\n", F.col(c), F.col(current))
    each = [F.struct(F.lit(n).alias("condition"), t.alias("seen")) for n, t in zip(CONDITIONS, (F.col(current), both("wrong_previous"), both(previous)), strict=True)]
    return rows.select("*", F.explode(F.array(*each)).alias("_x")).select(*rows.columns, "_x.*")


def text_classifier(train: DataFrame, text: str, label: str, vocabulary: int = 10_000, iterations: int = 200):
    """TF-IDF of words and pairs of words (the ``vocabulary`` most frequent terms, smoothed idf, unit length) and a multinomial logistic
    regression with balanced classes, run to convergence. The model is as large as vocabulary times classes, whatever the rows are."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import (IDF, CountVectorizer, ElementwiseProduct, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer,
                                    StringIndexer)
    from pyspark.ml.linalg import DenseVector
    weights = balanced_weights(train, label).select(label, F.col("weight").alias("_w"))
    weighted = train.join(F.broadcast(weights), label)
    words = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False), NGram(n=2, inputCol="_words", outputCol="_pairs"),
             SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
             CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocabulary), IDF(inputCol="_tf", outputCol="_idf")]
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(train)
    front = Pipeline(stages=words).fit(weighted)
    idf = front.stages[-1].idf.toArray() + 1.0
    scale = ElementwiseProduct(inputCol="_tf", outputCol="_scaled", scalingVec=DenseVector(idf))
    unit = Normalizer(inputCol="_scaled", outputCol="_x", p=2.0)
    prepared = unit.transform(scale.transform(front.transform(indexer.transform(weighted))))
    n = prepared.count()
    model = LogisticRegression(featuresCol="_x", labelCol="_label", weightCol="_w", maxIter=iterations, tol=1e-8, regParam=1.0 / max(n, 1),
                               standardization=False, family="multinomial").fit(prepared)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)

    def predict(rows: DataFrame) -> DataFrame:
        made = back.transform(model.transform(unit.transform(scale.transform(front.transform(rows)))))
        return made.select(*rows.columns, "predicted", "probability")
    return predict


def compared(rows: DataFrame, id_: str, key: str, previous: str, current: str, label: str, share: float = 0.25) -> DataFrame:
    """Predictions for the test rows under each condition: ``condition``, the given columns, ``predicted``."""
    split = rows.withColumn("is_test", in_test(F.col(key), share))
    each = texts(with_wrong_history(split, id_, previous), previous, current)
    out = None
    for condition in CONDITIONS:
        own = each.filter(F.col("condition") == condition)
        made = text_classifier(own.filter("NOT is_test"), "seen", label)(own.filter("is_test")).drop("probability")
        out = made if out is None else out.unionByName(made)
    return out
