"""Group-scoped TF-IDF, continuity of threads, and exact similarity pairs of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.operators import ordered
from loomtrace.session import by_key, durable, release

TOKEN = r"[\p{L}\p{N}_]{2,}"

# Default stop words: an own short list of closed-class English words. Pass another list to match another vectorizer.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between "
    "both but by can cannot could did do does doing down during each few for from further had has have having he her "
    "here hers herself him himself his how if in into is it its itself just me more most my myself no nor not now of "
    "off on once only or other our ours ourselves out over own same she should so some such than that the their theirs "
    "them themselves then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your yours yourself yourselves still"
).split()


def tokens(text: Column, stop: list[str]) -> Column:
    """Lower-cased word tokens of two or more characters without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def term_counts(pieces: DataFrame, keys: list[str], stop: list[str] | None = None) -> DataFrame:
    """Counts of uni- and bigrams per document. ``pieces`` has the document keys and ``text``, one row each."""
    stop = STOP_WORDS if stop is None else stop
    cut = pieces.select(*keys, tokens(F.col("text"), stop).alias("t"))
    return _count_terms(cut, keys)


def _count_terms(cut: DataFrame, keys: list[str]) -> DataFrame:
    return _terms(cut, keys).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def _terms(cut: DataFrame, keys: list[str]) -> DataFrame:
    """The uni- and bigrams of the token lists ``t``, a row each. A list becomes a hundred times its bytes before its terms are counted, so
    lists are dealt to a number of tasks that is not merged by their bytes, also those of one document."""
    cut = by_key(cut, *keys, F.xxhash64("t"))
    pairs = F.when(F.size("t") > 1, F.zip_with(
        F.expr("slice(t, 1, size(t) - 1)"), F.expr("slice(t, 2, size(t) - 1)"), lambda a, b: F.concat_ws(" ", a, b)
    )).otherwise(F.array().cast("array<string>"))
    # the outer form keeps the optimizer from evaluating the token list once more as a "not empty" filter
    return cut.select(*keys, F.explode_outer(F.concat("t", pairs)).alias("term")).filter("term is not null")


def joined_term_counts(pieces: DataFrame, keys: list[str], position: str, chunk: Column,
                       stop: list[str] | None = None) -> DataFrame:
    """Term counts of documents made of many pieces joined by blanks, without building the joined text.

    A bigram across two pieces is the last token of one and the first token of the next non-empty one.
    """
    stop = STOP_WORDS if stop is None else stop
    cut = pieces.select(*keys, position, tokens(F.col("text"), stop).alias("t")).filter(F.size("t") > 0)
    inner = _terms(cut.select(*keys, "t"), keys)
    ends = cut.select(*keys, position, F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))
    linked = ordered.last_before(ends, keys, [position], chunk, {"prior": F.col("last")})
    across = linked.filter("prior is not null").select(
        *keys, F.concat_ws(" ", "prior", "first").alias("term"))
    return inner.unionByName(across).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, documents: DataFrame, group: list[str], doc: str) -> DataFrame:
    """L2-normalized weights ``tf * (ln((1+n)/(1+df)) + 1)`` with n and df taken inside each group.

    ``documents`` has one row per (group, doc), also for documents without any term.
    """
    # stored, as the terms are made from text; dealt to a number of tasks that is not merged, as counts are many times their bytes
    counts = by_key(durable(counts), *group, "term")
    n = documents.groupBy(*group).agg(F.count("*").alias("n"))
    df = counts.groupBy(*group, "term").agg(F.count("*").alias("df"))
    idf = df.join(n, group).select(*group, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = counts.join(idf, [*group, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    norms = weights.groupBy(*group, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, [*group, doc]).select(*group, doc, "term", (F.col("w") / F.col("norm")).alias("w"))


def continuity(texts: DataFrame, group: list[str], doc: str, stop: list[str] | None = None) -> DataFrame:
    """Mean cosine of consecutive texts per group, and one minus it.

    ``texts``: group keys, ``doc`` (1-based ordinal) and ``text``. Groups of one text, or without any term, get 0, 0.
    The products are summed by aggregation over (group, pair, term); no document is joined with another.
    """
    documents = texts.select(*group, doc)
    weights = tfidf(term_counts(texts, [*group, doc], stop), documents, group, doc)
    roles = weights.select(*group, "term", "w", F.explode(F.array(
        F.struct(F.col(doc).alias("pair"), F.lit(0).alias("role")),
        F.struct((F.col(doc) + 1).alias("pair"), F.lit(1).alias("role")))).alias("r"))
    products = roles.groupBy(*group, "r.pair", "term").agg(
        (F.coalesce(F.sum(F.when(F.col("r.role") == 0, F.col("w"))), F.lit(0.0))
         * F.coalesce(F.sum(F.when(F.col("r.role") == 1, F.col("w"))), F.lit(0.0))).alias("p"))
    summed = products.groupBy(*group).agg(F.sum("p").alias("s"))
    counts = documents.groupBy(*group).agg(F.count("*").alias("m"))
    both = counts.join(summed, group, "left")
    usable = (F.col("m") > 1) & F.col("s").isNotNull()
    mean = F.col("s") / (F.col("m") - 1)
    return both.select(
        *group, F.when(usable, F.round(mean, 4)).otherwise(F.lit(0.0)).alias("continuity"),
        F.when(usable, F.round(1 - mean, 4)).otherwise(F.lit(0.0)).alias("evolution"))


def query_scores(queries: DataFrame, thread_counts: DataFrame, threads: DataFrame, group: list[str], thread: str,
                 stop: list[str] | None = None) -> DataFrame:
    """Cosine of one query text per group against each thread document of the group.

    ``queries``: group, ``text``; ``thread_counts``: group, thread, term, tf; ``threads``: group, thread. The corpus of
    a group is its threads and its query.
    """
    asked = queries.withColumn(thread, F.lit(None).cast(threads.schema[thread].dataType))
    tagged = lambda d: d.withColumn("_doc", F.concat(F.lit("t:"), F.col(thread)))
    query_counts = term_counts(queries.select(*group, "text"), group, stop).withColumn("_doc", F.lit("q"))
    counts = tagged(thread_counts).select(*group, "_doc", "term", "tf").unionByName(
        query_counts.select(*group, "_doc", "term", "tf"))
    documents = tagged(threads).select(*group, "_doc").unionByName(asked.select(*group, F.lit("q").alias("_doc")))
    w = tfidf(counts, documents, group, "_doc")
    q = w.filter("_doc = 'q'").select(*group, "term", F.col("w").alias("wq"))
    t = w.filter("_doc <> 'q'")
    dots = t.join(q, [*group, "term"]).groupBy(*group, "_doc").agg(F.sum(F.col("w") * F.col("wq")).alias("score"))
    return tagged(threads).join(queries.select(*group), group, "left_semi").join(dots, [*group, "_doc"], "left").select(
        *[c for c in threads.columns], F.coalesce("score", F.lit(0.0)).alias("score"))


def pair_tfidf(pairs: DataFrame, key: str, left: str, right: str, stop: list[str] | None = None) -> DataFrame:
    """TF-IDF cosine of two texts per row, the two texts being the whole corpus."""
    sides = pairs.select(key, F.explode(F.array(
        F.struct(F.lit(1).alias("doc"), F.col(left).alias("text")),
        F.struct(F.lit(2).alias("doc"), F.col(right).alias("text")))).alias("d")).select(key, "d.doc", "d.text")
    counts = term_counts(sides, [key, "doc"], stop)
    terms = counts.groupBy(key, "term").agg(
        F.coalesce(F.sum(F.when(F.col("doc") == 1, F.col("tf"))), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.when(F.col("doc") == 2, F.col("tf"))), F.lit(0)).alias("b"))
    df = F.when(F.col("a") > 0, 1).otherwise(0) + F.when(F.col("b") > 0, 1).otherwise(0)
    idf = F.log(F.lit(3.0) / (1 + df)) + 1
    sums = terms.withColumns({"x": F.col("a") * idf, "y": F.col("b") * idf}).groupBy(key).agg(
        F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"),
        F.sum(F.col("y") * F.col("y")).alias("yy"))
    score = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return pairs.join(sums, key, "left").select(pairs["*"], F.coalesce(score, F.lit(0.0)).alias("score"))


#: Vectors that are compared with others at once in a task.
STRIP = 512


def similar_pairs(vectors: DataFrame, threshold: float, pivot_count: int | None = None, block_rows: int = 8192, most_pivots: int = 512) -> DataFrame:
    """All pairs of distinct vectors with cosine >= threshold, exact.

    ``vectors``: ``id``, ``trajectory_id``, ``embedding``. Equal vectors are collapsed first, so a large group of copies
    is one row with counts and not a square of pairs. Each of the rest belongs to the cell of its nearest pivot; cells are packed
    into blocks of at most ``block_rows`` vectors (larger ones cut), each task compares two blocks, and pairs of blocks of which no
    two cells can hold partners (triangle inequality on angles) are left out. So a vector is sent once for each block that its own
    may meet, and a task holds two blocks, whether the vectors have clusters or not. Returns ``id_a, id_b, similarity, pairs`` where
    ``pairs`` counts the pairs of copies that belong to different trajectories; pairs of equal vectors appear with ``id_a = id_b``
    if their cosine reaches the threshold, which that of zero vectors, 0, does only where it is not positive. By default there are
    as many pivots as the square root of the number of distinct vectors, at most ``most_pivots``.
    """
    members = durable(vectors.groupBy("embedding", "trajectory_id").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    distinct = durable(members.groupBy("embedding").agg(
        F.min("id").alias("id"), F.sum("n").alias("copies"), F.sum(F.col("n") * F.col("n")).alias("squares")))
    per_trajectory = members.join(distinct.select("embedding", F.col("id").alias("rep")), "embedding").select(
        "rep", "trajectory_id", "n")
    spark, n = vectors.sparkSession, distinct.count()
    pivot_count = pivot_count or min(most_pivots, max(16, math.isqrt(n)))
    chosen = distinct.orderBy(F.xxhash64("id"), "id").limit(pivot_count).select("embedding").collect()
    if not chosen:
        return spark.createDataFrame([], "id_a BIGINT, id_b BIGINT, similarity DOUBLE, pairs BIGINT")
    pivots = np.array([r[0] for r in chosen], dtype=np.float64)
    finite = np.isfinite(pivots).all(axis=1)
    pivots = _direction(pivots[finite]) if finite.any() else np.eye(1, pivots.shape[1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), STRIP):
                part = batch.iloc[at:at + STRIP]
                rows = np.array(part["embedding"].tolist(), dtype=np.float64).reshape(len(part), -1)
                finite = np.isfinite(rows).all(axis=1)  # the others have no angle
                part, rows = part[finite], rows[finite]
                if not len(part):
                    continue
                angle = np.arccos(np.clip(_direction(rows) @ pivots.T, -1.0, 1.0))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "cell": angle.argmin(axis=1).astype("int32"), "angle": angle.min(axis=1),
                                    "unit": list(_unit(rows))})

    placed = durable(distinct.select("id", "embedding").mapInPandas(assign, "id BIGINT, cell INT, angle DOUBLE, unit ARRAY<DOUBLE>"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).orderBy("cell").collect()  # at most pivot_count rows
    used = pivots[[r["cell"] for r in cells]]
    reach = np.array([r["reach"] for r in cells])
    apart = np.arccos(np.clip(used @ used.T, -1.0, 1.0))
    meet = apart <= reach[:, None] + reach[None, :] + math.acos(threshold) + 1e-6
    rows = min(block_rows, max(500, -(-n // 12)))  # some blocks also for few vectors, so that there are tasks for all cores
    first, parts, holds = _blocks(np.array([r["n"] for r in cells]), apart, rows)
    near = (holds @ meet.astype(np.float32) @ holds.T) > 0
    places = spark.createDataFrame([(r["cell"], int(f), int(k)) for r, f, k in zip(cells, first, parts)], "cell INT, first INT, parts INT")
    others = spark.createDataFrame([(i, np.flatnonzero(row).tolist()) for i, row in enumerate(near)], "b INT, others ARRAY<INT>")
    homes = placed.join(places, "cell").select("id", "unit", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("b"))
    copies = homes.join(others, "b").select("id", "unit", "b", F.explode("others").alias("o"))
    tasks = copies.select("id", "unit", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def compare(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        i, j = key
        sides: dict[int, list] = {i: [], j: []}
        for part in parts:
            for b, group in part.groupby("b"):
                sides[b].append((group["id"].to_numpy(), np.vstack(group["unit"].to_list())))
        if sides[i] and sides[j]:
            (ids, x), (other, y) = ((np.concatenate([k for k, _ in side]), np.vstack([u for _, u in side])) for side in (sides[i], sides[j]))
            for at in range(0, len(x), STRIP):
                cosine = x[at:at + STRIP] @ y.T
                a, b = np.nonzero(cosine >= threshold)
                ia, ib = ids[at + a], other[b]
                keep = (ia < ib) if i == j else (ia != ib)
                yield pd.DataFrame({"id_a": np.minimum(ia, ib)[keep], "id_b": np.maximum(ia, ib)[keep], "similarity": cosine[a, b][keep]})

    found = durable(by_key(tasks, "i", "j").groupBy("i", "j").applyInPandas(compare, "id_a BIGINT, id_b BIGINT, similarity DOUBLE"))
    release(placed)
    counts = distinct.select("id", "copies")
    sized = found.join(counts.toDF("id_a", "copies_a"), "id_a").join(counts.toDF("id_b", "copies_b"), "id_b")
    shared = (found.join(per_trajectory.toDF("id_a", "trajectory_id", "n_a"), "id_a")
              .join(per_trajectory.toDF("id_b", "trajectory_id", "n_b"), ["id_b", "trajectory_id"])
              .groupBy("id_a", "id_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("same")))
    between = sized.join(shared, ["id_a", "id_b"], "left").select(
        "id_a", "id_b", "similarity",
        (F.col("copies_a") * F.col("copies_b") - F.coalesce("same", F.lit(0))).cast("long").alias("pairs"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    own = (norm / (norm + 1e-8)) ** 2  # of the same unit vectors as above, so a zero vector is not similar to itself
    equal = distinct.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), own.alias("similarity"),
                            ((F.col("copies") * F.col("copies") - F.col("squares")) / 2).cast("long").alias("pairs"))
    out = durable(between.unionByName(equal.filter(F.col("similarity") >= threshold)).filter("pairs > 0"))
    release(members, distinct, found)
    return out


def _blocks(sizes: np.ndarray, apart: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cell its first block and the number of its blocks, and per block which cells it holds. Near cells share a block of at most ``rows``."""
    left, at, chain = np.ones(len(sizes), dtype=bool), 0, []
    while left.any():
        at = int(np.where(left, apart[at], np.inf).argmin())
        left[at] = False
        chain.append(at)
    first, parts, block, room = np.zeros(len(sizes), dtype=int), np.ones(len(sizes), dtype=int), -1, 0
    for cell in chain:
        if sizes[cell] > rows:  # hashing deals unevenly, so a part is planned somewhat smaller
            parts[cell] = -(-int(sizes[cell]) * 10 // (9 * rows))
            first[cell], block, room = block + 1, block + parts[cell], 0
        else:
            if sizes[cell] > room:
                block, room = block + 1, rows
            first[cell], room = block, room - sizes[cell]
    holds = np.zeros((block + 1, len(sizes)), dtype=np.float32)
    for cell in range(len(sizes)):
        holds[first[cell]:first[cell] + parts[cell], cell] = 1
    return first, parts, holds


def expanded_pairs(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id_a < id_b, similarity`` of all pairs of rows from different trajectories, from the pairs of distinct vectors.

    As long as the answer: n copies of one vector give a square of pairs. Where that is too long, ``pairs`` is the answer with counts.
    """
    # A representative is the smallest id of its vector; only vectors in a pair are looked up.
    reps = pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id"))).distinct()
    wanted = vectors.join(reps, "id", "left_semi").select(F.col("id").alias("rep"), "embedding")
    members = vectors.join(wanted, "embedding").select("rep", "id", "trajectory_id")
    both = pairs.join(members.toDF("id_a", "x", "tx"), "id_a").join(members.toDF("id_b", "y", "ty"), "id_b").filter(
        (F.col("tx") != F.col("ty")) & ((F.col("id_a") != F.col("id_b")) | (F.col("x") < F.col("y"))))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-8)


def _direction(rows: np.ndarray) -> np.ndarray:
    """Vectors of length 1, for angles; a zero vector stays zero, at a right angle to all."""
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def mean_pool(token_vectors: DataFrame, key: str, vector: str, start: str, end: str, position: str) -> DataFrame:
    """Mean of the token vectors whose position lies in ``[start, end)``, per key."""
    inside = token_vectors.filter((F.col(position) >= F.col(start)) & (F.col(position) < F.col(end)))
    flat = inside.select(key, F.posexplode(vector).alias("dim", "x"))
    means = flat.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))),
                                              lambda s: s["m"]).alias("pooled"))
