"""Model-input building and benchmark corpora."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomtrace.operators import ordered


def model_inputs(lines: DataFrame, key: str, position: str, line: str, history_chars: int, current_chars: int) -> DataFrame:
    """Per key the newline-joined tail of its history and the head of its last line.

    Only the last ``history_chars`` characters of a history are wanted, so lines are kept from the end until they
    suffice: a reverse running length drops the rest before anything is gathered. A joined line adds at least one
    character, so at most ``history_chars + 2`` last lines can matter; only those of a key reach its task.
    """
    sized = ordered.top_rows(lines.select(key, position, line), [key], [F.desc(position)], history_chars + 2).drop("rank")
    last = sized.groupBy(key).agg(F.max_by(F.struct(position, line), position).alias("c"))
    w = Window.partitionBy(key).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.sum(F.length(line) + 1).over(w), F.lit(0))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    ranked = sized.withColumn("_after", after).withColumn("_n", newest)
    current_len = F.first(F.when(F.col("_n") == 1, F.length(line) + 1), True).over(
        Window.partitionBy(key).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, 0))
    kept = ranked.withColumn("_cur", current_len).filter(
        (F.col("_n") > 1) & (F.col("_after") - F.col("_cur") <= history_chars))
    history = kept.groupBy(key).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(position, line))), lambda x: x[line]), "\n").alias("h"))
    return last.join(history, key, "left").select(
        key, F.right(F.coalesce("h", F.lit("")), F.lit(history_chars)).alias("history"),
        F.substring(F.col(f"c.{line}"), 1, current_chars).alias("current"))


def leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys present in both sets; must be empty for a clean split."""
    return train.select(key).distinct().join(test.select(key), key, "left_semi")


def pending_cases(cases: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cases without a stored result."""
    return cases.join(done.select(*keys), keys, "left_anti")


def resume_mismatches(cases: DataFrame, done: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Stored results whose case content differs from the current case."""
    stored = done.select(*keys, F.col(digest).alias("stored_digest"))
    return cases.join(stored, keys).filter(~F.col(digest).eqNullSafe(F.col("stored_digest")))


def derangement(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Pair each row with the value of another row: its cyclic successor in the order of a hash of the key."""
    hashed = rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).withColumn("_one", F.lit(1))
    out = ordered.next_value(hashed, ["_one"], ["_h"], F.substring("_h", 1, 2), value, name, cyclic=True)
    return out.drop("_h", "_one")


def taxonomy_sha(version: str, maturity: dict[str, str]) -> str:
    """Digest of a taxonomy: its version and the maturity of each signal, in order of the signals."""
    return sha256(":".join([version, *(f"{n}={m}" for n, m in sorted(maturity.items()))]).encode()).hexdigest()


def taxonomy_table(spark: SparkSession, version: str, maturity: dict[str, str]) -> DataFrame:
    """``signal, maturity, taxonomy_version, taxonomy_sha256``, to be stored; every row carries the digest of the whole."""
    digest = taxonomy_sha(version, maturity)
    return spark.createDataFrame([(n, m, version, digest) for n, m in maturity.items()], "signal string, maturity string, taxonomy_version string, taxonomy_sha256 string")


def verified_taxonomy(table: DataFrame) -> DataFrame:
    """A stored taxonomy whose digest fits its rows; ``ValueError`` where it was changed. A taxonomy is a short list that people keep."""
    rows = table.collect()
    for version in {r.taxonomy_version for r in rows}:
        own = [r for r in rows if r.taxonomy_version == version]
        if {r.taxonomy_sha256 for r in own} != {taxonomy_sha(version, {r.signal: r.maturity for r in own})}:
            raise ValueError(f"taxonomy {version} does not fit its digest")
    return table
