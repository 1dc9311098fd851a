"""Ordered scans that do not hold a whole key in one task.

A window over ``PARTITION BY trajectory`` puts all rows of a hot trajectory into one task. Here a key is cut
into consecutive *chunks* (an expression that never decreases along the order, e.g. the day of the
timestamp). Rows are windowed inside ``(key, chunk)``; what must cross a chunk border travels through one
summary row per chunk, and only those summaries are windowed per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _columns(names):
    return [F.col(n) if isinstance(n, str) else n for n in names]


def last_before(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, values: dict[str, Column]
) -> DataFrame:
    """Add, per row, the last non-null value of each expression strictly before it within its key."""
    names = list(values)
    base = df.select("*", *[values[n].alias(f"_v_{n}") for n in names], chunk.alias("_chunk"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, -1)
    local = base.select("*", *[F.last(f"_v_{n}", True).over(inside).alias(f"_l_{n}") for n in names])

    position = F.struct(*_columns(order))
    summary = base.groupBy(*keys, "_chunk").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_s_{n}") for n in names]
    )
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "_chunk", *[F.last(f"_s_{n}", True).over(across).alias(f"_c_{n}") for n in names]
    )
    return (
        local.join(carry, [*keys, "_chunk"], "left")
        .select(*df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in names])
    )


def next_value(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, name: str, cyclic: bool = False
) -> DataFrame:
    """Add, per row, ``value`` of the following row of its key (of the first row after the last, if cyclic)."""
    base = df.select("*", value.alias("_v"), chunk.alias("_chunk"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*_columns(order))
    local = base.select("*", F.lead(F.struct("_v")).over(inside).alias("_next"))
    position = F.struct(*_columns(order))
    summary = base.groupBy(*keys, "_chunk").agg(F.min_by(F.struct("_v"), position).alias("_first"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    following = F.lead("_first").over(across)
    if cyclic:
        whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        following = F.coalesce(following, F.first("_first").over(whole))
    carry = summary.select(*keys, "_chunk", following.alias("_after"))
    return (
        local.join(carry, [*keys, "_chunk"], "left")
        .select(*df.columns, F.coalesce("_next", "_after").getField("_v").alias(name))
    )


def running_max_before(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """Add, per row, the maximum of ``value`` over the earlier rows of its key (null when there is none)."""
    base = df.select("*", value.alias("_v"), chunk.alias("_chunk"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, -1)
    local = base.select("*", F.max("_v").over(inside).alias("_l"))
    summary = base.groupBy(*keys, "_chunk").agg(F.max("_v").alias("_m"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_chunk", F.max("_m").over(across).alias("_c"))
    return (
        local.join(carry, [*keys, "_chunk"], "left")
        .select(*df.columns, F.greatest("_l", "_c").alias(name))
    )


def running_totals(df: DataFrame, keys: list[str], order: list[str], chunk: Column, values: dict[str, Column]) -> DataFrame:
    """Add, per row, the sum of each expression over the rows of its key up to and with it."""
    base = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()], chunk.alias("_chunk"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = base.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in values])
    summary = base.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_chunk", *[F.sum(f"_s_{n}").over(across).alias(f"_c_{n}") for n in values])
    return (
        local.join(carry, [*keys, "_chunk"], "left")
        .select(*df.columns, *[(F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).cast("long").alias(n) for n in values])
    )


def bounded_pieces(df: DataFrame, keys: list[str], time: str, number: str, first: Column, most: int = 50_000, name: str = "piece") -> DataFrame:
    """Add a chunk column that never decreases along ``(time, number)`` and holds about ``most`` rows of a key at most.

    ``first`` is a coarse chunk, such as the day. Where a key has more rows in one, it is cut at quantiles of ``time``; a border time is a
    piece of its own, so that many rows of one time are there together, and is cut by ``number``, a unique whole number. Only keys with
    such chunks are looked at a second time.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    base = df.withColumn("_first", first)
    busy = base.groupBy(*keys, "_first").agg(F.count("*").alias("_rows")).filter(F.col("_rows") > most)
    n_busy, largest = busy.agg(F.count("*"), F.max("_rows")).first()
    none = F.lit(0).cast("long")
    if not n_busy:
        return base.withColumn(name, F.struct(F.col("_first").alias("first"), none.alias("at"), none.alias("part"))).drop("_first")
    cuts = min(-(-largest // most), 10_000)
    shares = F.array(*(F.lit(i / cuts) for i in range(1, cuts)))
    hot = base.join(busy.select(*keys, "_first"), [*keys, "_first"], "left_semi")
    borders = hot.groupBy(*keys, "_first").agg(F.percentile_approx(micros, shares, 20 * cuts).alias("_borders"))
    borders = F.broadcast(borders) if n_busy * cuts <= 1_000_000 else borders
    rows = base.join(borders, [*keys, "_first"], "left")
    marks = F.array_distinct(F.coalesce("_borders", F.array().cast("array<double>")))
    before, on = F.size(F.filter(marks, lambda b: b < micros)), F.array_contains(marks, micros)
    piece = F.struct(F.col("_first").alias("first"), (2 * before + on.cast("int")).cast("long").alias("at"),
                     F.when(on, F.floor(F.col(number) / most)).otherwise(0).cast("long").alias("part"))
    return rows.withColumn(name, piece).select(*df.columns, name)


def ordinal(df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    base = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*_columns(order))
    local = base.withColumn("_rn", F.row_number().over(inside))
    summary = base.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_off"))
    return (
        local.join(carry, [*keys, "_chunk"], "left")
        .select(*df.columns, (F.col("_rn") + F.col("_off")).cast("long").alias(name))
    )


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark limits each group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
