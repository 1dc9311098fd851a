"""Exact centroid clustering with sharded dimensions.

Vectors of integers are stored once as column blocks: a row holds some columns of a chunk of vectors. In each round a task adds up squared
differences between its columns and the same columns of all centroids, the partial distances of a chunk are added over its blocks, and
each vector goes to the nearest centroid. Then every block sums its own columns by cluster and moves its own slice of the centroids. No
task holds all columns of the centroids, and nothing that grows with the vectors comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.arrow import map_batches
from loomtrace.llm.registry import table
from loomtrace.session import durable, release

#: Slices of centroids, or labels of vectors, are broadcast if their counted bytes are no more than this, else joined by shuffle.
BROADCAST_BYTES = 32_000_000


@dataclass(frozen=True)
class Settings:
    """``k`` centroids, ``rounds`` of moving them, vectors of ``dims`` components cut into ``blocks``, at most ``chunk`` vectors in a row.

    A component x becomes floor(``scale`` * x). ``seed`` is the text before the id in the hash that picks the first centroids.
    """

    k: int = 40
    rounds: int = 5
    dims: int = 64
    blocks: int = 4
    chunk: int = 2048
    scale: int = 256
    seed: str = "2:"

    @property
    def edges(self) -> list[int]:
        return [self.dims * b // self.blocks for b in range(self.blocks + 1)]

    @property
    def limit(self) -> int:
        """Least absolute value of a scaled component that could lead a squared distance out of 64 bits."""
        return 1 << ((62 - (self.dims - 1).bit_length()) // 2 - 1)


def kept(vectors: DataFrame, s: Settings) -> DataFrame:
    """``vec_id, v``: the vectors of ``dims`` finite components as integers."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) * s.scale < s.limit))  # neither NaN, which is largest, nor infinite
    return vectors.filter((F.size("embedding") == s.dims) & fine).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * s.scale).cast("bigint")).alias("v"))


def column_blocks(vectors: DataFrame, s: Settings) -> DataFrame:
    """``chunk, block, n, cells, ids``: ``cells`` are 32-bit integers, row by row; ``ids`` stands in block 0 only."""
    def make():
        def run(batches):
            part, number = TaskContext.get().partitionId() << 32, 0
            for batch in batches:
                ids, values = batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy().reshape(-1, s.dims).astype(np.int32)
                for lo in range(0, len(ids), s.chunk):
                    rows = values[lo:lo + s.chunk]
                    yield {"chunk": [part + number] * s.blocks, "block": list(range(s.blocks)), "n": [len(rows)] * s.blocks,
                           "cells": [rows[:, a:b].tobytes() for a, b in zip(s.edges, s.edges[1:])],
                           "ids": [ids[lo:lo + s.chunk]] + [None] * (s.blocks - 1)}
                    number += 1
        return run

    return map_batches(vectors.select("vec_id", "v"), "chunk bigint, block int, n int, cells binary, ids array<bigint>", make)


def first_slices(vectors: DataFrame, s: Settings) -> tuple[DataFrame, int]:
    """``block, centre`` (all centroids' columns, one centroid after the other) of the vectors of least hash, and their number."""
    spark = vectors.sparkSession
    digest = F.sha2(F.concat(F.lit(s.seed), F.col("vec_id").cast("string")), 256)
    rows = vectors.filter("vec_id IS NOT NULL").select(digest.alias("digest"), "v").orderBy("digest", "v").limit(s.k).collect()
    made = [(b, [x for r in rows for x in r.v[lo:hi]]) for b, (lo, hi) in enumerate(zip(s.edges, s.edges[1:]))]
    return spark.createDataFrame(made, "block int, centre array<bigint>"), len(rows)


def _few(table_: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(table_) if n_bytes <= BROADCAST_BYTES else table_


def partial_distances(cells: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances in these columns, exact: by floating point only while every number is a whole one below 2**53."""
    largest = max(int(np.abs(cells).max(initial=0)), int(np.abs(centre).max(initial=0)))
    kind = np.float64 if 4 * cells.shape[1] * largest * largest < 1 << 53 else np.int64
    x, c = cells.astype(kind), centre.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def assigned(blocks: DataFrame, slices: DataFrame, k: int, s: Settings) -> DataFrame:
    """``chunk, labels, distances``: for each chunk the nearest centroid of its vectors (of equal ones the first) and how far it is."""
    def make():
        def run(batches):
            for batch in batches:
                chunk, n, cells, centre = (batch.column(i) for i in range(4))
                parts = []
                for i in range(batch.num_rows):
                    x = np.frombuffer(cells[i].as_buffer(), dtype=np.int32).reshape(n[i].as_py(), -1)
                    d = partial_distances(x, centre[i].values.to_numpy().reshape(k, -1))
                    parts.append((d.astype(np.int32) if d.max(initial=0) < 1 << 31 else d).tobytes())
                yield {"chunk": chunk, "n": n, "part": parts}
        return run

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        total = np.zeros((n, k), dtype=np.int64)
        for part in rows["part"]:
            total += np.frombuffer(part, dtype=np.int32 if len(part) == 4 * n * k else np.int64).reshape(n, k)
        labels = total.argmin(axis=1)
        return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "labels": [labels.astype(np.int32).tobytes()],
                             "distances": [total[np.arange(n), labels].tobytes()]})

    both = blocks.join(_few(slices, 8 * k * s.dims), "block").select("chunk", "n", "cells", "centre")
    parts = map_batches(both, "chunk bigint, n int, part binary", make)
    return parts.groupBy("chunk").applyInPandas(add, "chunk bigint, labels binary, distances binary")


def moved(blocks: DataFrame, slices: DataFrame, labels: DataFrame, n: int, k: int, s: Settings) -> DataFrame:
    """``slices`` after every block has moved its columns of the centroids to the floor of their vectors' mean."""
    def sums():
        def run(batches):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                block, cells, label = (batch.column(i) for i in range(3))
                for i in range(batch.num_rows):
                    of = np.frombuffer(label[i].as_buffer(), dtype=np.int32)
                    x = np.frombuffer(cells[i].as_buffer(), dtype=np.int32).reshape(len(of), -1)
                    b = block[i].as_py()
                    if b not in out:
                        out[b] = np.zeros((k, x.shape[1] + 1), dtype=np.int64)  # the last column counts
                    order = np.argsort(of, kind="stable")
                    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
                    out[b][of[order][starts], :-1] += np.add.reduceat(x[order].astype(np.int64), starts, axis=0)
                    out[b][:, -1] += np.bincount(of, minlength=k)
            if out:
                yield {"block": list(out), "centre": [None] * len(out), "sums": [v.ravel() for v in out.values()]}
        return run

    def move():
        def run(batches):
            old, total = {}, {}
            for batch in batches:
                block, centre, sums_ = (batch.column(i) for i in range(3))
                for i in range(batch.num_rows):
                    b = block[i].as_py()
                    if sums_[i].is_valid:
                        total[b] = total.get(b, 0) + sums_[i].values.to_numpy()
                    else:
                        old[b] = centre[i].values.to_numpy().reshape(k, -1)
            for b, centre in old.items():
                cells = total[b].reshape(k, -1)
                count = cells[:, -1:]
                new = np.where(count > 0, cells[:, :-1] // np.maximum(count, 1), centre)
                yield {"block": [b], "centre": [new.ravel()]}
        return run

    schema = "block int, centre array<bigint>, sums array<bigint>"
    both = blocks.join(_few(labels, 4 * n), "chunk").select("block", "cells", "labels")
    parts = map_batches(both, schema, sums).union(slices.select("block", "centre", F.lit(None).cast("array<bigint>").alias("sums")))
    return map_batches(parts.repartition(s.blocks, "block"), "block int, centre array<bigint>", move)


def clustered(vectors: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """``vec_id, cluster, distance`` (squared) for every vector kept, and ``cluster, centre`` (its components in order).

    ``vectors`` has ``vec_id, embedding``. Kept are vectors of exactly ``dims`` components that are neither null nor non-finite; also left
    out are those with a scaled component of ``Settings.limit`` (134,217,728 for 64 dimensions) or more, whose distances would not fit a
    long. A null ``vec_id`` is clustered and never a first centroid. Rows that repeat are vectors of their own; where the first
    centroids' ids tie, the smaller vector goes first. With fewer than ``k`` kept vectors there are as many centroids; without any, or
    without an id among them, both results are empty. Ties go to the smaller cluster number. Empty clusters keep their centroid.
    """
    spark, ints = vectors.sparkSession, kept(vectors, s)
    slices, k = first_slices(ints, s)
    if not k:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), spark.createDataFrame([], "cluster int, centre array<bigint>")
    blocks = durable(column_blocks(ints, s))
    n = blocks.filter("block = 0").agg(F.sum("n")).first()[0]
    slices = durable(slices)
    for _ in range(s.rounds):
        labels = durable(assigned(blocks, slices, k, s).drop("distances"))
        new = durable(moved(blocks, slices, labels, n, k, s))
        release(labels, slices)
        slices = new

    def rows():
        def run(batches):
            for batch in batches:
                ids, labels, far = (batch.column(i) for i in range(3))
                of = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int32) for x in labels])
                yield {"vec_id": ids.flatten(), "cluster": of, "distance": np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in far])}
        return run

    last = assigned(blocks, slices, k, s).join(blocks.filter("block = 0").select("chunk", "ids"), "chunk").select("ids", "labels", "distances")
    out = durable(map_batches(last, "vec_id bigint, cluster int, distance bigint", rows))
    width = (F.size("centre") / k).cast("int")
    each = slices.select("block", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"), "centre", width.alias("width"))
    part = F.struct("block", F.expr("slice(centre, cluster * width + 1, width)").alias("part"))
    centres = durable(each.groupBy("cluster").agg(F.array_sort(F.collect_list(part)).alias("parts")).select("cluster", F.flatten("parts.part").alias("centre")))
    release(blocks, slices)
    return out, centres


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster, its squared distance, the inertia of its cluster and of all, and its final centroid's digest."""
    s = Settings()
    out, centres = clustered(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), s)
    inertia = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = inertia.agg(F.coalesce(F.sum("cluster_inertia"), F.lit(0))).first()[0]
    of = centres.select("cluster", F.sha2(F.array_join(F.transform("centre", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))
    of = _few(inertia.join(of, "cluster"), 200 * s.k)
    return out.join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("bigint").alias("inertia"), "centroid_sha256")


def _oracle(s: Settings) -> str:
    near = lambda i: f"""a{i} AS MATERIALIZED (SELECT n, min(struct_pack(d := (xx - 2 * list_inner_product(x, y) + yy)::BIGINT, c := c)) AS b
  FROM kept, (SELECT c, v::DOUBLE[] AS y, list_inner_product(v::DOUBLE[], v::DOUBLE[]) AS yy FROM c{i}) GROUP BY n)"""  # noqa: E731
    move = lambda i: f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m, c{i}.v) AS v FROM c{i} LEFT JOIN (
  SELECT c, list(f ORDER BY i) AS m FROM (SELECT b.c AS c, i, floor(sum(v[i]) / count(*))::BIGINT AS f
    FROM kept JOIN a{i} USING (n), (SELECT unnest(generate_series(1, {s.dims})) AS i) GROUP BY ALL) GROUP BY c) USING (c))"""  # noqa: E731
    rounds = ",\n".join(f"{near(i)},\n{move(i)}" for i in range(s.rounds))
    return f"""WITH kept AS MATERIALIZED (SELECT *, v::DOUBLE[] AS x, list_inner_product(v::DOUBLE[], v::DOUBLE[]) AS xx FROM (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda e: floor({s.scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {s.dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {s.dims})),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{s.seed}' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {s.k}),
{rounds},
{near(s.rounds)},
o AS (SELECT vec_id, b.c::INT AS cluster, b.d AS distance FROM kept JOIN a{s.rounds} USING (n))
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256 FROM o JOIN c{s.rounds} ON c = cluster"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLES = {"op13_centroid_clustering": _oracle(Settings())}
