"""Sums of fixed-size vectors over all tasks, made by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomtrace.llm.arrow import map_batches


def total(df: DataFrame, length: int, dtype: type, fill: Callable[[], Callable[[pa.RecordBatch, np.ndarray], None]], blocks: int = 64) -> np.ndarray:
    """The sum over all tasks of a vector that ``fill()(batch, vector)`` adds to.

    A task holds one vector and hands on its blocks that are not zero, compressed; blocks are added up behind a shuffle by block.
    Only the sum, whose size the caller fixes, comes to the driver.
    """
    width = -(-length // blocks)

    def count() -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
        def run(batches):
            step, out = fill(), np.zeros(length, dtype=dtype)
            for batch in batches:
                step(batch, out)
            parts = {i: out[i * width:(i + 1) * width] for i in range(blocks)}
            some = [i for i, p in parts.items() if p.any()]
            if some:
                yield {"block": some, "sums": [zlib.compress(parts[i].tobytes(), 1) for i in some]}
        return run

    def add() -> Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]:
        def run(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part = np.frombuffer(zlib.decompress(packed), dtype=dtype)
                    sums[block] = sums[block] + part if block in sums else part
            if sums:
                yield {"block": list(sums), "sums": [s.tobytes() for s in sums.values()]}
        return run

    counted = map_batches(df, "block int, sums binary", count)
    out = np.zeros(length, dtype=dtype)
    for row in map_batches(counted.repartition(max(1, blocks // 4), "block"), "block int, sums binary", add).collect():
        out[row.block * width:(row.block + 1) * width] = np.frombuffer(row.sums, dtype=dtype)
    return out
