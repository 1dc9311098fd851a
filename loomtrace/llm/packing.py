"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt by hash into shards of about equal size, so no shard depends on how many documents there are. In a shard, the
longest piece goes first into the open bin that it fits best. If none has room, the bin size is opened that costs least for each token
it is expected to hold, judged by the pieces that are still to come; in the end each bin shrinks to the smallest size that
holds its contents.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.arrow import map_rows, utf8
from loomtrace.llm.registry import table
from loomtrace.session import durable


@dataclass(frozen=True)
class Packing:
    """Permitted sequence lengths, their cost, and about how many tokens a shard holds.

    A bin costs ``fixed`` + length * (1 + length / attention): padding, and attention that grows with the square of a length.
    """

    capacities: tuple[int, ...] = (512, 1024, 2048, 4096)
    fixed: float = 32.0
    attention: float = 16384.0
    shard_tokens: int = 4_000_000

    def cost(self, capacity: int) -> float:
        return self.fixed + capacity * (1 + capacity / self.attention)


def lengths(docs: DataFrame, count: Callable[[bytes], int] | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of whole texts. A token is a word between ASCII white space unless ``count`` says otherwise."""
    def make():
        measure = count or (lambda text: len(text.split()))

        def step(batch):
            return {"n_tokens": [measure(t) if t else 0 for t in utf8(batch)]}
        return step

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(given, ["doc_id"], "n_tokens bigint", make).select("doc_id", "n_tokens")


def pieces(sizes: DataFrame, largest: int) -> DataFrame:
    """``doc_id, piece, start, n_tokens``: a longer document is cut into full pieces of ``largest`` and a rest; an empty one has none."""
    cut = sizes.filter("n_tokens > 0").select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / largest))).alias("piece", "k"))
    start = F.col("k") * largest
    return cut.select("doc_id", F.col("piece").cast("bigint").alias("piece"), start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(largest)).cast("bigint").alias("n_tokens"))


class _Lengths:
    """How many pieces of each length are still to come, with a bit set for every length that is there."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        self.bits = 0
        for n in sizes:
            self.count[n] = self.count.get(n, 0) + 1
            self.bits |= 1 << n

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.bits &= ~(1 << n)

    def expected(self, first: int, capacity: int, steps: int = 16) -> int:
        """Tokens a bin of this capacity would hold after ``first`` if the largest pieces that fit followed. An estimate only."""
        room = capacity - first
        for _ in range(steps):
            n = (self.bits & ((1 << (room + 1)) - 1)).bit_length() - 1
            if n <= 0:
                break
            room -= n * min(self.count[n], room // n)
        return capacity - room


def best_fit(sizes: list[int], p: Packing, openable: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """For sizes in descending order the bin of each, and each bin's final capacity."""
    ahead, where, content, room_of = _Lengths(sizes), [], [], []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for n in sizes:
        ahead.take(n)
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            choice = [c for c in openable if c >= n] or [max(p.capacities)]
            room = min(choice, key=lambda c: (p.cost(c) / ahead.expected(n, c), c))
            b = len(content)
            content.append(0)
            room_of.append(0)
        content[b] += n
        room_of[b] = room - n
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            rooms |= 1 << (room - n)
        where.append(b)
    return where, [min(c for c in p.capacities if c >= used) for used in content]


def pack_shard(rows: pd.DataFrame, p: Packing) -> pd.DataFrame:
    """One shard: all ways of opening bins are tried, the cheapest whole result is kept."""
    rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
    sizes = rows["n_tokens"].tolist()
    tries = [best_fit(sizes, p, openable) for openable in (p.capacities, p.capacities[-1:])]
    where, capacity = min(tries, key=lambda t: sum(map(p.cost, t[1])))
    rows["bin_id"] = [int(rows["shard"].iloc[0]) << 32 | b for b in where]
    rows["capacity"] = [capacity[b] for b in where]
    rows["offset"] = rows.groupby("bin_id")["n_tokens"].cumsum() - rows["n_tokens"]
    return rows[["bin_id", "capacity", "offset", "doc_id", "piece", "start", "n_tokens"]]


def pack(sizes: DataFrame, p: Packing = Packing()) -> DataFrame:
    """``bin_id, capacity, offset, doc_id, piece, start, n_tokens``: where each piece of each document lies.

    ``sizes`` has ``doc_id, n_tokens``. Every token is packed once. Documents without tokens (or a null count) are in no bin. Rows that
    repeat are packed as often as they occur; a null ``doc_id`` is packed like any other. No rows give no rows.
    """
    sizes = durable(sizes)
    tokens = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-int(tokens) // p.shard_tokens))
    dealt = pieces(sizes, p.capacities[-1]).withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(
        lambda rows: pack_shard(rows, p),
        "bin_id bigint, capacity bigint, offset bigint, doc_id bigint, piece bigint, start bigint, n_tokens bigint")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 512 to 4,096 words."""
    return pack(lengths(table(spark, sf_dir, "documents", "doc_id", "text")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins of the documents that are left."""
    return pack(lengths(docs))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLES: dict[str, str] = {}
