"""Connected components of links, and joins that broadcast only what they have measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.session import durable, release

#: Most rows of bare ids (16 bytes each in a hash table, about 16 MB) that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", n_ids: int | None = None) -> DataFrame:
    """Semi or anti join with a table of distinct ids; wide ``rows`` are not shuffled while the ids are proven to be few."""
    few = (ids.count() if n_ids is None else n_ids) <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b``); the component is its smallest node.

    Alternates the large-star and small-star steps: each replaces links by links to the smallest neighbour, until every node hangs
    on its component's smallest node. Minima are combined before the shuffle, hubs are joined by joins that Spark can split, nothing
    is gathered. No links give no rows.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        after = durable(small.filter("u <> v").distinct())
        release(edges)
        edges = after
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def with_leaders(postings: DataFrame, leaders: int = 8) -> DataFrame:
    """``postings`` (``key``, ``node``, more) of keys that two rows share, with the key's ``leader`` node.

    A leader is the least node after flipping bits that depend on the key, so the keys of one large group choose between a few
    leaders. Counts and minima are combined before the shuffle; hot keys are then joined by a join that Spark can split.
    """
    flip = F.xxhash64(F.pmod(F.xxhash64("key"), F.lit(leaders)))
    shared = postings.groupBy("key").agg(F.count("*").alias("df"), F.min(F.col("node").bitwiseXOR(flip)).alias("x")).filter("df > 1")
    return postings.join(shared.select("key", F.col("x").bitwiseXOR(flip).alias("leader")), "key")


def still_apart(postings: DataFrame, labels: DataFrame, fits: Column, fields: list[str], of_node: DataFrame, more: list[str]) -> DataFrame:
    """Distinct pairs ``a < b`` of nodes that share a key, satisfy ``fits`` and are in different components so far.

    ``postings`` as ``with_leaders`` gives them. Most nodes of a key are in its leader's component, and pairs within it are never
    formed: only nodes outside it are compared with all nodes of the key. ``fits`` reads ``<field>_a`` and ``<field>_b`` of the postings'
    ``fields`` and of the columns ``more`` that ``of_node`` has of each node.
    """
    held = postings.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mains = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                    F.min(F.when(F.col("node") == F.col("leader"), F.col("component"))).alias("main"))
    rest = durable(held.join(mains.filter("lo < hi").select("key", "main"), "key").select(
        "key", "node", "component", *fields, (F.col("component") == F.col("main")).alias("in_main")))
    full, side = rest.join(of_node, "node"), lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("node", "component", *fields, *more)]
    x, y = full.filter("NOT in_main").select("key", *side("a")), full.select("key", *side("b"), "in_main")
    apart = (F.col("component_a") != F.col("component_b")) & (F.col("in_main") | (F.col("node_a") < F.col("node_b")))
    pairs = x.join(y, "key").filter(apart & fits)
    out = durable(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())
    release(rest)
    return out


def with_small(rows: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join with a table of few short columns that is broadcast only if it has been counted and is small enough."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_IDS // 4 else small, key, how)
