"""Exact n-gram Jaccard join by groups of documents with identical prefix and size.

Shingles are ordered by how common they are. Two sets that meet the threshold share a shingle within their prefixes, so prefixes are
the only thing that is joined. Documents with the same prefix and size form one group; pairs of groups are filtered by size, by
position and by a bitmap that bounds the symmetric difference from below; only then groups are expanded and members compared.

Components need no pair twice linked: a first round compares every group with one leader of each prefix shingle (as many pairs as
postings at most, however large a group of near copies is); a second round compares what shares a prefix shingle but is still in
different components.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.arrow import lists, map_rows, utf8
from loomtrace.llm.links import by_ids, components, still_apart, with_leaders
from loomtrace.llm.registry import table
from loomtrace.llm.shingles import WordHashes, commonness, shingle_set
from loomtrace.session import durable, release

#: Linked when 100 * intersection >= PERCENT * union.
PERCENT, SIZE = 80, 5
#: Bits of the bitmap of a small set; larger sets take four times as many until there are 2 for 3 shingles.
BITMAP = 1024


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def parity_bitmap(s: np.ndarray) -> np.ndarray:
    """For each bucket of hashes whether the set has an odd number of them, as 64-bit words."""
    bits = BITMAP
    while 2 * len(s) > 3 * bits:
        bits *= 4
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id``, set size ``n``, digest of the set, group key (digest of prefix and size), bitmap and prefix."""
    import pyarrow as pa

    levels = docs.sparkSession.sparkContext.broadcast(commonness(docs, size))

    def make():
        hashes, order = WordHashes(), levels.value
        shift = np.uint64(64 - (len(order).bit_length() - 1))

        def step(batch):
            n, keys, groups, bitmaps, prefixes = [], [], [], [], []
            for text in utf8(batch):
                s = shingle_set(text, hashes, size)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                p = s[np.argsort(order[s >> shift], kind="stable")[:prefix_length(len(s), percent)]] if len(s) else s
                prefixes.append(p.view(np.int64))
                groups.append(xxhash.xxh3_64_intdigest(p.tobytes(), seed=len(s)) - (1 << 63))
                bitmaps.append(parity_bitmap(s))
            return {"n": n, "set_key": keys, "grp": groups, "bits": lists(np.concatenate(bitmaps), [len(b) for b in bitmaps], pa.int64()),
                    "prefix": lists(np.concatenate(prefixes), [len(p) for p in prefixes], pa.int64())}
        return step

    return map_rows(docs.select("doc_id", "text"), ["doc_id"],
                    "n bigint, set_key binary, grp bigint, bits array<bigint>, prefix array<bigint>", make)


def size_fits(percent: int) -> Column:
    """The smaller set is large enough for the larger one."""
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def bitmap_fits(percent: int) -> Column:
    """Bits in which two parity bitmaps differ are at most the symmetric difference, which a link bounds by the sizes.

    Bitmaps of different lengths tell nothing and pass.
    """
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    few = differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    return (F.size("bits_a") != F.size("bits_b")) | few


def folded(bits: Column) -> list[Column]:
    """The parity bitmap of 256 buckets, as four numbers."""
    def one(k: int) -> Column:
        return F.aggregate(F.filter(bits, lambda x, i: i % 4 == k), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseXOR(x)).alias(f"q{k}")

    return [one(k) for k in range(4)]


def fold_fits(percent: int) -> Column:
    """As ``bitmap_fits``, by the small bitmaps that every set has."""
    differ = sum((F.bit_count(F.col(f"q{k}_a").bitwiseXOR(F.col(f"q{k}_b"))) for k in range(1, 4)), F.bit_count(F.col("q0_a").bitwiseXOR(F.col("q0_b"))))
    return differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)


def position_fits(percent: int) -> Column:
    """What is left from the shared shingle on, in both orders, can still reach the overlap that a link needs."""
    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return left * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def compared(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (``a, b``, distinct document ids), by their full sets."""
    import pyarrow as pa

    need = durable(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())

    def make():
        hashes = WordHashes()

        def step(batch):
            sets = [shingle_set(t, hashes, size).view(np.int64) for t in utf8(batch)]
            return {"s": lists(np.concatenate(sets), [len(s) for s in sets], pa.int64())}
        return step

    wanted = by_ids(docs.select("doc_id", "text"), need, "doc_id").dropDuplicates(["doc_id"])
    sets = durable(map_rows(wanted, ["doc_id"], "s array<bigint>", make))
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("s").alias(f"s_{k}"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    whole = F.size("s_a") + F.size("s_b") - common
    out = durable(pairs.join(side("b"), "b").join(side("a"), "a").filter(common * 100 >= whole * percent).select("a", "b"))
    release(need, sets)
    return out


def classes_and_links(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` (doc_id, n, rep: the smallest document with the same set), verified ``links`` between representatives, and
    ``labels`` (node, component) of all representatives that have a link.
    """
    rows = durable(signatures(docs, size, percent))
    some = rows.filter("n > 0")
    classes = durable(some.groupBy("set_key", "grp", "n", "bits").agg(F.min("doc_id").alias("rep")))
    members = rows.select("doc_id", "n", "set_key").join(classes.select("set_key", "rep"), "set_key", "left").select("doc_id", "n", "rep")

    postings = durable(with_leaders(some.select(F.col("grp").alias("node"), "n", F.posexplode("prefix").alias("pos", "key"))))
    member = classes.select("grp", "rep", "n", "bits")
    side = lambda k: member.select(*(F.col(c).alias(f"{c}_{k}") for c in member.columns))
    fits = size_fits(percent) & bitmap_fits(percent)

    stars = postings.filter("node <> leader").select(F.col("leader").alias("grp_a"), F.col("node").alias("grp_b")).distinct()
    between = stars.join(side("b"), "grp_b").join(side("a"), "grp_a").filter(fits).select(
        F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))
    first = member.groupBy("grp").agg(F.min("rep").alias("a"), F.count("*").alias("k")).filter("k > 1")
    inside = first.join(member, "grp").filter("a <> rep").select("a", F.col("rep").alias("b"))
    tried = durable(between.union(inside).distinct())
    links = compared(docs, tried, size, percent)
    labels = durable(components(links))

    # What shares a prefix shingle, or is in one group, but is still apart: now between members.
    posted = postings.withColumnRenamed("node", "grp").join(member.select("grp", "rep"), "grp")
    leader_rep = member.groupBy("grp").agg(F.min("rep").alias("leader_rep")).withColumnRenamed("grp", "leader")
    posted = posted.join(leader_rep, "leader").select("key", "n", "pos", F.col("leader_rep").alias("leader"), F.col("rep").alias("node"))
    alike = first.select("grp", "a").join(member, "grp").select(F.col("grp").alias("key"), "n", F.lit(0).alias("pos"), F.col("a").alias("leader"), F.col("rep").alias("node"))
    quarter = member.select(F.col("rep").alias("node"), *folded(F.col("bits")))
    could = size_fits(percent) & position_fits(percent) & fold_fits(percent)
    apart = still_apart(posted.union(alike), labels, could, ["n", "pos"], quarter, [f"q{k}" for k in range(4)])
    of = lambda k: member.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    apart = apart.join(tried, ["a", "b"], "left_anti")
    pairs = durable(apart.join(of("a"), "a").join(of("b"), "b").filter(fits).select("a", "b"))
    if not pairs.isEmpty():
        more = compared(docs, pairs, size, percent)
        links = links.union(more)
        labels = durable(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    release(postings, tried, pairs)
    return members, links, labels


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (columns ``doc_id, text``; others are ignored).

    A set holds the distinct word windows of a whole text; a shorter text is one window. Documents link when 100 * intersection >=
    percent * union; ``component_id`` is the smallest id reachable. Without words (null, empty, white space) the set is empty, size 0,
    and the document is its own component. Rows of one id and text repeat with the same result; a null id never becomes a
    component's id unless all its members are null. An empty table gives no rows.
    """
    members, _, labels = classes_and_links(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), size, percent)
    return members.join(labels, F.col("rep") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are the smallest of their component, in the columns they came with."""
    gone = durable(jaccard_components(docs).filter("doc_id <> component_id").select("doc_id").distinct())
    return by_ids(docs, gone, "doc_id", "left_anti")


_ORACLE = r"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, len(w) AS k, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
f AS (SELECT doc_id, k, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS dd, lead(a, 4) OVER o AS ee FROM e
      WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c, dd, ee) AS g FROM f WHERE ee IS NOT NULL OR k < 5 AND i = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * c >= 80 * (m.n + o.n - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, c FROM r JOIN both_ways ON x = r.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""

QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLES = {"op2_ngram_jaccard": _ORACLE}
