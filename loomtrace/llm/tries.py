"""Prefix tries of conversations, built as burst tries.

Equal sequences of turns are collapsed first. A container holds the suffixes of all sequences under one head of the trie. Containers that
are too large burst: one round takes a member's suffix as the path of new heads and deals the other members to new containers by the depth
at which they leave the path and the id of their next turn there, so a long shared beginning costs one round and not one for every turn.
What remains fits a task: its suffixes are sorted and swept into nodes. Nodes on paths get their numbers from what ends or hangs there, by
sums along the path that are taken in pieces. No step gathers more than a container.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.llm.arrow import map_batches
from loomtrace.llm.registry import table
from loomtrace.session import by_key, durable, release

#: Turns that a container may hold before it bursts; rows that are broadcast at most, after they were counted; positions in one piece of a path.
CONTAINER, FEW, PIECE = 1 << 14, 200_000, 4096
#: Decimal ids that are joined into one piece before they move.
IDS = 4096

_NOTHING = hashlib.sha256(b"").hexdigest()
_CHAIN = "array<struct<cont:binary,hi:bigint>>"
_NODE = ("cont binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
         "ends_sha256 string, top boolean")


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= FEW else rows


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, tid, words``: turns from 1 in order of ``turn``, null first, and of their digest where it ties.

    ``tid`` is the digest of role and text, null counting as empty. Rows are sorted in ranges, and a conversation that spans several of
    them is numbered across, so no task holds one. Rows without a ``conv_id`` belong to none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))).alias("tid"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "conv_id", "turn", "tid").sortWithinPartitions("conv_id", "turn", "tid")

    def make():
        def run(batches):
            last, at = None, 0
            for batch in batches:
                places = []
                for conv in batch.column(0).to_pylist():
                    at = at + 1 if conv == last else 1
                    last = conv
                    places.append(at)
                yield {"conv_id": batch.column(0), "tid": batch.column(1), "words": batch.column(2), "at": places, "part": batch.column(3)}
        return run

    placed = durable(map_batches(rows.select("conv_id", "tid", "words", F.spark_partition_id().cast("bigint").alias("part")),
                                 "conv_id bigint, tid binary, words bigint, at bigint, part bigint", make))
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A border between ranges cuts one conversation at most, so these are fewer rows than ranges.
    more = counts.withColumn("before", F.sum("n").over(before)).filter("before IS NOT NULL").select("conv_id", "part", "before")
    pos = (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos")
    out = durable(placed.join(F.broadcast(more), ["conv_id", "part"], "left").select("conv_id", pos, "tid", "words"))
    release(placed)
    return out


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, tid, words`` and ``conv_id`` of all conversations, turnless ones too: the first h turns of a conversation are those of
    the one that begins its group of ids (all if it has fewer, none if it is absent); h is the CRC-32 of the decimal id modulo ``most``."""
    base, h = F.col("conv_id") - F.col("conv_id") % group, F.crc32(F.col("conv_id").cast("string")) % most
    convs = durable(turns.select("conv_id").distinct())
    heads = turns.filter((F.col("conv_id") == base) & (F.col("pos") < most)).select(F.col("conv_id").alias("base"), F.col("pos").alias("at"), "tid", "words")
    there = heads.groupBy("base").agg(F.max("at").alias("there"))
    first = convs.withColumn("base", base).join(heads, "base").filter(F.col("at") <= h).select("conv_id", F.col("at").alias("pos"), "tid", "words")
    own = turns.withColumn("base", base).filter(F.col("pos") > h).join(there, "base", "left")
    shift = F.least(h, F.coalesce("there", F.lit(0))) - h
    return durable(first.union(own.select("conv_id", F.col("pos") + shift, "tid", "words"))), convs


def collapsed(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``seq, n, weight, sha``: one row per distinct sequence; its smallest conversation, turns, number of conversations and their digest.

    Ids are sorted in ranges and joined into pieces before those of one sequence meet. The digest reads them one after the other, as it is
    defined; a task holds one piece at a time.
    """
    marks = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("pos", "tid")).alias("x"), F.bit_xor(F.xxhash64("tid", "pos")).alias("y"))
    key = ["n", "x", "y"]
    rows = convs.join(marks, "conv_id", "left").select(*(F.coalesce(c, F.lit(0)).alias(c) for c in key), "conv_id")
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def pieces():
        def run(batches):
            now, ids = None, []
            for batch in batches:
                out = []
                for *k, conv in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if k != now or len(ids) == IDS:
                        if ids:
                            out.append((*now, ids[0], len(ids), ",".join(map(str, ids))))
                        now, ids = k, []
                    ids.append(conv)
                yield {c: [o[i] for o in out] for i, c in enumerate((*key, "seq", "weight", "ids"))}
            if ids:
                yield dict(zip((*key, "seq", "weight", "ids"), ([v] for v in (*now, ids[0], len(ids), ",".join(map(str, ids)))), strict=True))
        return run

    def digests():
        def run(batches):
            now, open_ = None, None
            for batch in batches:
                out = []
                for n, x, y, seq, weight, ids in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if (n, x, y) != now:
                        if now:
                            out.append((open_[0], now[0], open_[1], open_[2].hexdigest()))
                        now, open_ = (n, x, y), [seq, 0, hashlib.sha256()]
                    open_[2].update((("," if open_[1] else "") + ids).encode())
                    open_[1] += weight
                yield {c: [o[i] for o in out] for i, c in enumerate(("seq", "n", "weight", "sha"))}
            if now:
                yield {"seq": [open_[0]], "n": [now[0]], "weight": [open_[1]], "sha": [open_[2].hexdigest()]}
        return run

    made = map_batches(rows.select(*key, "conv_id"), "n bigint, x bigint, y bigint, seq bigint, weight bigint, ids string", pieces)
    made = by_key(made, *key).sortWithinPartitions(*key, "seq")
    return durable(map_batches(made, "seq bigint, n bigint, weight bigint, sha string", digests))


@dataclass
class Burst:
    """What the rounds have left, as lists of tables: members of containers that fit, sequences that end on a path, paths, containers."""

    small: list[DataFrame] = field(default_factory=list)
    ends: list[DataFrame] = field(default_factory=list)
    paths: list[DataFrame] = field(default_factory=list)
    boxes: list[DataFrame] = field(default_factory=list)


def burst(turns: DataFrame, seqs: DataFrame, container: int) -> Burst:
    """Rounds of bursting until every container holds at most ``container`` turns. The root always bursts.

    The path of a round is a member chosen by hash, so a chain of prefixes is halved and not peeled.
    """
    out, root = Burst(), F.unhex(F.lit("00"))
    members = durable(seqs.select("seq", "n", "weight", "sha", root.alias("cont"), F.lit(-1).cast("bigint").alias("at"), F.array().cast(_CHAIN).alias("chain")))
    k = 0
    while True:
        boxes = durable(members.groupBy("cont").agg(
            F.sum(F.col("n") - F.greatest("at", F.lit(0))).alias("turns"), F.first("at").alias("at"), F.first("chain").alias("chain"),
            F.max(F.struct(F.xxhash64("seq", F.lit(k)), "seq", "n")).alias("of")).select(
                "cont", "turns", "at", "chain", F.col("of.seq").alias("rep"), F.col("of.n").alias("rep_n"),
                ((F.col("turns") > container) | (F.col("at") < 0)).alias("large")))
        large = boxes.filter("large")
        n_large, n_path = large.agg(F.count("*"), F.coalesce(F.sum(F.col("rep_n") - F.col("at")), F.lit(0))).first()
        out.boxes.append(boxes)
        if not n_large:
            out.small.append(members)
            return out
        own = members.join(_few(large.select("cont"), n_large), "cont", "left_anti")
        out.small.append(durable(own))
        path = durable(turns.join(_few(large.select("cont", "at", F.col("rep").alias("seq")), n_large), "seq").filter("pos > at").select("cont", "pos", "tid", "words"))
        out.paths.append(path)
        rest = durable(members.join(_few(large.select("cont"), n_large), "cont", "left_semi"))
        suffixes = turns.join(rest.select("seq", "cont", "at"), "seq").filter("pos > at")
        both = suffixes.join(_few(path.select("cont", "pos", F.col("tid").alias("on_path")), n_path), ["cont", "pos"], "left")
        leaves = both.filter("on_path IS NULL OR on_path <> tid").groupBy("seq").agg(F.min(F.struct("pos", "tid")).alias("next"))
        rest_ = rest.join(leaves, "seq", "left").withColumn("hi", F.coalesce(F.col("next.pos") - 1, "n"))
        rest_ = durable(rest_.withColumn("chain", F.concat("chain", F.array(F.struct("cont", "hi")).cast(_CHAIN))))
        out.ends.append(rest_.filter("next IS NULL").select("seq", "weight", "sha", "cont", "hi", "chain"))
        head = F.unhex(F.md5(F.concat("cont", F.encode(F.concat_ws(":", F.lit(""), F.col("hi").cast("string"), F.lit("")), "UTF-8"), F.col("next.tid"))))
        new = durable(rest_.filter("next IS NOT NULL").select("seq", "n", "weight", "sha", head.alias("cont"), F.col("hi").alias("at"), "chain"))
        release(members, rest)
        members, k = new, k + 1


class _Node:
    __slots__ = ("depth", "words", "n", "conv", "children", "leaves", "saved", "sha", "below")

    def __init__(self, depth: int, words: int):
        self.depth, self.words, self.n, self.conv, self.children, self.leaves, self.saved, self.sha, self.below = depth, words, 0, None, 0, 0, 0, None, []


def sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of _NODE from ``(cont, seq, weight, sha, suffix)`` in order of container and suffix; a suffix is a list of turns."""
    now, stack, path = None, [], []

    def close(to: int) -> Iterator[tuple]:
        while len(stack) > to:
            node = stack.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
            for row in node.below:
                yield (*row[:3], node.conv, *row[4:], False)
            own = (now, node.depth, node.conv, None, node.n, node.children, node.leaves, node.saved, node.sha or _NOTHING)
            if stack:
                top = stack[-1]
                top.below.append(own)
                top.n += node.n
                top.conv = node.conv if top.conv is None else min(top.conv, node.conv)
                top.children += 1
                top.leaves += node.leaves
                top.saved += node.saved
            else:
                yield (*own, True)

    for cont, seq, weight, sha, suffix in rows:
        shared = 0
        if cont == now:
            for a, b in zip(path, suffix):
                if a["tid"] != b["tid"]:
                    break
                shared += 1
        yield from close(shared)
        now, path = cont, suffix
        for turn in suffix[shared:]:
            stack.append(_Node(turn["pos"], turn["words"]))
        end = stack[-1]
        end.n, end.conv, end.sha = end.n + weight, seq if end.conv is None else min(seq, end.conv), sha
    yield from close(0)


def swept(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of containers that fit a task."""
    suffix = turns.join(members.select("seq", "at"), "seq").filter("pos > at").groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("suffix"))
    rows = by_key(members.select("cont", "seq", "weight", "sha").join(suffix, "seq").select("cont", "seq", "weight", "sha", "suffix"), "cont")
    names = [c.split()[0] for c in _NODE.split(", ")]

    def make():
        def run(batches):
            given = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            held = []
            for node in sweep(given):
                held.append(node)
                if len(held) == 10_000:
                    yield dict(zip(names, zip(*held, strict=True), strict=True))
                    held = []
            if held:
                yield dict(zip(names, zip(*held, strict=True), strict=True))
        return run

    return durable(map_batches(rows.sortWithinPartitions("cont", "suffix"), _NODE, make))


def from_end(rows: DataFrame, key: str, pos: str, totals: dict[str, tuple]) -> DataFrame:
    """``rows`` with columns that sum up each row and all behind it in order of ``pos`` within ``key``.

    ``totals``: name to (aggregate function, the same of two values, column). Rows are taken in pieces of PIECE positions, so no task
    holds a whole path.
    """
    cut = rows.withColumn("__piece", F.floor(F.col(pos) / PIECE))
    inside = Window.partitionBy(key, "__piece").orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy(key).orderBy(F.desc("__piece")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, "__piece").agg(*(f(c).alias(name) for name, (f, _, c) in totals.items()))
    later = sums.select(key, "__piece", *(f(name).over(behind).alias(f"__{name}") for name, (f, _, _) in totals.items()), F.count("*").over(behind).alias("__n"))
    out = cut.select("*", *(f(c).over(inside).alias(name) for name, (f, _, c) in totals.items())).join(later.filter("__n > 0"), [key, "__piece"], "left")
    both = {name: F.when(F.col(f"__{name}").isNull(), F.col(name)).when(F.col(name).isNull(), F.col(f"__{name}")).otherwise(two(F.col(name), F.col(f"__{name}")))
            for name, (_, two, _) in totals.items()}
    return out.withColumns(both).drop("__piece", "__n", *(f"__{name}" for name in totals))


def _up(rows: DataFrame, *values: str) -> DataFrame:
    """A row per place on a path where something ends or hangs, on every path above it."""
    return rows.select(F.inline("chain"), *values)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def trie(turns: DataFrame, convs: DataFrame, container: int = CONTAINER) -> DataFrame:
    """All nodes of the trie of the conversations ``convs`` (``conv_id``), whose turns are ``conv_id, pos, tid, words``, ``pos`` from 1.

    Per node ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. Conversations without turns are members of the root alone. No conversations give no node.
    """
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    seqs = collapsed(turns, convs)
    if seqs.isEmpty():
        return turns.sparkSession.createDataFrame([], _NODE).select(columns)
    turns = durable(turns.withColumnRenamed("conv_id", "seq").join(seqs.select("seq"), "seq", "left_semi"))
    b = burst(turns, seqs, container)
    below = swept(turns, _union(b.small))
    boxes = durable(_union(b.boxes))
    ends = durable(_union(b.ends))
    large = boxes.filter("large")

    # What hangs on a path, and how many containers begin at each of its places.
    last = F.try_element_at("chain", F.lit(-1))
    hung = boxes.filter("at >= 0").groupBy(last["cont"].alias("cont"), last["hi"].alias("hi")).agg(F.count("*").alias("kids"))
    hung = durable(hung)
    tops = below.filter("top").join(boxes.select("cont", "chain"), "cont")
    zero = F.lit(0).cast("bigint")
    tips = large.select("cont", F.col("rep_n").alias("hi"), "chain").join(hung.select("cont", "hi"), ["cont", "hi"], "left_anti")
    own = F.concat("chain", F.array(F.struct("cont", "hi")).cast(_CHAIN))
    events = _union([
        _up(tops, "n_convs", "conv_id", "n_leaves", "saved_tokens"),
        _up(ends.select("chain", F.col("weight").alias("n_convs"), F.col("seq").alias("conv_id"), zero.alias("n_leaves"), zero.alias("saved_tokens")), "n_convs", "conv_id", "n_leaves", "saved_tokens"),
        _up(tips.select(own.alias("chain"), zero.alias("n_convs"), F.lit(None).cast("bigint").alias("conv_id"), F.lit(1).cast("bigint").alias("n_leaves"), zero.alias("saved_tokens")),
            "n_convs", "conv_id", "n_leaves", "saved_tokens")])
    events = events.groupBy("cont", "hi").agg(F.sum("n_convs").alias("e_n"), F.min("conv_id").alias("e_conv"), F.sum("n_leaves").alias("e_leaves"), F.sum("saved_tokens").alias("e_saved"))

    # Nodes on paths, with the root before the first turn of its path.
    first = large.filter("at < 0").select("cont", zero.alias("depth"), zero.alias("words"))
    nodes = _union([p.select("cont", F.col("pos").alias("depth"), "words") for p in b.paths]).union(first)
    at = lambda t: t.withColumnRenamed("hi", "depth")
    nodes = nodes.join(at(events), ["cont", "depth"], "left").join(at(hung), ["cont", "depth"], "left").join(
        at(ends.select("cont", "hi", "sha")), ["cont", "depth"], "left")
    both: Column = lambda x, y: x + y
    nodes = from_end(nodes, "cont", "depth", {"n_convs": (F.sum, both, F.col("e_n")), "member": (F.min, F.least, F.col("e_conv"))})
    nodes = durable(nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("words")))
    nested = nodes.groupBy("cont").agg(F.sum("value").alias("value")).join(boxes.filter("at >= 0").select("cont", "chain"), "cont").drop("cont")
    nested = _up(nested, "value").groupBy("cont", "hi").agg(F.sum("value").alias("nested"))
    full = nodes.join(at(nested), ["cont", "depth"], "left")
    worth = F.col("value") + F.coalesce("e_saved", F.lit(0)) + F.coalesce("nested", F.lit(0))
    full = from_end(full.withColumn("worth", worth), "cont", "depth", {"n_leaves": (F.sum, both, F.col("e_leaves")), "saved_tokens": (F.sum, both, F.col("worth"))})
    full = full.join(large.select("cont", "rep_n", "at", "chain"), "cont")
    inside = F.col("depth") > F.col("at") + 1
    full = full.select("depth", F.col("member").alias("conv_id"), F.when(inside, F.col("cont")).otherwise(last["cont"]).alias("up"),
                       F.when(inside, F.col("depth") - 1).otherwise(last["hi"]).alias("up_at"), "n_convs",
                       ((F.col("depth") < F.col("rep_n")).cast("bigint") + F.coalesce("kids", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens",
                       F.coalesce("sha", F.lit(_NOTHING)).alias("ends_sha256"))
    places = nodes.select(F.col("cont").alias("up"), F.col("depth").alias("up_at"), F.col("member").alias("parent_conv_id"))
    upper = full.join(places, ["up", "up_at"], "left").select(columns)
    joined = below.filter("top").drop("parent_conv_id").join(boxes.select("cont", last["cont"].alias("up"), last["hi"].alias("up_at")), "cont").join(places, ["up", "up_at"])
    out = durable(upper.union(joined.select(columns)).union(below.filter("NOT top").select(columns)))
    release(turns, seqs, below, boxes, ends, hung, nodes, *b.small, *b.paths, *b.boxes)
    return out


def conversation_trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The trie of ``conversations`` (``conv_id, turn, role, text``) after each was rebuilt from the first turns of its group.

    Null roles and texts count as empty, null turns come first, equal turn numbers are ordered by a digest of role and text, repeated rows
    are turns of their own, rows without ``conv_id`` are left out. No rows give no node. Other columns are not read.
    """
    own = numbered(conversations)
    turns, convs = rebuilt(own)
    out = trie(turns, convs, container)
    release(own, turns, convs)
    return out


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


_ORACLE = r"""WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
own AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, s, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, z: xor(a // 256, t[xor(a % 256, z) + 1])), 4294967295) % 4 AS h FROM own, crc),
r AS (SELECT h.conv_id, coalesce(own.s[1:h.h], []) || h.s[h.h + 1:] AS s FROM h LEFT JOIN own ON own.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM r),
n AS MATERIALIZED (SELECT d, s[1:d] AS s, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
m AS MATERIALIZED (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n c WHERE c.d = n.d + 1 AND c.s[1:n.d] = n.s) AS n_children
  FROM n LEFT JOIN n u ON u.d = n.d - 1 AND u.s = n.s[1:n.d - 1])
SELECT m.conv_id, m.d AS depth, any_value(m.parent_conv_id) AS parent_conv_id, any_value(m.n_convs) AS n_convs, any_value(m.n_children) AS n_children,
  count(*) FILTER (x.n_children = 0) AS n_leaves,
  sum(CASE WHEN x.d > 0 THEN (x.n_convs - 1) * len(regexp_extract_all(x.s[x.d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END)::BIGINT AS saved_tokens, any_value(m.ends_sha256) AS ends_sha256
FROM m JOIN m x ON x.d >= m.d AND x.s[1:m.d] = m.s GROUP BY m.conv_id, m.d, m.s"""

QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLES = {"op12_conversation_trie": _ORACLE}
