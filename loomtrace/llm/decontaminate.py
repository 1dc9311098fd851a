"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over hashed words. One distributed pass sums their second-moment matrix times a random
matrix, from which the driver gets the leading singular vectors (fixed size); the space is fitted on all passages. Windows of every
document and the benchmark items are compared by the cosine in that space, whitened so that common directions do not count, and only with
items of which the surroundings have enough words at all, which loses nothing that the verification would accept. What comes close is
verified by the longest common subsequence of words and by the item's answer. Texts are read twice: once to hash their words, once for
documents with candidates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.arrow import lists, map_batches
from loomtrace.llm.links import by_ids
from loomtrace.llm.registry import table
from loomtrace.llm.totals import total
from loomtrace.session import durable, release

#: Everything that is no ASCII letter or digit and no character beyond ASCII separates words.
_SPACES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@dataclass(frozen=True)
class Settings:
    """``dims`` hashed words, ``rank`` kept and ``extra`` sketched directions, ``passage`` words of a fitted passage."""

    dims: int = 1 << 15
    rank: int = 64
    extra: int = 16
    passage: int = 48
    seed: int = 11
    #: Least cosine of a candidate; least share of an item's words in order, alone or together with its answer.
    cosine: float = 0.3
    verbatim: float = 0.75
    paraphrase: float = 0.5
    answer: float = 0.8
    #: An answer of fewer words, or one that is the whole item, gives way to the item's last words; items of fewer words than this are
    #: compared as they are.
    answer_words: int = 5
    #: Windows begin at multiples of ``unit`` words. Words of a document that are held at once, and items that are compared in one pass.
    unit: int = 4
    segment: int = 20_000
    items: int = 1_000
    #: Bytes of text and words that are expanded at once.
    text_bytes: int = 4_000_000
    words: int = 500_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    return text.lower().encode().translate(_SPACES).split() if text else []


class Buckets(dict):
    """Word to hashed bucket; emptied when it has grown large."""

    def __init__(self, dims: int, most: int = 50_000):
        super().__init__()
        self.dims, self.most = dims, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) % self.dims
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


def hashed_words(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, ids``: the bucket of every word of every text, in order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def hashed(texts: list[str | None]) -> pa.Array:
        clean = pc.ascii_trim_whitespace(pa.array([t.lower().encode().translate(_SPACES) if t else b"" for t in texts], pa.binary()).cast(pa.string()))
        words = pc.ascii_split_whitespace(clean)
        lengths = np.where(pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0, words.value_lengths().to_numpy(zero_copy_only=False), 0)
        flat = words.flatten()
        coded = flat.filter(pc.greater(pc.binary_length(flat), 0)).dictionary_encode()
        table_ = np.array([xxhash.xxh3_64_intdigest(w.encode()) % s.dims for w in coded.dictionary.to_pylist()], dtype=np.int32)
        ids = table_[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, dtype=np.int32)
        return lists(ids, lengths.tolist(), pa.int32())

    def make():
        def run(batches):
            for batch in batches:
                sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
                cuts = np.flatnonzero(np.diff(sizes // s.text_bytes, prepend=0)).tolist()
                for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                    if lo < hi:
                        yield {"doc_id": batch.column(0).slice(lo, hi - lo), "ids": hashed(batch.column(1).slice(lo, hi - lo).to_pylist())}
        return run

    return map_batches(docs.select("doc_id", "text"), "doc_id bigint, ids array<int>", make)


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch and the lengths of its documents."""
    column = batch.column(batch.schema.get_field_index("ids"))
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)


def _passages(batch, s: Settings):
    """The passages of a batch in parts of about ``words`` words; a long document is cut between passages."""
    flat, lengths = _ids(batch)
    most, at, held, size = max(1, s.words // s.passage) * s.passage, 0, [], 0
    begin = 0
    for n in lengths.tolist():
        while n:
            take = min(n, most - size) if n <= most - size else (most - size) // s.passage * s.passage
            if take:
                held.append(take)
                size, at, n = size + take, at + take, n - take
            if n or size == most:
                yield passages(flat[begin:at], np.array(held), s.passage, s.dims)
                begin, held, size = at, [], 0
    if held:
        yield passages(flat[begin:at], np.array(held), s.passage, s.dims)


def passages(ids: np.ndarray, lengths: np.ndarray, size: int, pad: int) -> np.ndarray:
    """One row of ``size`` ids per passage: documents are cut from their beginning, the last passage is filled with ``pad``."""
    per_doc = -(-lengths // size)
    out = np.full((int(per_doc.sum()), size), pad, dtype=np.int32)
    shift = np.repeat(np.cumsum(per_doc * size - lengths) - (per_doc * size - lengths), lengths)
    out.ravel()[np.arange(len(ids)) + shift] = ids
    return out


def add_moments(rows: np.ndarray, weight: np.ndarray, random: np.ndarray, y: np.ndarray, often: int = 16) -> None:
    """Add to ``y`` (``dims x sketch``) the second moments of passages times a random matrix.

    ``random`` has the weighted random row of each word; the last word is the filling, of weight 0. Words that occur more than ``often``
    times in these passages are added up by a matrix product, the others occurrence by occurrence.
    """
    dims = len(y)
    w = weight[rows]
    each = np.take(random, rows[:, 0], axis=0, mode="clip")
    for k in range(1, rows.shape[1]):
        each += np.take(random, rows[:, k], axis=0, mode="clip")
    each /= np.maximum((w * w).sum(axis=1), 1e-9)[:, None]
    flat = rows.ravel()
    times = np.bincount(flat, minlength=dims + 1)
    times[dims] = 0
    common = np.flatnonzero(times > often)
    width = len(common) + 1
    column = np.full(dims + 1, len(common))
    column[common] = np.arange(len(common))
    counts = np.bincount((np.arange(len(rows))[:, None] * width + column[rows]).ravel(), minlength=len(rows) * width)
    y[common] += (counts.reshape(len(rows), width)[:, :-1].astype(np.float32).T @ each) * weight[common, None]
    rest = np.flatnonzero((times[flat] <= often) & (flat < dims))
    rest = rest[np.argsort(flat[rest], kind="stable")]
    word, passage = flat[rest], rest // rows.shape[1]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    nth = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
    for n in range(int(nth.max(initial=-1)) + 1):
        now = np.flatnonzero(nth == n)  # each word once
        y[word[now]] += np.take(each, passage[now], axis=0, mode="clip") * weight[word[now], None]


def fit(hashed: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """``dims x rank`` table: row of a word's bucket = its weight times the whitened singular directions.

    Document frequencies and the sketch cover every passage of every document (``ids`` of ``hashed_words``). Without any words the table
    is zero.
    """
    hashed, sketch = hashed.select("ids"), s.rank + s.extra

    def frequencies():
        def step(batch, out):
            for rows in _passages(batch, s):
                rows = np.sort(rows, axis=1)
                new = np.ones(rows.shape, dtype=bool)
                new[:, 1:] = rows[:, 1:] != rows[:, :-1]
                out[:s.dims] += np.bincount(rows[new], minlength=s.dims + 1)[:s.dims]
                out[s.dims] += len(rows)
        return step

    counts = total(hashed, s.dims + 1, np.int64, frequencies)
    idf = np.append(np.log((counts[-1] + 1) / (counts[:-1] + 1)), 0).astype(np.float32)  # the last is the filling
    omega = np.random.default_rng(s.seed).standard_normal((s.dims + 1, sketch)).astype(np.float32)
    shared = hashed.sparkSession.sparkContext.broadcast((idf, omega * idf[:, None]))

    def moments():
        weight, random = shared.value

        def step(batch, out):
            y = out.reshape(s.dims, sketch)
            for rows in _passages(batch, s):
                for lo in range(0, len(rows), 2000):  # bounds the temporary arrays
                    add_moments(rows[lo:lo + 2000], weight, random, y)
        return step

    y = total(hashed, s.dims * sketch, np.float32, moments, blocks=128).astype(np.float64).reshape(s.dims, sketch)
    shared.destroy()
    if not y.any():
        return np.zeros((s.dims, s.rank), dtype=np.float32)
    # Leading eigenvectors of the moment matrix from its product with a random matrix (Nystroem).
    omega = omega[:s.dims].astype(np.float64)
    shift = 1e-6 * np.linalg.norm(y)
    y = y + shift * omega
    core = omega.T @ y
    root = np.linalg.cholesky((core + core.T) / 2)
    u, sv, _ = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)
    values = np.sqrt(np.maximum(sv[:s.rank] ** 2 - shift, 1e-12))
    scale = np.where(values > 1e-6 * values[0], values[0] / values, 0.0)
    return (idf[:s.dims, None] * u[:, :s.rank] * scale).astype(np.float32)


class Item(NamedTuple):
    item_id: int
    words: list[bytes]
    answer: list[bytes]
    vector: np.ndarray


def prepared(rows, directions: np.ndarray, s: Settings) -> list[Item]:
    """Items that have words. The answer is the column ``answer`` where given, else the last sentence, and at least the last words. Of an
    item of one sentence it is the last words, not the whole."""
    out, buckets = [], Buckets(s.dims)
    for row in rows:
        words = words_of(row["text"])
        if words:
            given = words_of(row["answer"]) if "answer" in row else []
            last = given or words_of(next((x for x in reversed(re.split(r"[.!?]+", row["text"])) if words_of(x)), ""))
            vector = directions[buckets.of(words)].sum(axis=0)
            own = given or s.answer_words <= len(last) < len(words)
            out.append(Item(row["item_id"], words, last if own else words[-s.answer_words:],
                            vector / max(float(np.linalg.norm(vector)), 1e-9)))
    return out


def common_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by the bits of one integer."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = 0
    for w in b:
        x = row | places.get(w, 0)
        row = x & (x - ((row << 1) | 1) ^ x)
    return row.bit_count()


def length_classes(items: list[Item]) -> dict[int, list[Item]]:
    """Items by window length: within a class the longest item has less than one and a half times the words of the shortest."""
    out: dict[int, list[Item]] = {}
    for item in items:
        low = 4
        while low * 3 // 2 <= len(item.words):
            low = low * 3 // 2
        out.setdefault(max(1, low * 5 // 4), []).append(item)
    return out


class Listed(NamedTuple):
    """Where buckets occur: item numbers and how often, listed by bucket."""

    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray


class Postings(NamedTuple):
    """Buckets of the items and of their answers; per item the words that a paraphrase, a copy and an answer need; and how often an item has
    a bucket, by column of the buckets that any item or answer has. The first columns are of buckets that many items have; ``often`` is how
    often items have those, and ``bucket`` the bucket of each column."""

    words: Listed
    answers: Listed
    needed: np.ndarray
    copied: np.ndarray
    answered: np.ndarray
    column: np.ndarray
    bucket: np.ndarray
    known: np.ndarray
    often: np.ndarray
    reach: int


def listed(texts: list[list[bytes]], buckets: Buckets) -> Listed:
    rows = [np.unique(buckets.of(t), return_counts=True) for t in texts]
    at = np.concatenate([np.empty(0, dtype=np.int32), *(b for b, _ in rows)])
    times = np.concatenate([np.empty(0, dtype=np.int64), *(n for _, n in rows)])
    of = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    order = np.argsort(at, kind="stable")
    return Listed(np.searchsorted(at[order], np.arange(buckets.dims + 2)), of[order], times[order])


def postings(items: list[Item], s: Settings, share: int = 100) -> Postings:
    """A bucket that more than one of ``share`` items have counts as one of many items."""
    buckets = Buckets(s.dims)
    words, answers = listed([i.words for i in items], buckets), listed([i.answer for i in items], buckets)
    at = np.repeat(np.arange(s.dims + 1), np.diff(words.starts))
    n_items = np.diff(words.starts)
    used = np.flatnonzero((n_items > 0) | (np.diff(answers.starts) > 0))
    bucket = np.append(s.dims, used[np.argsort(-n_items[used], kind="stable")])  # column 0 is for all that no item has
    column = np.zeros(s.dims + 1, dtype=np.int32)
    column[bucket[1:]] = np.arange(1, len(bucket))
    times = np.zeros((int((n_items * share > len(items)).sum()) + 1, len(items)), dtype=np.float32)
    many = column[at] < len(times)
    times[column[at][many], words.items[many]] = words.times[many]
    known = np.zeros((len(items), len(bucket)), dtype=np.uint8)
    known[words.items, column[at]] = np.minimum(words.times, 255)
    n = np.array([len(i.words) for i in items])
    return Postings(words, answers, s.paraphrase * n, s.verbatim * n, s.answer * np.array([len(i.answer) for i in items]), column, bucket,
                    known, times, 2 * max(length_classes(items), default=1) + 4 * s.unit)


def covered(block: np.ndarray, word: np.ndarray, n_blocks: int, n_items: int, p: Listed) -> np.ndarray:
    """How many words of each item (or answer) occur in each block, from the distinct words of blocks."""
    n = p.starts[word + 1] - p.starts[word]
    at = np.repeat(p.starts[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.bincount(np.repeat(block, n) * n_items + p.items[at], weights=p.times[at], minlength=n_blocks * n_items).reshape(n_blocks, n_items)


def possible(ids: np.ndarray, lengths: np.ndarray, p: Postings, cells: int = 8_000_000) -> tuple[np.ndarray, np.ndarray]:
    """For every two neighbouring blocks of ``reach`` words, whether they have as many of an item's words as the verification needs, in any
    order: enough for a copy, or enough for a paraphrase and its answer. And the number of each segment's first block. A stretch of up to
    ``reach`` words lies in the two blocks from the one it begins in. Blocks are taken so many at once that a table of them and of all
    words of items has about ``cells`` cells.
    """
    per = -(-lengths // p.reach)
    base = np.cumsum(per) - per
    block = np.repeat(base, lengths) + (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // p.reach
    column = p.column[ids]
    block, column = block[column > 0], column[column > 0]
    n_blocks, n_items, many = int(per.sum()), len(p.needed), len(p.often)
    last = np.zeros(n_blocks, dtype=bool)
    last[(base + per - 1)[per > 0]] = True
    could = np.zeros((n_blocks, n_items), dtype=bool)
    step = max(1, cells // len(p.bucket))
    for lo in range(0, n_blocks, step):
        hi = min(lo + step, n_blocks)
        x, y = np.searchsorted(block, (lo, hi + 1))
        has = np.zeros((hi - lo + 1, len(p.bucket)), dtype=bool)
        has[block[x:y] - lo, column[x:y]] = True
        has = has[:-1] | has[1:] & ~last[lo:hi, None]
        at, few = np.divmod(np.flatnonzero(has[:, many:]), max(1, len(p.bucket) - many))
        found = has[:, :many].astype(np.float32) @ p.often + covered(at, p.bucket[many + few], hi - lo, n_items, p.words)
        copy, some = found >= p.copied, found >= p.needed
        ask = np.flatnonzero((some & ~copy).any(axis=1))  # answers matter in these blocks only
        at, word = np.divmod(np.flatnonzero(has[ask]), len(p.bucket))
        answered = np.zeros(found.shape, dtype=bool)
        answered[ask] = covered(at, p.bucket[word], len(ask), n_items, p.answers) >= p.answered
        could[lo:hi] = copy | some & answered
    return could, base


def candidates_in(ids: np.ndarray, lengths: np.ndarray, directions: np.ndarray, classes: dict, p: Postings, s: Settings):
    """(segment, item number, first word, end, cosine) of every window of segments that comes close to an item.

    ``ids`` holds segments of ``lengths`` words one after the other; ``directions`` ends with a row of zeros. Windows of a class overlap by
    about a half, so one of them holds most of any passage of an item's length. A window is compared with an item where its surroundings
    have the words.
    """
    could, blocks = possible(ids, lengths, p)
    per = -(-lengths // p.reach)
    open_ = np.bincount(np.repeat(np.arange(len(lengths)), per), weights=could.any(axis=1), minlength=len(lengths)) > 0
    alive = np.flatnonzero(open_)  # all other segments are done
    if not len(alive):
        return []
    ids, could, per, lengths = ids[np.repeat(open_, lengths)], could[np.repeat(open_, per)], per[alive], lengths[alive]
    blocks = np.cumsum(per) - per
    rows = passages(ids, lengths, s.unit, len(directions) - 1)
    units = sum((directions[rows[:, k]] for k in range(1, s.unit)), directions[rows[:, 0]])
    sums = np.zeros((units.shape[1], len(units) + 1))  # a direction in each row, which is added up along memory
    np.cumsum(np.ascontiguousarray(units.T), axis=1, out=sums[:, 1:])
    n_units = -(-lengths // s.unit)
    base, begins = np.cumsum(n_units) - n_units, np.cumsum(lengths) - lengths
    out = []
    for width, (numbers, matrix) in classes.items():
        span, step = -(-width // s.unit), max(1, width // (2 * s.unit))
        last = np.maximum(n_units - span, 0)
        count = last // step + 2
        of = np.repeat(np.arange(len(lengths)), count)
        start = np.minimum((np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * step, last[of])
        end = np.minimum(start + span, n_units[of])
        first = np.maximum(0, start * s.unit - width // 2)
        gate = could[blocks[of] + first // p.reach][:, numbers]
        some = np.flatnonzero(gate.any(axis=1))
        for lo in range(0, len(some), 40_000):  # bounds the temporary arrays
            part = some[lo:lo + 40_000]
            vectors = (sums[:, base[of[part]] + end[part]] - sums[:, base[of[part]] + start[part]]).T.astype(np.float32, order="C")
            least = s.cosine * np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            near = vectors @ matrix
            w, k = np.nonzero((near >= least[:, None]) & (least > 0)[:, None] & gate[part])
            d, at, item = of[part[w]], first[part[w]], np.asarray(numbers)[k]
            stop = np.minimum(lengths[d], end[part[w]] * s.unit + width // 2)
            for few in np.array_split(np.arange(len(w)), len(w) // 20_000 + 1):
                place = at[few, None] + np.arange(span * s.unit + 2 * (width // 2))
                inside = np.where(place < stop[few, None], ids[np.minimum(begins[d[few], None] + place, len(ids) - 1)], len(directions) - 1)
                inside.sort(axis=1)
                counts = p.known[item[few, None], p.column[inside]].astype(np.int32)
                counts[:, 1:][inside[:, 1:] == inside[:, :-1]] = 0
                good = few[counts.sum(axis=1) >= p.needed[item[few]]]  # else too few of the item's words are there in any order
                out += [(int(alive[d[i]]), int(item[i]), int(at[i]), int(stop[i]), float(near[w[i], k[i]] * s.cosine / least[w[i]])) for i in good]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, item_id, lcs_share, cosine, answer_found`` for every document and benchmark item that its text repeats.

    ``docs`` has ``doc_id, text``; ``benchmark`` has ``item_id, text`` and may have ``answer``. Texts are searched whole, in overlapping
    segments. Missing and empty texts and items match nothing, nor do rows without ``doc_id``. Items are compared in blocks of ``items``, so
    their number is not bounded. Repeated rows of a document give one row per item. Empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    hashed = durable(hashed_words(docs, s))
    model = docs.sparkSession.sparkContext.broadcast(fit(hashed, s))
    columns = ["item_id", "text", *(["answer"] if "answer" in benchmark.columns else [])]
    rows = (r.asDict() for r in benchmark.select(*columns).filter("text IS NOT NULL").toLocalIterator())
    found, block = [], []
    for row in rows:
        block.append(row)
        if len(block) == s.items:
            found.append(_search(docs, hashed, model, prepared(block, model.value, s), s))
            block = []
    found.append(_search(docs, hashed, model, prepared(block, model.value, s), s))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    release(hashed)
    model.destroy()
    return out.groupBy("doc_id", "item_id").agg(F.max("lcs_share").alias("lcs_share"), F.max("cosine").alias("cosine"),
                                                F.max("answer_found").alias("answer_found"))


def _search(docs: DataFrame, hashed: DataFrame, model, items: list[Item], s: Settings) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    numbered = {id(item): n for n, item in enumerate(items)}
    classes = {width: ([numbered[id(i)] for i in group], np.stack([i.vector for i in group], axis=1).astype(np.float32)) for width, group in length_classes(items).items()}
    index, texts = sc.broadcast((classes, postings(items, s))), sc.broadcast([(i.item_id, i.words, i.answer) for i in items])

    def candidates():
        directions, (own, words_of_items) = np.vstack([model.value, np.zeros((1, s.rank), dtype=np.float32)]), index.value
        overlap = 4 * max(own, default=1)

        def run(batches):
            for batch in batches:
                flat, lengths = _ids(batch)
                docs_, pieces, at = batch.column(0).to_pylist(), [], 0
                for doc, n in zip(docs_, lengths.tolist(), strict=True):
                    for lo in range(0, n, s.segment):
                        first = max(0, lo - overlap)
                        pieces.append((doc, first, at + first, at + min(n, lo + s.segment)))
                    at += n
                found, held, size = [], [], 0
                for piece in [*pieces, None]:
                    if held and (piece is None or size >= 10 * s.segment):
                        ids = np.concatenate([flat[x:y] for _, _, x, y in held])
                        for d, k, x, y, c in candidates_in(ids, np.array([y - x for _, _, x, y in held]), directions, own, words_of_items, s):
                            found.append((held[d][0], k, held[d][1] + x, held[d][1] + y, c))
                        held, size = [], 0
                    if piece:
                        held.append(piece)
                        size += piece[3] - piece[2]
                yield {n: [f[k] for f in found] for k, n in enumerate(("doc_id", "item", "lo", "hi", "cosine"))}
        return run

    near = map_batches(hashed.select("doc_id", "ids"), "doc_id bigint, item int, lo int, hi int, cosine double", candidates)
    near = durable(near.groupBy("doc_id").agg(F.collect_set(F.struct("item", "lo", "hi", "cosine")).alias("near")))

    def verify():
        known = texts.value

        def run(batches):
            for batch in batches:
                out = []
                for doc, text, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    words, best = words_of(text), {}
                    for p in places:
                        item_id, in_order, answer_words = known[p["item"]]
                        around = words[p["lo"]:p["hi"]]
                        share = common_length(in_order, around) / len(in_order)
                        answer = common_length(answer_words, around) >= s.answer * len(answer_words)
                        if share >= s.verbatim or share >= s.paraphrase and answer:
                            hit = (share, p["cosine"], answer)
                            best[item_id] = max(best.get(item_id, hit), hit)
                    out += [(doc, item, *hit) for item, hit in best.items()]
                yield {n: [f[k] for f in out] for k, n in enumerate(("doc_id", "item_id", "lcs_share", "cosine", "answer_found"))}
        return run

    # Texts are filtered by bare ids, which are broadcast only if they are few; windows are as many as they are and meet them by shuffle.
    held = by_ids(docs, near.select("doc_id"), "doc_id").join(near, "doc_id").select("doc_id", "text", "near")
    out = durable(map_batches(held, "doc_id bigint, item_id bigint, lcs_share double, cosine double, answer_found boolean", verify))
    release(near)
    index.destroy()
    texts.destroy()
    return out


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they repeat."""
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that repeat no benchmark item, in the columns they came with."""
    hits = durable(contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select("doc_id").distinct())
    return by_ids(docs, hits, "doc_id", "left_anti")


QUERIES = {"op10_benchmark_decontamination": op10_benchmark_decontamination}
ORACLES: dict[str, str] = {}
