"""Toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits used as letters) and scanned by an Aho-Corasick automaton of weighted terms: whole
words and beginnings of words. Terms and phrases that excuse them are learned from labelled rows; hits are normalised by the length of the
text, and a logistic curve fitted on the same rows turns them into a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.arrow import map_batches, map_rows
from loomtrace.llm.registry import table
from loomtrace.session import durable, release

# Letters of other scripts that look like Latin ones, and characters used in place of letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "n", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a", "ᴏ": "o",
}
_SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "l"}
_INVISIBLE = "­​‌‍⁠﻿"

_FOLD = str.maketrans(_LOOKALIKES | _SUBSTITUTES | {chr(0xFF41 + i): chr(ord("a") + i) for i in range(26)} | dict.fromkeys(_INVISIBLE, ""))
_WORD = re.compile(r"[^\W_]+")


def folded(text: str | None) -> list[str]:
    """The words of a text after folding. Missing and empty texts have none."""
    return _WORD.findall(text.lower().translate(_FOLD)) if text else []


@dataclass(frozen=True)
class Learning:
    """``fit_rows`` bounds the labelled rows that are learned from: a hash sample of the rows that may be used, all if they are fewer."""

    fit_rows: int = 100_000
    #: Word beginnings of these lengths are terms, beside whole words.
    shortest: int = 4
    longest: int = 8
    #: A term needs so many toxic rows, different words before it, and times the rate of clean rows; more terms (or
    #: phrases that excuse one) than ``most_terms`` are an error, never cut.
    least_rows: int = 5
    least_contexts: int = 5
    ratio: float = 20.0
    most_terms: int = 200_000
    #: A pair of words excuses the term in it when it is in so many clean rows and in no toxic one.
    excuse_rows: int = 3


@dataclass
class Lexicon:
    weights: dict[str, float]
    excuses: frozenset[str] = frozenset()
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0, 0.0]))

    def automaton(self):
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight))
        if self.weights:
            out.make_automaton()
        return out


def hits(words: list[str], automaton, excuses: frozenset[str]) -> list[tuple[int, float]]:
    """(number of the word, weight) of every word in which a term begins, by its heaviest term, without excused ones."""
    if not len(automaton) or not words:
        return []
    text = " " + " ".join(words) + " "
    found: dict[int, float] = {}
    for end, (size, weight) in automaton.iter(text):
        at = end - size + 1
        found[at] = max(found.get(at, 0.0), weight)
    if not found:
        return []
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    out = []
    for at in sorted(found):
        i = int(np.searchsorted(starts, at))
        around = (" ".join(words[max(0, i - 1):i + 1]), " ".join(words[i:i + 2]))
        if not excuses or excuses.isdisjoint(around):
            out.append((i, found[at]))
    return out


def features(words: list[str], automaton, excuses: frozenset[str]) -> tuple[float, float, float]:
    """Logarithm of the summed weights, the sum by the root of the length, the heaviest weight."""
    return of_hits(hits(words, automaton, excuses), len(words))


def of_hits(found: list[tuple[int, float]], n_words: int) -> tuple[float, float, float]:
    weights = [w for _, w in found]
    total = sum(weights)
    return float(np.log1p(total)), total / max(1.0, n_words) ** 0.5, max(weights, default=0.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, rule: Learning) -> DataFrame:
    """``text, toxic`` of the rows to learn from, each text once; of equal texts with different labels the toxic one counts. At most about
    ``fit_rows`` labels are broadcast; texts are not shuffled before."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = max(1, -(-usable.count() // rule.fit_rows))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text <> ''")
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, rule: Learning = Learning()) -> Lexicon:
    """Terms, excuses and curve from labelled rows that are not held out. Without labels of both kinds nothing is toxic."""
    rows = durable(labelled(docs, labels, rule))
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        release(rows)
        return Lexicon({})
    candidates = _candidates(rows, n, rule)
    lexicon = Lexicon(_varied(rows, candidates, rule))
    lexicon.excuses = _excuses(rows, lexicon, rule)
    lexicon.curve = _curve(rows, lexicon)
    release(rows)
    return lexicon


def terms_of(word: str, rule: Learning) -> list[str]:
    """A term begins with a blank, so it only matches where a word begins; a whole word ends with one."""
    return [f" {word} ", *(f" {word[:k]}" for k in range(rule.shortest, min(rule.longest, len(word)) + 1))]


def _candidates(rows: DataFrame, n: dict[int, int], rule: Learning) -> dict[str, float]:
    def make():
        def run(batches):
            count: dict[str, list[int]] = {}
            for batch in batches:
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for term in {t for w in set(folded(text)) for t in terms_of(w, rule)}:
                        count.setdefault(term, [0, 0])[toxic] += 1
                if len(count) > 500_000:
                    yield {"term": list(count), "clean": [c[0] for c in count.values()], "toxic": [c[1] for c in count.values()]}
                    count = {}
            yield {"term": list(count), "clean": [c[0] for c in count.values()], "toxic": [c[1] for c in count.values()]}
        return run

    counts = map_batches(rows.select("text", "toxic"), "term string, clean bigint, toxic bigint", make)
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = (F.col("toxic") + 0.5) / (n[1] + 1) / ((F.col("clean") + 0.5) / (n[0] + 1))
    top = counts.filter((F.col("toxic") >= rule.least_rows) & (rate >= rule.ratio)).select("term", "toxic", F.log(rate).alias("w"))
    return {r.term: r.w for r in _all(top, "term", rule.most_terms)}


def _all(rows: DataFrame, key: str, most: int) -> list:
    """The rows in order of ``key``; an error if there are more than the driver should hold."""
    out = rows.limit(most + 1).collect()
    if len(out) > most:
        raise ValueError(f"more than {most} terms pass the thresholds; raise them or most_terms")
    return sorted(out, key=lambda r: r[key])


def _varied(rows: DataFrame, candidates: dict[str, float], rule: Learning) -> dict[str, float]:
    """Terms with enough different words before them: what only near copies of one text share is not a term."""
    shared = rows.sparkSession.sparkContext.broadcast(candidates)

    def make():
        automaton = Lexicon(shared.value).automaton()

        def run(batches):
            for batch in batches:
                found: set[tuple[str, str]] = set()
                for text in batch.column(0).to_pylist():
                    words = folded(text)
                    joined = " " + " ".join(words) + " "
                    if len(automaton):
                        for end, (size, _) in automaton.iter(joined):
                            at = end - size + 1
                            found.add((joined[at:end + 1], joined[joined.rfind(" ", 0, at) + 1:at] if at else ""))
                yield {"term": [f[0] for f in found], "before": [f[1] for f in found]}
        return run

    seen = map_batches(rows.filter("toxic = 1").select("text"), "term string, before string", make)
    enough = seen.distinct().groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= rule.least_contexts)
    return {r.term: candidates[r.term] for r in enough.collect()}


def _excuses(rows: DataFrame, lexicon: Lexicon, rule: Learning) -> frozenset[str]:
    shared = rows.sparkSession.sparkContext.broadcast(lexicon.weights)

    def make():
        automaton = Lexicon(shared.value).automaton()

        def run(batches):
            for batch in batches:
                out = []
                for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    words = folded(text)
                    found = {i for i, _ in hits(words, automaton, frozenset())}
                    out += [(p, toxic) for p in {" ".join(p) for i in found for p in (words[max(0, i - 1):i + 1], words[i:i + 2]) if len(p) == 2}]
                yield {"phrase": [x[0] for x in out], "toxic": [x[1] for x in out]}
        return run

    pairs = map_batches(rows.select("text", "toxic"), "phrase string, toxic int", make)
    counts = pairs.groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    chosen = counts.filter((F.col("toxic") == 0) & (F.col("clean") >= rule.excuse_rows))
    return frozenset(r.phrase for r in _all(chosen, "phrase", rule.most_terms))


def _curve(rows: DataFrame, lexicon: Lexicon, steps: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression of the label on the features, by Newton's method; at most ``fit_rows`` rows of three numbers."""
    shared = rows.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.excuses))

    def make():
        weights, excuses = shared.value
        automaton = Lexicon(weights).automaton()

        def step(batch):
            f = [features(folded(t), automaton, excuses) for t in batch.column(1).to_pylist()]
            return {f"f{i}": [x[i] for x in f] for i in range(3)}
        return step

    data = np.array(map_rows(rows.select("toxic", "text"), ["toxic"], "f0 double, f1 double, f2 double", make).collect(), dtype=np.float64)
    x, y, b = np.column_stack([np.ones(len(data)), data[:, 1:]]), data[:, 0], np.zeros(4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(4)
        b = b + np.linalg.solve(hessian, x.T @ (y - p) - ridge * b)
    return b


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, n_hits`` of every row's whole text, without a shuffle. Missing and empty texts score as texts without hits."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.weights, lexicon.excuses, lexicon.curve))

    def make():
        weights, excuses, curve = shared.value
        automaton = Lexicon(weights).automaton()

        def step(batch):
            words = [folded(t) for t in batch.column(1).to_pylist()]
            found = [hits(w, automaton, excuses) for w in words]
            f = np.array([(1.0, *of_hits(h, len(w))) for h, w in zip(found, words, strict=True)])
            return {"score": 1 / (1 + np.exp(-np.clip(f @ curve, -30, 30))), "n_hits": [len(h) for h in found]}
        return step

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(given, ["doc_id", "text"], "score double, n_hits bigint", make).drop("text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the lexicon learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = score(docs, learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
