import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.operators import similarity
from loomtrace.schemas import TRACE_EVENT
from test_signals import row


def brute_weights(texts, stop=()):
    docs = []
    for t in texts:
        w = [x for x in similarity_tokens(t) if x not in stop]
        docs.append(Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:])))
    n = len(docs)
    df = Counter(t for d in docs for t in d)
    out = []
    for d in docs:
        v = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in d.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({t: x / norm for t, x in v.items()})
    return out


def similarity_tokens(text):
    import re
    return re.findall(r"\b\w\w+\b", text.lower())


def dot(a, b):
    return sum(x * b.get(t, 0.0) for t, x in a.items())


GROUPS = {"a": ["red green blue", "red green", "blue sky", "green"], "b": ["one"], "c": ["x y", "z"], "d": ["same text", "same text"], "e": ["éàü été", "été red"]}


def test_continuity(spark):
    rows = [(g, i + 1, t) for g, ts in GROUPS.items() for i, t in enumerate(ts)]
    got = {r["g"]: (r["continuity"], r["evolution"]) for r in similarity.continuity(
        spark.createDataFrame(rows, "g STRING, n INT, text STRING"), ["g"], "n", stop=[]).collect()}
    for g, ts in GROUPS.items():
        w = brute_weights(ts)
        if len(ts) < 2 or not any(w):
            want = (0.0, 0.0)
        else:
            mean = sum(dot(a, b) for a, b in zip(w, w[1:])) / (len(ts) - 1)
            want = (round(mean, 4), round(1 - mean, 4))
        assert got[g] == pytest.approx(want, abs=1e-9), g


def test_joined_documents_equal_concatenation(spark):
    rng = random.Random(2)
    words = ["red", "green", "the", "blue", "x", "sky"]
    rows = [(d, i, " ".join(rng.choices(words, k=rng.randint(0, 4)))) for d in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "doc INT, pos INT, text STRING")
    got = {(r["doc"], r["term"]): r["tf"] for r in similarity.joined_term_counts(df, ["doc"], "pos", F.floor(F.col("pos") / 2)).collect()}
    whole = spark.createDataFrame([(d, " ".join(t for x, _, t in rows if x == d)) for d in range(4)], "doc INT, text STRING")
    want = {(r["doc"], r["term"]): r["tf"] for r in similarity.term_counts(whole, ["doc"]).collect()}
    assert got == want


@pytest.mark.parametrize("documents", [1, 500])
def test_terms_are_made_in_all_tasks(spark, documents, monkeypatch):
    """Token lists of few bytes are not merged into one task before they are made into terms, whether they are one document's or many."""
    n, dealt = int(spark.conf.get("spark.sql.shuffle.partitions")), []
    deal = similarity.by_key
    monkeypatch.setattr(similarity, "by_key", lambda d, *keys: dealt.append(deal(d, *keys)) or dealt[-1])
    rows = [(i % documents, i, f"w{i} v{i % 7}") for i in range(1000)] + [(0, None, "zebra text")] * 5
    df = spark.createDataFrame(rows, "doc INT, pos INT, text STRING")
    got = Counter({(r["doc"], r["term"]): r["tf"] for r in similarity.joined_term_counts(df, ["doc"], "pos", F.floor(F.col("pos") / 100)).collect()})
    assert got[0, "zebra"] == 5 and sum(v for (_, term), v in got.items() if " " not in term) == 2010
    sizes = [r["count"] for r in dealt[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(dealt) == 1 and sum(sizes) == 1005 and len(sizes) == n and max(sizes) < 2 * 1005 / n


def test_pair_tfidf(spark):
    pairs = [(0, "red green blue", "red blue green"), (1, "a", "b"), (2, "red", "red"), (3, "", "red")]
    got = {r["k"]: r["score"] for r in similarity.pair_tfidf(spark.createDataFrame(pairs, "k INT, l STRING, r STRING"), "k", "l", "r", []).collect()}
    for k, a, b in pairs:
        w = brute_weights([a, b])
        assert got[k] == pytest.approx(dot(w[0], w[1]), abs=1e-12)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_similar_pairs_with_copies(spark, block_rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    vecs = [base[i % 12] + rng.normal(size=8) * 0.15 for i in range(60)] + [base[0]] * 9
    rows = [(i, f"t{i % 4}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "id BIGINT, trajectory_id STRING, embedding ARRAY<FLOAT>")
    got = {(r["id_a"], r["id_b"]): (r["similarity"], r["pairs"]) for r in similarity.similar_pairs(df, 0.88, pivot_count=5, block_rows=block_rows).collect()}
    m = np.array([np.float32(r[2]) for r in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True) + 1e-8
    sims = m @ m.T
    rep = {}
    for i, r in enumerate(rows):
        rep.setdefault(tuple(np.float32(r[2])), i)
    first = [rep[tuple(np.float32(r[2]))] for r in rows]
    want = Counter()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if rows[i][1] != rows[j][1] and sims[i, j] >= 0.88:
                want[min(first[i], first[j]), max(first[i], first[j])] += 1
    assert {k: v[1] for k, v in got.items()} == dict(want)


@pytest.mark.parametrize("threshold", [0.88, 0.3])
def test_vectors_without_clusters_are_not_copied_to_every_cell(spark, threshold, monkeypatch):
    """What is shuffled for comparison grows with the blocks and not with the pivots, and all pairs are found."""
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(400, 16)).astype(np.float32)
    vecs[300:] = vecs[:100] + rng.normal(size=(100, 16)).astype(np.float32) * 0.1
    df = spark.createDataFrame([(i, f"t{i}", [float(x) for x in v]) for i, v in enumerate(vecs)], "id BIGINT, trajectory_id STRING, embedding ARRAY<FLOAT>")
    moved = []
    shuffled = similarity.by_key
    monkeypatch.setattr(similarity, "by_key", lambda d, *keys: moved.append(d.count()) or shuffled(d, *keys))
    got = {(r["id_a"], r["id_b"]) for r in similarity.similar_pairs(df, threshold, pivot_count=100, block_rows=100).collect()}
    u = vecs.astype(np.float64) / np.linalg.norm(vecs.astype(np.float64), axis=1, keepdims=True)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1)))}
    assert moved[0] <= 400 * 8  # blocks are at least half full


def test_blocks_hold_every_cell_within_the_limit():
    sizes = np.array([3, 250, 40, 70, 1, 99])
    first, parts, holds = similarity._blocks(sizes, np.random.default_rng(1).random((6, 6)), 100)
    assert parts.tolist() == [1, 3, 1, 1, 1, 1] and all(holds[first[c]:first[c] + parts[c], c].all() for c in range(6))
    assert holds.sum() == 8 and all(holds[b] @ (sizes / parts) <= 100 for b in range(len(holds)))
