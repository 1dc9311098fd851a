import hashlib
import math
import random
from dataclasses import replace

import pytest

from loomtrace.llm import centroids
from loomtrace.llm.centroids import Settings, clustered

SMALL = Settings(k=5, rounds=3, dims=6, blocks=4, chunk=7)


def plain(rows, s):
    """Lloyd's rounds in whole numbers; (id, cluster, distance) of every vector and the centroids."""
    fine = lambda v: v is not None and len(v) == s.dims and all(x is not None and math.isfinite(x) and abs(x) * s.scale < s.limit for x in v)
    vectors = [(i, [math.floor(x * s.scale) for x in v]) for i, v in rows if fine(v)]
    first = sorted((hashlib.sha256(f"{s.seed}{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)[:s.k]
    centres = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    if not centres:
        return [], []
    for _ in range(s.rounds):
        groups = {}
        for _, v in vectors:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    return [(i, near(v)[1], near(v)[0]) for i, v in vectors], centres


def run(spark, rows, s, partitions=3):
    frame = spark.createDataFrame([(i, v, "c", "b") for i, v in rows], "vec_id bigint, embedding array<double>, chunk string, block string").repartition(partitions)
    out, centres = clustered(frame, s)
    return [tuple(r) for r in out.collect()], [r.centre for r in sorted(centres.collect())]


def key(r):
    return (r[0] is not None, r[0] or 0, r[1:])


@pytest.mark.parametrize("large", [1, 90_000])
def test_equals_plain_lloyd(spark, large):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(rng.choice([-1, 1, 3]) * large, 0.3 * large) for _ in range(SMALL.dims)]) for i in range(60)]
    rows += [(i, rows[0][1]) for i in range(200, 240)]  # one common vector
    rows += [(7, rows[3][1]), (7, rows[7][1]), (None, rows[5][1])]  # repeated and missing ids
    odd = [None, [], [1.0] * 5, [1.0] * 7, [1.0, None, 1.0, 1.0, 1.0, 1.0], [math.nan] * 6, [math.inf] + [0.0] * 5, [-math.inf] + [0.0] * 5, [1e300] * 6, [float(SMALL.limit)] * 6]
    got, centres = run(spark, rows + [(900 + i, v) for i, v in enumerate(odd)], SMALL)
    want, means = plain(rows, SMALL)
    assert sorted(got, key=key) == sorted(want, key=key) and centres == means
    assert len(got) == len(rows)


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2)] * SMALL.dims) for i in range(40)]
    got, centres = run(spark, rows, SMALL)
    assert (sorted(got), centres) == ((lambda w: (sorted(w[0]), w[1]))(plain(rows, SMALL)))
    assert len({c for _, c, _ in got}) == 2 and len(centres) == 5


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i)] * SMALL.dims) for i in range(3)]
    assert (lambda g: (sorted(g[0]), g[1]))(run(spark, rows, SMALL)) == plain(rows, SMALL)
    assert run(spark, [], SMALL, 1) == ([], []) == run(spark, [(None, [1.0] * SMALL.dims)], SMALL, 1)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(6)
        rows = [(i, [rng.random() for _ in range(SMALL.dims)]) for i in range(50)]
        s = replace(SMALL, rounds=2)
        assert (lambda g: (sorted(g[0]), g[1]))(run(spark, rows, s)) == plain(rows, s)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
