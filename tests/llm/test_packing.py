import random

import pytest

from loomtrace.llm import packing
from loomtrace.llm.packing import Packing


def rows_of(spark, sizes, p):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, n_tokens bigint")
    return packing.pack(df, p).collect()


def check(rows, sizes, p):
    """Every token once, no overlap in a bin, and each bin of the smallest size that holds it."""
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        bins.setdefault((r.bin_id, r.capacity), []).append((r.offset, r.n_tokens))
    assert set(pieces) == {i for i, n in enumerate(sizes) if n}
    for i, spans in pieces.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == sizes[i]
    assert len(bins) == len({b for b, _ in bins})
    for (_, capacity), spans in bins.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert capacity == min(c for c in p.capacities if c >= at)
    return bins


def plain_best_fit(sizes, p):
    """The same rule with linear searches."""
    open_, out, left = [], [], sorted(sizes, reverse=True)
    for k, n in enumerate(list(left)):
        fit = [b for b in open_ if b[0] >= n]
        if fit:
            b = min(fit, key=lambda b: b[0])
        else:
            def held(c):
                room, rest = c - n, sorted(left[k + 1:], reverse=True)
                for _ in range(16):
                    big = next((x for x in rest if x <= room), 0)
                    if not big:
                        break
                    room -= big * min(rest.count(big), room // big)
                return c - room
            c = min((c for c in p.capacities if c >= n), key=lambda c: (p.cost(c) / held(c), c))
            b = [c, 0]
            open_.append(b)
        b[0] -= n
        b[1] += n
    return sorted(min(c for c in p.capacities if c >= b[1]) for b in open_)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_bins_as_plain_search(seed):
    rng = random.Random(seed)
    p = Packing(capacities=(16, 32, 64), fixed=1, attention=200)
    sizes = sorted((rng.choice([rng.randrange(1, 8), rng.randrange(1, 65)]) for _ in range(120)), reverse=True)
    where, capacity = packing.best_fit(sizes, p, p.capacities)
    assert sorted(capacity) == plain_best_fit(sizes, p)
    assert len(where) == len(sizes)


def test_whole_and_tight(spark):
    rng = random.Random(4)
    p = Packing(shard_tokens=20_000)
    sizes = [rng.choice([0, 1, 30, rng.randrange(1, 600), rng.randrange(1, 20_000)]) for _ in range(400)]
    bins = check(rows_of(spark, sizes, p), sizes, p)
    assert sum(sizes) / sum(c for _, c in bins) > 0.9


def test_empty_null_and_repeated(spark):
    p = Packing()
    assert rows_of(spark, [], p) == [] and rows_of(spark, [0, None], p) == []
    df = spark.createDataFrame([(1, 10), (1, 10), (None, 5)], "doc_id bigint, n_tokens bigint")
    out = packing.pack(df, p).collect()
    assert sorted(r.n_tokens for r in out) == [5, 10, 10] and {r.capacity for r in out} == {512}


def test_lengths_of_texts(spark):
    df = spark.createDataFrame([(1, " a b\nc ", "x"), (2, None, "y"), (3, "", "z")], "doc_id bigint, text string, n_tokens string")
    assert sorted(map(tuple, packing.lengths(df).collect())) == [(1, 3), (2, 0), (3, 0)]
