import random

import pytest
from fixtures import corpus, prose

from loomtrace.llm import jaccard


def brute(rows, percent=80):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert result(spark, rows) == brute(rows)


def test_near_copies_of_near_copies(spark):
    """Chains whose ends are not similar, and a large group around one text."""
    rng = random.Random(5)
    base, rows = prose(rng, 120, 5000), []
    words = list(base)
    for i in range(60):
        edited = list(base)
        for _ in range(rng.randrange(1, 4)):
            edited[rng.randrange(120)] = f"z{i}{rng.randrange(999)}"
        rows.append((i, " ".join(edited)))
    for i in range(60, 80):
        words[(i * 5) % 120] = f"chain{i}"
        rows.append((i, " ".join(words)))
    assert result(spark, rows) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert result(spark, [], 1) == {}
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (3, text), (None, text), (8, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    assert got == [(3, 26, 3), (5, 26, 3), (5, 26, 3), (8, 0, 8), (None, 26, 3)]


def test_stage_keeps_columns_and_one_of_each(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(2, text, "n"), (1, text, "m"), (3, None, "rep")], "doc_id bigint, text string, component string")
    out = jaccard.stage(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
