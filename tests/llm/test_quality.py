import random

import pytest
from fixtures import ODD, corpus

from loomtrace.llm import quality
from loomtrace.llm.quality import MEASURES, measure


def plain(text):
    """Base measurements by the words of the contract, with plain loops."""
    words, lines = (text or "").encode().split(), (text or "").split("\n")
    hit = [False] * len(words)
    for i in range(len(words) - 2):
        if sum(words[j:j + 3] == words[i:i + 3] for j in range(len(words) - 2)) > 1:
            hit[i] = hit[i + 1] = hit[i + 2] = True
    full = [x for x in lines if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), sum(hit))


@pytest.mark.parametrize("seed", [1, 2])
def test_measures_equal_plain_loops(seed):
    rng = random.Random(seed)
    texts = [t for _, t in corpus(seed, 30) if t is None or len(t) < 2500]
    texts += ["\n".join(rng.choice(["a b c", "x y", "", " ", "a|b #c"]) for _ in range(12)) for _ in range(30)]
    for text in texts:
        got = dict(zip(MEASURES, measure(text.encode() if text is not None else None), strict=True))
        assert tuple(got[m] for m in MEASURES[:5]) == plain(text), text


def test_ledger_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(80)) + "."
    rows = [(1, good, 9), (2, "short", 9), (3, good.upper().replace(" ", "!! "), 9), (4, " ".join(w + "###" for w in good.split()), 9), (5, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")  # a column of the ledger's own name
    ledger = quality.ledger(docs).cache()
    kept = {r.row.doc_id: r.kept for r in quality.apply_policy(ledger).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}
    older = {r.row.doc_id: r.kept for r in quality.apply_policy(ledger, quality.POLICIES[0]).collect()}
    assert older == {1: True, 2: False, 3: True, 4: True, 5: False}
    table = {(r.policy_version, r.rule): r for r in quality.ablations(ledger).collect()}
    assert table["v2-surface", "symbols"].n_only_this == 1 and table["v2-surface", "upper_case"].n_only_this == 1
    assert table["v1-base", "few_words"].n_only_this == 2 and table["v1-base", "symbols"].n_only_this == 0
    assert all(r.n_rejected == (2 if v == "v1-base" else 4) for (v, _), r in table.items())
    profile = quality.failure_profile(ledger).first()
    assert profile.n_docs == 5 and profile.all_fail == 0


def test_stage_keeps_columns_and_empty_tables(spark):
    schema = "doc_id bigint, text string, failed_bits string"
    good = " ".join(f"word{i}" for i in range(80))
    out = quality.stage(spark, spark.createDataFrame([(1, good, "x"), (1, good, "x"), (None, good, None), (2, "", "y")], schema), "")
    assert out.columns == ["doc_id", "text", "failed_bits"] and sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]
    assert quality.stage(spark, spark.createDataFrame([], schema), "").collect() == []
    assert quality.ledger(spark.createDataFrame(list(enumerate(ODD)), "doc_id int, text string")).count() == len(ODD)
