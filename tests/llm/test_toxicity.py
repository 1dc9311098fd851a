import random
import zlib

import pytest
from fixtures import ODD, prose

from loomtrace.llm import toxicity
from loomtrace.llm.toxicity import Learning, Lexicon, features, folded, hits


def test_folding():
    assert folded("Ｉdiot 1D10T іdiоt $cum​!") == ["idiot", "idiot", "idiot", "scum"]
    assert folded(None) == [] and folded("") == []


def test_hits_by_plain_search():
    rng = random.Random(1)
    lexicon = {" bad ": 3.0, " badg": 1.0, " evil": 2.0}
    auto = Lexicon(lexicon).automaton()
    for _ in range(200):
        words = [rng.choice(["bad", "badge", "evil", "evils", "devil", "good", "ok"]) for _ in range(rng.randrange(12))]
        want = [(i, max(w for t, w in lexicon.items() if f" {x} ".startswith(t))) for i, x in enumerate(words) if any(f" {x} ".startswith(t) for t in lexicon)]
        assert hits(words, auto, frozenset()) == want
    assert hits(["not", "bad", "really", "bad"], auto, frozenset(["not bad"])) == [(3, 3.0)]
    assert hits(["a"], Lexicon({}).automaton(), frozenset()) == []


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        words, toxic = prose(rng, rng.randrange(3, 120), 300), i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["idiot", "ld1ot", "scum", "vequ" + rng.choice(["mo", "ta", "le", "ns", "xi"])]))
        elif i % 7 == 0:
            words[0:0] = ["fish", "scum"]  # a phrase that only clean texts have
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(5000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, toxic int"), Learning(ratio=2.0))
    assert "fish scum" in lexicon.excuses and any(t.startswith(" vequ") for t in lexicon.weights)
    out = {r.doc_id: r.score for r in toxicity.score(docs, lexicon).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    held = [(out[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == y for s, y in held) >= 0.97 * len(held)


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, f"nasty{i} word text {i}") for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    ids = {int(r.text.split()[-1]) for r in toxicity.labelled(docs, labels, Learning()).collect()}
    assert ids == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert lexicon.weights == {} and features(["a"], lexicon.automaton(), frozenset()) == (0.0, 0.0, 0.0)
    assert {r.score < 0.5 for r in toxicity.score(docs, lexicon).collect()} == {True}


def test_equal_texts_with_different_labels(spark):
    """The toxic label counts, however the rows are dealt; null ids and texts, repeated rows and clashing names do no harm."""
    rows = [(i, "one text", "x", "y") for i in range(30)] + [(None, "one text", "x", "y"), (90, None, "x", "y"), (91, "", "x", "y"), (91, "", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string, score string")
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(30)] + [(3, 0), (None, 1), (90, 1)], "doc_id bigint, toxic int")
    usable = {r.doc_id for r in docs.filter(~toxicity.held_out(docs.doc_id)).collect()}
    want = [("one text", int(3 in usable))]
    for n in (1, 3, 7):
        assert [tuple(r) for r in toxicity.labelled(docs.repartition(n), labels.repartition(n), toxicity.Learning()).collect()] == want
    scored = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels)).collect() == []


def test_too_many_terms_are_an_error(spark):
    with pytest.raises(ValueError):
        toxicity._all(spark.range(5).withColumnRenamed("id", "term"), "term", 4)
