import random

import numpy as np
from fixtures import ODD, prose

from loomtrace.llm import decontaminate
from loomtrace.llm.decontaminate import Settings, common_length, words_of


def test_common_subsequence():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert common_length(a, b) == d[-1][-1]


def planted(seed=1, n=240):
    """Items, documents, and the pairs that hold an item: verbatim or with a few words changed, dropped or put in."""
    rng = random.Random(seed)
    items = [(i, " ".join(prose(rng, rng.choice((12, 20, 35, 60)), 3000)) + ". " + " ".join(prose(rng, 6, 3000)) + ".") for i in range(25)]
    docs, truth = [], set()
    for d in range(n):
        words = prose(rng, rng.randrange(5, 600), 3000)
        if d % 4 == 0:
            item = rng.randrange(len(items))
            w = items[item][1].split()
            if d % 8 == 0:
                for _ in range(len(w) // 8):
                    k = rng.randrange(len(w) - 6)
                    w[k:k + 1] = rng.choice(([], [f"new{d}"], [w[k], "well"]))
            at = rng.randrange(len(words) + 1)
            words[at:at] = w
            truth.add((d, item))
        docs.append((d, " ".join(words)))
    return items, docs, truth


def test_finds_planted_items_and_nothing_else(spark):
    items, docs, truth = planted()
    out = decontaminate.contaminated(spark.createDataFrame(docs + [(9000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string").repartition(4),
                                     spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    # Brute force: the share of an item's words in order, in every window of a document.
    assert len(got & truth) >= 0.98 * len(truth) and got <= truth


def test_segments_do_not_cut_items(spark):
    items, docs, truth = planted(2, 80)
    s = Settings(segment=50, items=7)
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), s)
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert len(got & truth) >= 0.98 * len(truth) and got <= truth


def test_answer_decides_on_paraphrases(spark):
    rng = random.Random(9)
    w = prose(rng, 40, 3000)
    half = [x if k % 5 else f"other{k}{j}" for j in range(1) for k, x in enumerate(w)]
    half = [x if k % 3 else f"changed{k}" for k, x in enumerate(half)]
    rows = [(1, " ".join(prose(rng, 30, 3000) + half + ["paris", "on", "the", "seine"])), (2, " ".join(prose(rng, 30, 3000) + half)),
            *((k, " ".join(prose(rng, 200, 3000))) for k in range(3, 60))]
    bench = spark.createDataFrame([(7, " ".join(w), "Paris on the Seine"), (8, None, None)], "item_id bigint, text string, answer string")
    out = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()
    share = common_length([x.encode() for x in w], words_of(rows[0][1])) / len(w)
    assert 0.5 <= share < 0.75 and [(r.doc_id, r.item_id, r.answer_found) for r in out] == [(1, 7, True)]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == []
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []


def test_equals_brute_force_over_all_windows(spark):
    """Every pair that some stretch of a document of an item's length and a half verifies, found by trying all stretches."""
    rng = random.Random(12)
    items = [(i, " ".join(prose(rng, rng.randrange(12, 40), 2000))) for i in range(12)]
    docs = []
    for d in range(150):
        words = prose(rng, rng.randrange(20, 120), 2000)
        if d % 3 == 0:
            w = items[rng.randrange(12)][1].split()
            gone = rng.sample(range(len(w)), rng.randrange(len(w)))
            at = rng.randrange(len(words) + 1)
            words[at:at] = [f"n{k}" if k in gone else x for k, x in enumerate(w)]
        docs.append((d, " ".join(words)))
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = item.split(), text.split()
            for lo in range(max(1, len(b) - len(a) + 1)):
                part = b[lo:lo + len(a)]
                share = common_length(a, part) / len(a)
                if share >= 0.75 or share >= 0.5 and common_length(a[-5:], part) >= 4:
                    want.add((d, i))
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert len(want) > 10 and len(got & want) >= 0.9 * len(want)
    # What is more than that is accepted in the wider surroundings of a window.
    assert all(common_length(dict(items)[i].split(), dict(docs)[d].split()) >= 0.5 * len(dict(items)[i].split()) for d, i in got - want)


def test_the_gate_loses_nothing():
    """Where a stretch passes the verification, the two blocks from its beginning on are open for the item."""
    rng = random.Random(13)
    s = Settings()
    made = decontaminate.prepared([{"item_id": i, "text": " ".join(prose(rng, rng.randrange(3, 30), 60))} for i in range(20)],
                                  np.zeros((s.dims, s.rank), dtype=np.float32), s)
    p, buckets = decontaminate.postings(made, s), decontaminate.Buckets(s.dims)
    lengths = np.array([0, 5, 700, 1, 333])
    ids = buckets.of([w.encode() for w in prose(rng, int(lengths.sum()), 60)])
    could, blocks = decontaminate.possible(ids, lengths, p)
    begins, passed = np.cumsum(lengths) - lengths, 0
    for d, n in enumerate(lengths):
        for lo in range(n):
            part = ids[begins[d] + lo:begins[d] + min(n, lo + p.reach)]
            for k, item in enumerate(made):
                share = common_length(buckets.of(item.words).tolist(), part.tolist()) / len(item.words)
                answer = common_length(buckets.of(item.answer).tolist(), part.tolist()) >= s.answer * len(item.answer)
                if share >= s.verbatim or share >= s.paraphrase and answer:
                    passed += 1
                    assert could[blocks[d] + lo // p.reach, k]
    assert passed > 100 and could.mean() < 0.9


def test_the_gate_counts_words_in_tables_of_bounded_size():
    """Words that many items have, words that few have and words of answers alone; tables of one block, of a few and of all blocks."""
    rng = random.Random(23)
    s = Settings()
    words = lambda n: [*prose(rng, n, 40), *(f"rare{rng.randrange(300)}" for _ in range(n // 3))]
    made = decontaminate.prepared([{"item_id": i, "text": " ".join(words(rng.randrange(3, 25))), "answer": " ".join(words(6)) if i % 2 else None} for i in range(60)],
                                  np.zeros((s.dims, s.rank), dtype=np.float32), s)
    buckets, lengths = decontaminate.Buckets(s.dims), np.array([0, 7, 900, 0, 1, 400, 60, 0])
    ids = buckets.of([w.encode() for w in words(1100)[:int(lengths.sum())]])
    for share in (1, 8, 100):
        p = decontaminate.postings(made, s, share)
        per, begins = -(-lengths // p.reach), np.cumsum(lengths) - lengths
        want = []
        for d, n in enumerate(lengths):
            for k in range(per[d]):
                here = set(ids[begins[d] + k * p.reach:begins[d] + min(n, (k + 2) * p.reach)].tolist())
                count = lambda text: sum(b in here for b in buckets.of(text).tolist())  # noqa: E731,B023
                want.append([count(i.words) >= s.verbatim * len(i.words) or count(i.words) >= s.paraphrase * len(i.words) and count(i.answer) >= s.answer * len(i.answer)
                             for i in made])
        for cells in (1, 3 * len(p.bucket), 8_000_000):
            could, base = decontaminate.possible(ids, lengths, p, cells)
            assert could.tolist() == want and base.tolist() == (np.cumsum(per) - per).tolist()
    assert 0.02 < np.mean(want) < 0.98 and len(p.often) < len(p.bucket)


def test_odd_rows_and_columns(spark):
    text = " ".join(f"q{k}" for k in range(30))
    rows = [(1, text, "x", "y"), (1, text, "x", "y"), (None, text, "x", "y"), (2, None, "x", "y"), (3, "", "x", "y"), (4, "q1 " * 50_000 + text, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, near string, ids string")
    bench = spark.createDataFrame([(7, text + ".", "x"), (7, text + ".", "x"), (None, text, "x"), (9, None, "x")], "item_id bigint, text string, near string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(1, 0), (1, 7), (4, 0), (4, 7)]


def test_the_space_is_fitted_on_all_passages(spark):
    """Passages of one word each, all words equally frequent: every word has a direction of its own, and all have the same weight."""
    hashed = spark.range(260_004).selectExpr("array(cast(id % 12 AS int)) AS ids")
    weight = np.linalg.norm(decontaminate.fit(hashed, Settings(dims=64, rank=12, extra=4)), axis=1)
    assert weight[0] > 0 and np.allclose(weight[:12], weight[0], rtol=1e-2) and weight[12:].max() < 1e-2 * weight[0]


def test_moments_of_common_rare_and_filling_words():
    """Sums as by a dense matrix of passages, whether a word occurs once, often in one passage, or in most of them."""
    rng = np.random.default_rng(4)
    rows = (60 * rng.random((70, 12)) ** 3).astype(np.int32)
    rows[::3, 5:] = 60  # filled up
    rows[7], rows[8] = 59, 60
    weight, omega = np.append(rng.random(60), 0).astype(np.float32), rng.standard_normal((61, 5)).astype(np.float32)
    dense = np.zeros((70, 61))
    np.add.at(dense, (np.arange(70)[:, None], rows), weight[rows])
    norm = np.maximum((weight[rows] ** 2).sum(axis=1), 1e-9)[:, None]
    want = (dense.T @ (dense @ omega / norm))[:60]
    for often in (0, 3, 16, 1000):
        y = np.ones((60, 5), dtype=np.float32)
        decontaminate.add_moments(rows, weight, omega * weight[:, None], y, often)
        assert np.allclose(y - 1, want, rtol=1e-3, atol=1e-4)
