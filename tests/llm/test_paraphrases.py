"""Recall of paraphrases that the verification accepts."""
import random
from bisect import bisect
from itertools import accumulate

from loomtrace.llm import decontaminate
from loomtrace.llm.decontaminate import common_length

_SUMS = list(accumulate(1 / (k + 2) for k in range(20_000)))


def zipf(rng, n):
    return [f"z{bisect(_SUMS, rng.random() * _SUMS[-1])}" for _ in range(n)]


def paraphrased(seed=4, n_docs=4000, n_items=600):
    """Items with an answer of six words, documents, and the pairs of which the document has 50 to 75 % of the item's words in order."""
    rng = random.Random(seed)
    items = [(i, " ".join(zipf(rng, rng.randrange(20, 50))) + ". " + " ".join(zipf(rng, 6)) + ".") for i in range(n_items)]
    docs, truth = [], {}
    for d in range(n_docs):
        words = zipf(rng, rng.randrange(60, 400))
        if d % 5 == 0:
            item = d // 5 % n_items
            w = items[item][1].replace(".", "").split()
            share = rng.uniform(0.5, 0.75)
            body = [x if rng.random() < (share * len(w) - 6) / (len(w) - 6) else zipf(rng, 1)[0] for x in w[:-6]] + w[-6:]
            got = common_length([x.encode() for x in w], [x.encode() for x in body]) / len(w)
            if 0.5 <= got < 0.75:
                at = rng.randrange(len(words) + 1)
                words[at:at] = body
                truth[d, item] = got
        docs.append((d, " ".join(words)))
    return items, docs, truth


def test_recall_of_paraphrases(spark):
    items, docs, truth = paraphrased()
    out = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    for low, high in ((0.5, 0.6), (0.6, 0.75)):
        want = {k for k, share in truth.items() if low <= share < high}
        assert len(want) > 100 and len(got & want) >= 0.9 * len(want), (low, len(got & want), len(want))


def test_paraphrase_of_one_sentence(spark):
    rng = random.Random(6)
    w = [f"q{rng.randrange(3000)}" for _ in range(30)]
    half = [f"other{k}" if k < 25 and k % 5 in (1, 3) else x for k, x in enumerate(w)]
    no_answer = [f"other{k}" if k >= 25 or k % 5 == 1 else x for k, x in enumerate(w)]
    filling = lambda n: [f"q{rng.randrange(3000)}" for _ in range(n)]
    rows = [(1, " ".join(filling(30) + half)), (2, " ".join(filling(30) + no_answer)), *((k, " ".join(filling(200))) for k in range(3, 60))]
    bench = spark.createDataFrame([(7, " ".join(w) + ".")], "item_id bigint, text string")
    out = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()
    assert [(r.doc_id, r.item_id, r.answer_found) for r in out] == [(1, 7, True)] and 0.5 <= out[0].lcs_share < 0.75
