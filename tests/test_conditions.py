import math
import random
import re

import numpy as np

from loomtrace.operators import conditions


def plain(train, test, vocabulary=10_000):
    """Probabilities of a balanced multinomial logistic regression on TF-IDF, by gradient descent."""
    terms = lambda t: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])])(re.findall(r"\w{2,}", t.lower()))
    docs = [terms(t) for t, _ in train]
    names = sorted({x for d in docs for x in d})
    column, df = {n: i for i, n in enumerate(names)}, {n: sum(n in d for d in docs) for n in names}
    idf = np.array([math.log((len(docs) + 1) / (df[n] + 1)) + 1 for n in names])

    def vectors(texts):
        x = np.zeros((len(texts), len(names)))
        for i, d in enumerate(texts):
            for t in d:
                if t in column:
                    x[i, column[t]] += 1
        x *= idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    labels = sorted({y for _, y in train})
    y = np.array([labels.index(v) for _, v in train])
    weight = np.array([len(y) / (len(labels) * (y == k).sum()) for k in range(len(labels))])[y]
    x, w, b = vectors(docs), np.zeros((len(names), len(labels))), np.zeros(len(labels))

    def probability(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    for _ in range(6000):
        g = (probability(x @ w + b) - np.eye(len(labels))[y]) * weight[:, None] / weight.sum()
        w -= 2.0 * (x.T @ g + w / len(y))
        b -= 2.0 * g.sum(axis=0)
    return probability(vectors([terms(t) for t, _ in test]) @ w + b), labels


def test_classifier_equals_a_plain_one(spark):
    rng = random.Random(3)
    words = {"a": "red green blue", "b": "one two three", "c": "cat dog cow"}
    draw = lambda k: " ".join(rng.choice((words[k] + " and or the").split()) for _ in range(rng.randrange(2, 7)))
    rows = [(draw(k), k) for k in rng.choices("abc", [6, 3, 1], k=70)]
    train, test = rows[:50], rows[50:]
    frame = lambda r: spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "i int, text string, label string")
    predict = conditions.text_classifier(frame(train), "text", "label")
    got = sorted(predict(frame(test)).collect())
    want, labels = plain(train, test)
    assert np.abs(np.array([r.probability.toArray() for r in got]) - want).max() < 0.01
    assert [r.predicted for r in got] == [labels[k] for k in want.argmax(axis=1)]


def test_a_needed_history_helps_and_a_wrong_one_does_not(spark):
    """The label is in the history alone, so only the right one tells."""
    rng = random.Random(4)
    rows = [(f"t{i // 3}", i, f"word {rng.randrange(5)}", f"history of {k}", k) for i in range(240) for k in [rng.choice(["up", "down"])]]
    df = spark.createDataFrame(rows, "t string, i int, text string, previous string, label string")
    out = conditions.compared(df, "i", "t", "previous", "text", "label").collect()
    share = {c: np.mean([r.predicted == r.label for r in out if r.condition == c]) for c in conditions.CONDITIONS}
    assert share["correct_history"] == 1.0 and max(share["current_only"], share["wrong_history"]) < 0.8
    sides = conditions.with_wrong_history(df.withColumn("is_test", conditions.in_test(df.t)), "i", "previous")
    assert sides.count() == 240
