import random
import re

from fixtures import ODD

from loomtrace.llm import licenses
from loomtrace.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    t = low(text)
    words = WORD.findall(t)
    places = sorted((i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
    best, labels = 0.0, {label for _, label in places}
    base = ",".join(sorted(labels))
    for block in [*t.split("\n"), *re.split(r"\n[\x20\x09-\x0D]*\n", t)]:
        have = set(WORD.findall(block))
        for label, notice in TEMPLATES:
            want = set(WORD.findall(notice))
            if 100 * len(want & have) >= CONTAINMENT * len(want):
                labels.add(label)
                best = max(best, len(want & have) / len(want))
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, base, ",".join(sorted(labels)), 1.0 if places else best)


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    notices = [n for _, n in TEMPLATES]
    rows = []
    for i in range(150):
        words = [rng.choice(["the", "a", "license", "cc", "by", "all", "rights", "reserved", "General", "Public", "é", "x9"]) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(notices).split()
            for _ in range(rng.randrange(len(w) // 3 + 1)):
                w.pop(rng.randrange(len(w)))
            rng.shuffle(w) if rng.random() < 0.2 else None
            at = rng.randrange(len(words) + 1)
            words[at:at] = w
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n", ", ", "\n \n"]) for w in words)))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, "l") for r in rows], "doc_id bigint, text string, labels string")
    got = {r[0]: tuple(r)[1:] for r in licenses.scan(df).collect()}
    assert got == {i: plain(t) for i, t in rows}


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
