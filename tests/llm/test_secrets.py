import hashlib
import random
import re

from fixtures import ODD

from loomtrace.llm import secrets
from loomtrace.llm.secrets import KINDS, VERSION


def plain(text):
    spans = []
    for i, k in enumerate(KINDS):
        for m in re.finditer(k.pattern, text or "", re.ASCII):
            if len(m[k.group]) >= k.least:
                spans.append((m.start(), i, m.end()))
    return sorted(spans)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    parts = ["token=token: abcdefgh", "PassWord : 'hunter2222'", "api_key=\"a+b/c=d.e\"", "secret=abc", "AKIA" + "Z9" * 9, "AKIAAKIA12", "deadbeef" * 4, "0" * 23,
             "é\U0001f600", "ghp_" + "a1" * 20, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc", "passwd=" + "ab" * 20, " ", "\n", "word", ", "]
    return [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(9)))) for i in range(n)]


def shown(spans):
    return ",".join(f"{KINDS[k].name}:{s}:{e}" for s, k, e in spans)


def test_equals_plain_scan(spark):
    rows = texts() + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, "a1" * 40 + " token=secret99"), (2000, "a1" * 40 + " token=secret99")]
    out = secrets.findings(spark.createDataFrame([(*r, "b") for r in rows], "doc_id bigint, text string, blob string"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in out.collect())
    want = []
    for i, t in rows:
        s = plain(t)
        want.append((i, *(sum(k == x for _, k, _ in s) for x in range(3)), hashlib.sha256(shown([x for x in s if x[1] < 3]).encode()).hexdigest(), shown(s)))
    assert got == sorted(want)


def test_ledger_is_incremental(spark):
    first = spark.createDataFrame(texts(2, 20), "doc_id bigint, text string")
    ledger = secrets.scanned(secrets.unseen(first, None, VERSION)).cache()
    both = first.union(spark.createDataFrame(texts(3, 20), "doc_id bigint, text string"))
    new = secrets.unseen(both, ledger, VERSION)
    assert new.count() == both.select("text").distinct().count() - first.select("text").distinct().count()
    assert secrets.unseen(first, ledger, VERSION).count() == 0 and secrets.unseen(first, ledger, "next").count() == ledger.count()
    assert sorted(secrets.findings(both, ledger).collect()) == sorted(secrets.findings(both).collect())
    assert secrets.findings(first.limit(0)).collect() == []
