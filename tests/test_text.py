import pytest
from pyspark.sql import functions as F

from loomtrace.functions import anchors, language, text
from loomtrace.functions.canonical import json_digest

TEXTS = [
    ("Fix OPS-12 and ops-13 in PR #45", [("pr", "45"), ("ticket", "OPS-12")]),
    ("INC-77 trace 123E4567-e89b-12d3-a456-426614174000", [("incident", "77"), ("trace_id", "123e4567-e89b-12d3-a456-426614174000")]),
    ("see src/App.py then SRC/app.py", [("file", "SRC/app.py")]),
    ("customer cannot log in", [("customer", "cannot")]),
    ("tenant: North account_9 repo=svc.a project atlas", [("account", "9"), ("project", "atlas"), ("repo", "svc.a"), ("tenant", "north")]),
    ("set DB_HOST, INC_99 at https://x.y/z?q=1|2 commit deadbeef1", [
        ("env_var", "DB_HOST"), ("env_var", "INC_99"), ("git_sha", "deadbeef1"), ("incident", "99"), ("url", "https://x.y/z?q=1|2")]),
    ("", []),
    ("pull request 5 1234567", [("git_sha", "1234567"), ("pr", "5")]),
    ("éOPS-1 ÉINC-5 customer é", []),
]


def test_anchor_extraction(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "i INT, t STRING")
    got = {r["i"]: [(a["type"], a["value"]) for a in r["a"]] for r in df.select("i", anchors.anchors_of(F.col("t")).alias("a")).collect()}
    for i, (t, want) in enumerate(TEXTS):
        assert got[i] == want, t


def test_anchor_comparison(spark):
    pairs = [("OPS-1 customer acme", "OPS-1 customer other"), ("OPS-1", "OPS-1 tenant x"), ("repo a https://x.y/a|b", "repo a https://x.y/a|b"), ("", "OPS-1")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i INT, a STRING, b STRING").select(
        "i", anchors.anchors_of(F.col("a")).alias("x"), anchors.anchors_of(F.col("b")).alias("y"))
    r = {x["i"]: x for x in anchors.compare_anchors(df, "x", "y").collect()}
    assert (r[0]["hard_new"], r[0]["strong_attach"], r[0]["anchor_relevant"]) == (True, False, True)
    assert (r[1]["hard_new"], r[1]["strong_attach"]) == (False, True)
    assert r[2]["scope_matches"] == ["repo:a"] and r[2]["medium_matches"] == ["url:https://x.y/a|b"] and not r[2]["anchor_relevant"]
    assert r[3]["anchor_rules"] == []


@pytest.mark.parametrize("raw, want, cats", [
    ("mail a.b@c.org now", "mail [REDACTED_EMAIL] now", ["email"]),
    ("call (555) 123-4567 or 10.0.0.1", "call [REDACTED_PHONE] or [REDACTED_IP]", ["ip", "phone"]),
    ("é5551234567", "é5551234567", []),
    (None, "", []),
])
def test_redaction(spark, raw, want, cats):
    r = text.redact(F.col("t"))
    got = spark.createDataFrame([(raw,)], "t STRING").select(r["text"].alias("t"), r["categories"].alias("c"), r["redacted"].alias("f")).collect()[0]
    assert (got["t"], got["c"], got["f"]) == (want, cats, bool(cats))


def test_fixed3_is_exact(spark):
    values = [round(i / 10000, 4) for i in range(10001)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v DOUBLE").select(text.fixed3(F.col("v"))).collect()]
    assert got == [f"{v:.3f}" for v in values]


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": {"d": null, "c": 2}}', '{"a":{"c":2,"d":null},"b":1}')], "x STRING, y STRING")
    r = df.select(json_digest(F.col("x")).alias("x"), json_digest(F.col("y")).alias("y")).collect()[0]
    assert r["x"] == r["y"]


def test_goals_and_language(spark):
    df = spark.createDataFrame([("Deploy fails: please fix the failing container tests tests",)], "t STRING")
    g, l = text.router_goal(F.col("t")), text.local_goal(F.col("t"))
    r = df.select(g["intent"].alias("i"), g["entities"].alias("e"), l["domain"].alias("d"), l["intent"].alias("li"),
                  text.work_goal(F.col("t"), F.lit(" ")).alias("w")).collect()[0]
    assert r["i"] == "debug" and r["d"] == "software deployment" and r["li"] == "debug"
    assert r["e"] == ["deploy", "fails", "please", "failing", "container", "tests"]
    assert r["w"] == "Deploy fails please fix the failing container tests tests"
    e = spark.createDataFrame([("Customer acme in repo: web PR 5", "customer ACME repo api PR 6 is still failing")], "a STRING, b STRING")
    m = language.identity_matches(F.col("a"), F.col("b"))
    r = e.select(m["positive"].alias("p"), m["contradictions"].alias("c"), language.continuation_signals(F.col("b")).alias("s")).collect()[0]
    assert r["p"] == ["same customer: acme"] and r["c"] == ["different repository: web vs api", "different PR: 5 vs 6"]
    assert r["s"] == [r"\bstill\b"]


def test_jaccard_of_blank_sides(spark):
    df = spark.createDataFrame([("", "a"), (" ", " "), ("A b", "b  c")], "a STRING, b STRING")
    assert [r[0] for r in df.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1 / 3]
