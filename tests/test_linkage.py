"""Pair rules and set gates against a plain implementation of the rules on random cases."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import audit, gates, linkage

PAIR = ("case_id INT, candidate_id STRING, candidate_text STRING, incoming_text STRING, incoming_goal STRING, candidate_goal STRING, "
        "candidate_state STRING, incoming_entities ARRAY<STRING>, incoming_artifacts ARRAY<STRING>, candidate_entities ARRAY<STRING>, "
        "candidate_artifacts ARRAY<STRING>, lifecycle STRING, score DOUBLE, created BIGINT, other_person BOOLEAN")


def pair(case=0, cand="c", old="old", new="new", score=0.5, life="active", goals=("", ""), ents=((), ()), arts=((), ()), created=0, other=False):
    return (case, cand, old, new, goals[1], goals[0], old, list(ents[1]), list(arts[1]), list(ents[0]), list(arts[0]), life, score, created, other)


@pytest.mark.parametrize("kw, want", [
    (dict(old="customer a OPS-1", new="customer b OPS-1"), ("new", 0.99)),
    (dict(old="OPS-1", new="OPS-1"), ("attach", 0.99)),
    (dict(ents=(("A",), ("b",))), ("new", 0.99)),
    (dict(arts=(("A",), ("b",))), ("new", 0.99)),
    (dict(new="this revealed more"), ("branch", 0.90)),
    (dict(goals=("Ship it", " ship IT ")), ("attach", 0.95)),
    (dict(goals=("Ship it", "ship it"), life="resolved"), ("uncertain", 0.50)),
    (dict(ents=(("A",), ("a ", "b"))), ("uncertain", 0.55)),
    (dict(new="still broken"), ("attach", 0.90)),
    (dict(new="still broken", life="resolved"), ("uncertain", 0.50)),
    (dict(score=0.72), ("uncertain", 0.65)),
    (dict(score=0.19), ("uncertain", 0.45)),
    (dict(score=0.19, life="archived"), ("new", 0.80)),
    (dict(score=0.20), ("uncertain", 0.40)),
])
def test_structured_rules(spark, kw, want):
    df = linkage.structured(linkage.with_anchors(spark.createDataFrame([pair(**kw)], PAIR)))
    r = df.select("linker_decision", "linker_confidence").collect()[0]
    assert tuple(r) == want


@pytest.mark.parametrize("old, new, score, unresolved, want", [
    ("customer a", "customer b still", 0.9, True, ("new", 0.99)), ("x", "because of this", 0.9, True, ("branch", 0.90)),
    ("x", "again", 0.1, True, ("attach", 0.90)), ("x", "again", 0.1, False, ("uncertain", 0.55)), ("x", "y", 0.72, False, ("attach", 0.80)),
    ("x", "y", 0.40, False, ("uncertain", 0.50)), ("x", "y", 0.19, False, ("new", 0.80)), ("x", "y", 0.2, False, ("uncertain", 0.40)),
])
def test_hybrid_rules(spark, old, new, score, unresolved, want):
    df = spark.createDataFrame([(old, new, score, unresolved)], "candidate_text STRING, incoming_text STRING, score DOUBLE, unresolved BOOLEAN")
    assert tuple(linkage.hybrid(df).select("decision", "confidence").collect()[0]) == want


def plain_route(rows, reopen):
    """Set, gate, reopen and no-match rules over (id, decision, confidence, score, strong, lifecycle), creation order."""
    ranked = sorted(rows, key=lambda r: -r[3])
    top, second = ranked[0][3], ranked[1][3] if len(ranked) > 1 else None
    kinds = [r[1] for r in rows]
    action, chosen = "uncertain", None
    if "attach" in kinds or "branch" in kinds:
        by = lambda rs: sorted(rs, key=lambda r: (r[2], r[3]), reverse=True)[0]
        strong = [r for r in ranked if r[1] == "attach" and r[4]]
        for kind, rs in (("attach", strong), ("branch", [r for r in ranked if r[1] == "branch"]), ("attach", [r for r in ranked if r[1] == "attach"])):
            if rs:
                best = by(rs)
                if rs is strong or not best[3] < top - 0.15:
                    action, chosen = kind, best[0]
                break
        if action == "uncertain":
            chosen = ranked[0][0]
    elif all(k == "new" for k in kinds):
        action = "new"
    else:
        open_ = [r[0] for r in rows if r[1] == "uncertain"]
        chosen = open_[0] if len(open_) == 1 else None
    if action == "uncertain" and ranked[0][5] == "resolved" and reopen and top >= 0.25 and (top if second is None else top - second) >= 0.15:
        return "attach", ranked[0][0]
    if action == "uncertain":
        plausible = [r for r in ranked if r[3] >= 0.12]
        if top < 0.12 or (plausible and all(r[1] == "new" for r in plausible)):
            return "new", None
    return action, chosen


def test_set_gates_equal_plain_rules(spark):
    rng = random.Random(5)
    cases, rows = {}, []
    for c in range(300):
        reopen = rng.random() < 0.4
        mine = []
        for i in range(rng.randint(1, 5)):
            d, f, strong = rng.choice([("attach", 0.99, True), ("attach", 0.90, False), ("branch", 0.90, False), ("new", 0.99, False),
                                       ("new", 0.80, False), ("uncertain", 0.5, False), ("uncertain", 0.4, False)])
            mine.append((f"c{i}", d, f, rng.choice([0.05, 0.11, 0.12, 0.3, 0.3, 0.5, 0.9]), strong, rng.choice(["active", "resolved"])))
        cases[c] = plain_route(mine, reopen)
        rows += [(c, r[0], r[1], r[2], r[3], r[4], r[5], i, "it is back" if reopen else "hello") for i, r in enumerate(mine)]
    df = spark.createDataFrame(rows, "case_id INT, candidate_id STRING, linker_decision STRING, linker_confidence DOUBLE, score DOUBLE, "
                                     "strong_identity BOOLEAN, lifecycle STRING, created BIGINT, incoming_text STRING")
    texts = df.groupBy("case_id").agg(F.max("incoming_text").alias("incoming_text"))
    out = gates.route_cases(df.drop("incoming_text"), ["case_id"], texts, runtime=False)
    got = {r["case_id"]: (r["decision"], r["chosen"]) for r in out.select("case_id", "decision", "chosen").collect()}
    assert got == cases


def test_consensus_and_recovery(spark):
    o = lambda a, c, f: (a, c, f)
    rows = [(0, o("new", None, 0.9), o("new", None, 0.8)), (1, o("attach", "t", 0.9), o("attach", "u", 0.9)), (2, o("attach", "t", 0.9), None),
            (3, o("abstain", None, 0.9), o("abstain", None, 0.9)), (4, o("attach", "t", 0.79), o("attach", "t", 0.9)), (5, o("attach", "t", 0.9), o("attach", "t", 0.9))]
    s = "STRUCT<action: STRING, candidate_id: STRING, confidence: DOUBLE>"
    p = spark.createDataFrame(rows, f"case_id INT, primary {s}, verifier {s}").withColumn("want", F.lit("t"))
    reasons = lambda df: [r["reason"] for r in df.orderBy("case_id").collect()]
    assert reasons(gates.consensus(p)) == ["high_confidence_provider_agreement", "provider_disagreement", "providers_abstain",
                                           "agreement_low_confidence", "high_confidence_provider_agreement"]
    assert reasons(gates.consensus_new(p))[:3] == ["independent_provider_consensus", "primary_not_confident_new", "primary_not_confident_new"]
    assert reasons(gates.attach_recovery(p, "want")) == [
        "primary_did_not_attach_candidate", "provider_disagreement", "verifier_required", "primary_abstained", "primary_low_confidence",
        "independent_provider_consensus"]


def test_assessment_errors(spark):
    rows = [("new", None, 0.5, "L2"), ("new", "t", 0.5, "L2"), ("attach", None, 0.5, "L2"), ("merge", None, 0.5, "L2"), ("new", None, 1.5, "L2"), ("new", None, 0.5, "L1")]
    df = spark.createDataFrame(rows, "a STRING, c STRING, f DOUBLE, m STRING")
    got = [r[0] for r in df.select(audit.assessment_error(*[F.col(x) for x in "acfm"])).collect()]
    assert got == [None, "candidate must be null", "candidate required", "invalid frontier action", "confidence must be 0..1",
                   "frontier assessment must remain L2"]


def test_event_tokens(spark):
    df = spark.createDataFrame([("Look (OPS-12)! x-y, A-1. b-2;",)], "t STRING")
    assert df.select(gates.event_anchor_tokens(F.col("t"))).collect()[0][0] == ["a-1", "b-2", "ops-12"]
