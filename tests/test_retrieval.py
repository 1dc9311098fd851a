import random

import pytest

from loomtrace.operators import retrieval

EVENT = "organization_id string, workspace_id string, person_id string, event_id string, anchors array<struct<type:string,value:string,strength:string>>"


def drawn(rng, most):
    strong = [("ticket", f"T{rng.randrange(5)}", "strong") for _ in range(rng.randrange(most + 1))] + [("ticket", "hot", "strong")] * rng.randrange(2)
    boundary = [(rng.choice(["customer", "tenant"]), f"b{rng.randrange(3)}", "boundary") for _ in range(rng.random() < 0.2)]
    return strong + boundary + [("file", "x.py", "weak")]


@pytest.mark.parametrize("most_keys", [1, 2, 6])
def test_counts_equal_listed_pairs(spark, monkeypatch, most_keys):
    monkeypatch.setattr(retrieval, "MOST_KEYS", most_keys)
    rng = random.Random(most_keys)
    who = lambda: ("o", f"w{rng.randrange(2)}", f"p{rng.randrange(4)}")
    events = spark.createDataFrame([(*who(), f"e{i}", drawn(rng, 4)) for i in range(60)], EVENT)
    trajectories = spark.createDataFrame([(*who(), f"t{i}", drawn(rng, 4)) for i in range(70)], EVENT.replace("event_id", "trajectory_id"))
    listed = {r.event_id: r["count"] for r in retrieval.rescue_candidates(events, trajectories).groupBy("event_id").count().collect()}
    got = {r.event_id: r.rescue_candidates for r in retrieval.rescue_counts(events, trajectories).collect()}
    assert len(got) == 60 and {e: n for e, n in got.items() if n} == listed and len(listed) > 30
