import random

import pytest

from loomtrace.operators.evaluate import order_statistics
from loomtrace.operators.signals import history_of


def stats(spark, values, error=1e-4):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    return tuple(order_statistics(df, "v", error=error).first())


@pytest.mark.parametrize("error", [1e-4, 0.05])
def test_median_is_exact(spark, error):
    rng = random.Random(1)
    for values in ([5.0], [1.0, 2.0], [rng.gauss(0, 100) for _ in range(997)], [rng.choice([1.0, 1.0, 7.0, 1e6]) for _ in range(500)],
                   [0.0] * 400 + [rng.random() for _ in range(30)], [1e-9 * k for k in range(301)] + [1e9]):
        n = sorted(values)
        assert stats(spark, [*values, None, float("nan")], error) == (round(n[0], 6), round(n[len(n) // 2], 6), round(n[-1], 6), len(n))


def test_no_values(spark):
    assert stats(spark, [None]) == (None, None, None, 0)


def test_history_by_pieces_equals_a_plain_comparison(spark):
    rng = random.Random(2)
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    events = [(f"t{rng.randrange(3)}", f"e{i}", start + timedelta(hours=rng.randrange(200)), f"c{rng.randrange(4)}") for i in range(150)]
    targets = [(e[0], e[1], e[3], e[2]) for e in events[::7]] + [("t9", "none", "c", start)]
    e = spark.createDataFrame(events, "trajectory_id string, event_id string, ts timestamp_ntz, conversation_id string")
    t = spark.createDataFrame(targets, "trajectory_id string, target_id string, target_conversation string, target_ts timestamp_ntz")
    got = {(r.trajectory_id, r.target_id, r.event_id, r.local) for r in history_of(e, t).collect()}
    assert got == {(x[0], x[1], y[1], y[3] == x[2]) for x in targets for y in events if x[0] == y[0] and y[2] < x[3]}
