"""Ordered signals against hand-made rows and a plain fold over random traces."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import rollups, signals
from loomtrace.schemas import TRACE_EVENT

START = datetime(2024, 1, 1)


def row(tid, seq, actor, actor_id=None, tool=None, status=None, text="", meta="{}", conv="c", thread="t", goal="g", minutes=None):
    return (tid, "u", f"{tid}-{seq}", seq, START + timedelta(minutes=seq if minutes is None else minutes), conv, thread, goal,
            actor, actor_id, text, tool, status, meta)


def frame(spark, rows):
    return spark.createDataFrame(rows, TRACE_EVENT)


def states(df, chunk=None):
    return {r["trajectory_id"]: r.asDict() for r in signals.state(df, chunk).collect()}


def fold(rows):
    """The counters by a plain loop."""
    s = dict(event_count=0, human_events=0, agent_events=0, tool_events=0, agent_handoffs=0, duplicate_tool_calls=0,
             cross_agent_duplicate_actions=0, tool_switches=0, tool_failures=0, consecutive_tool_failures=0, recovery_count=0,
             unresolved=False, recovered=False, last_agent_id=None, last_tool_name=None)
    agent = last = None
    convs, agents = set(), set()
    for r in sorted(rows, key=lambda r: (r[4], r[3])):
        actor, actor_id, tool, status, meta = r[8], r[9], r[11], r[12], json.loads(r[13])
        s["event_count"] += 1
        if r[5]:
            convs.add(r[5])
        if actor in ("human", "agent", "tool"):
            s[f"{actor}_events"] += 1
        if actor == "agent":
            agent = (actor_id,)
            if actor_id:
                s["agent_handoffs"] += s["last_agent_id"] not in (None, actor_id)
                agents.add(actor_id)
                s["last_agent_id"] = actor_id
        if actor == "tool":
            if last:
                if last[0] == tool and last[1] == meta:
                    s["duplicate_tool_calls"] += 1
                    s["cross_agent_duplicate_actions"] += bool(last[2] and agent and last[2] != agent)
                s["tool_switches"] += bool(last[0] and tool and last[0] != tool)
            if status == "failed":
                s["tool_failures"] += 1
                s["consecutive_tool_failures"] += 1
                s["unresolved"], s["recovered"] = True, False
            elif status == "success":
                if s["unresolved"]:
                    s["recovery_count"] += 1
                    s["recovered"] = True
                s["consecutive_tool_failures"], s["unresolved"] = 0, False
            last = (tool, meta, agent)
            s["last_tool_name"] = tool
    return s | {"conversation_count": len(convs), "agent_count": len(agents)}


def random_rows(seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        actor = rng.choice(["human", "agent", "tool", "tool", "tool", "other"])
        out.append(row(
            "t", i, actor, actor_id=rng.choice(["a", "b", "", None]) if actor == "agent" else None,
            tool=rng.choice(["x", "y", None, ""]) if actor == "tool" else None, conv=rng.choice(["c1", "c2", "", None]),
            status=rng.choice(["failed", "success", None, "other"]) if actor == "tool" else None,
            meta=rng.choice(['{"v": 1}', '{"v": 1.0}', "{}", '{"a": 1, "b": [1]}', '{"b": [1], "a": 1}']), minutes=i // 2))
    return out


def test_small_trace(spark):
    s = states(frame(spark, [row("t", 0, "human", text="hi"), row("t", 1, "agent", "a"), row("t", 2, "tool", tool="x", status="failed")]))["t"]
    assert (s["event_count"], s["tool_failures"], s["unresolved"], s["recovered"]) == (3, 1, True, False)


def test_cross_agent_duplicate_counts_null_agents(spark):
    rows = [row("t", 0, "agent", None), row("t", 1, "tool", tool="x"), row("t", 2, "agent", "b"), row("t", 3, "tool", tool="x")]
    s = states(frame(spark, rows))["t"]
    assert (s["duplicate_tool_calls"], s["cross_agent_duplicate_actions"], s["agent_handoffs"]) == (1, 1, 0)


@pytest.mark.parametrize("minutes", [1, 5, 1000])
def test_state_equals_fold_for_any_chunk(spark, minutes):
    chunk = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (60 * minutes))
    rows = [(f"t{seed}", *r[1:]) for seed in range(8) for r in random_rows(seed)]
    got = states(frame(spark, rows).repartition(7), chunk)
    for seed in range(8):
        want = fold([r for r in rows if r[0] == f"t{seed}"])
        assert {k: got[f"t{seed}"][k] for k in want} == want


def test_behaviour_counts_any_actor(spark):
    meta = '{"behavior": {"primitive": "repair", "confidence": 0.5}}'
    df = frame(spark, [row("t", 0, "human", meta=meta), row("t", 1, "agent", "a", meta=meta), row("t", 2, "human", meta='{"behavior": {}}')])
    s = states(df)["t"]
    assert (s["repair_count"], s["last_behavior"], s["behavior_confidence"]) == (2, "repair", 0.5)
    assert rollups.repairs(df).count() == 1


def test_duplicate_window(spark):
    tools = ["search", "fetch", "search", "search"]
    df = frame(spark, [row("t", i, "tool", tool=t) for i, t in enumerate(tools)])
    flags = lambda w: [r["duplicate"] for r in signals.duplicate_calls(df, w, F.col("seq")).orderBy("seq").collect()]
    assert flags(1) == [False, False, False, True]
    assert flags(2) == [False, False, True, True]


def test_agents_without_tools_appear(spark):
    df = frame(spark, [row("t", 0, "agent", "a"), row("t", 1, "agent", "b"), row("t", 2, "tool", tool="x", status="failed")])
    got = {r["agent_id"]: (r["events"], r["tool_failures_after"]) for r in signals.agents(df).collect()}
    assert got == {"a": (1, 0), "b": (1, 1)}


def test_thread_state_priority(spark):
    df = frame(spark, [row("t", 0, "human", text="a b", conv="c1"), row("t", 1, "human", text="a c", conv="c2"),
                       row("t", 2, "tool", tool="x", status="failed")])
    empty = spark.createDataFrame([], "trajectory_id STRING, thread_id STRING, continuity DOUBLE, evolution DOUBLE")
    r = rollups.analysis(df, empty).collect()[0]
    assert r["state"] == "stalled"
    assert r["evidence"] == ["revisited across 3 conversations", "1 failed tool action(s)", "continuity=0.000, evolution=0.000"]


def test_no_task_sees_a_whole_hot_trajectory(spark):
    plan = signals.state(frame(spark, random_rows(1)))._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan


def test_a_busy_day_is_cut_into_pieces(spark):
    """Rows of one day, many of one time, in pieces of a few rows: the same counters as without."""
    rng = random.Random(11)
    rows = [(f"t{s}", *r[1:4], START + timedelta(minutes=rng.choice([5, 5, 5, *range(30)])), *r[5:]) for s in range(3) for r in random_rows(s)]
    df = frame(spark, rows)
    pieces = signals.in_pieces(df, most=4)
    sizes = [r["count"] for r in pieces.groupBy("trajectory_id", "piece").count().collect()]
    assert max(sizes) <= 12 and len(sizes) > 20
    chunk = F.col("piece")
    assert {r["trajectory_id"]: r.asDict() for r in signals.state(pieces, chunk).collect()} == states(df)
    for operator in (signals.resolutions, signals.agents, signals.previous_text):
        assert sorted(map(str, operator(pieces, chunk).collect())) == sorted(map(str, operator(df).collect()))
