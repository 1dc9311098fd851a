"""Streams with keyed state, run over the whole tables in several micro-batches."""

from __future__ import annotations

from loomtrace.operators import ingest
from loomtrace.plans.ingest_queries import SECTION as INGEST
from loomtrace.plans.registry import Section
from loomtrace.plans.signals_queries import SECTION as SIGNALS
from loomtrace.sources import drivers
from loomtrace.streaming import stateful

SECTION = Section()


@SECTION.add("l1_streaming_state", SIGNALS["c13_state"].oracle)
def _(spark, sf):
    stream, root = stateful.replayed(spark, drivers.trace_events(spark, sf), "seq", ["trajectory_id"])
    sink = stateful.LatestSink(root, "trajectory_id")
    stateful.run_all(stateful.trajectory_state(stream), sink, root)
    return sink.read(spark).select("trajectory_id", *SIGNALS_STATE)


@SECTION.add("l2_streaming_ingest", INGEST["f1_idempotent_ingest"].oracle)
def _(spark, sf):
    good, _ = ingest.normalize(drivers.raw_payloads(spark, sf))
    stream, root = stateful.replayed(spark, good, "ingest_seq", ["organization_id", "event_id"])
    sink = stateful.LateSink(root)
    stateful.run_all(stateful.idempotent(stream), sink, root)
    return sink.deliveries(spark)


@SECTION.add("l3_streaming_late_events", SIGNALS["c21_late_events"].oracle)
def _(spark, sf):
    events = drivers.org_events(spark, sf).drop("k", "uid")
    stream, root = stateful.replayed(spark, events, "ingest_seq", ["organization_id", "event_id"])
    sink = stateful.LateSink(root)
    stateful.run_all(stateful.idempotent(stream), sink, root)
    return sink.accepted(spark).select("organization_id", "event_id", "late_event", "history_disordered", "recompute_recommended")


SIGNALS_STATE = ["event_count", "human_events", "agent_events", "tool_events", "conversation_count", "agent_count", "agent_handoffs",
                 "duplicate_tool_calls", "cross_agent_duplicate_actions", "tool_switches", "tool_failures", "consecutive_tool_failures",
                 "recovery_count", "unresolved", "recovered", "last_agent_id", "last_tool_name", "repair_count", "refinement_count",
                 "topic_switch_count", "clarification_count", "correction_count", "resistance_count", "disagreement_count", "last_behavior",
                 "behavior_confidence"]
