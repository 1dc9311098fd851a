"""Work states and deltas from routed decisions, as plain aggregations."""

from __future__ import annotations

from dataclasses import dataclass, fields
from hashlib import sha256

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.functions.canonical import digest
from loomtrace.functions.text import unique_ignoring_case
from loomtrace.operators import ordered
from loomtrace.operators.ordered import top_rows

STATE_LISTS = {  # state field -> event column
    "entities": "entities", "artifacts": "artifacts", "open_questions": "unresolved", "decisions": "decisions",
    "attempts": "attempts", "failures": "failures", "outcomes": "outcomes", "surfaces": "surface", "conversation_ids": "conversation_id",
}
# Fields of a normalized state; identifiers, versions and times are left out.
NORMALIZED = ["durable_goal", "current_state", "lifecycle", "entities", "artifacts", "anchors", "open_questions",
              "resolved_questions", "decisions", "attempts", "failures", "outcomes", "surfaces", "conversation_ids",
              "recent_context"]
ORDERED_FIELDS = {"durable_goal", "current_state", "lifecycle", "recent_context"}


def assigned(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events with the trajectory they changed (clarified events change nothing)."""
    d = decisions.filter(F.col("decision").isin("new", "branch", "attach")).select(
        "organization_id", "event_id", "trajectory_id", "parent_id", "decision", "added_anchors")
    lists = {c: F.array(c) for c in ("surface", "conversation_id")}
    return events.withColumns(lists).join(d, ["organization_id", "event_id"])


STATE_KEYS = ["organization_id", "trajectory_id"]
#: Lines of context that a state shows.
CONTEXT = 8


@dataclass(frozen=True)
class StateSummary:
    """What the state of every trajectory follows from, in a form that merges: first and last values with their positions, the first
    position of each listed value, the anchors added by each event, and the last lines of context. Summaries of two parts of a log
    merge into that of the whole, in either order."""

    core: DataFrame
    values: DataFrame
    anchors: DataFrame
    context: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def summarized(rows: DataFrame) -> StateSummary:
    """The summary of assigned events. Distinct values are reduced to their first position before anything is gathered."""
    at = F.col("arrival")
    placed = lambda c: F.struct(at.alias("at"), F.col(c).alias("value"))
    core = rows.groupBy(*STATE_KEYS).agg(
        F.min(placed("workspace_id")).alias("workspace"), F.min(placed("person_id")).alias("person"),
        F.min(F.when(F.col("goal") != "", placed("goal"))).alias("goal"), F.max(F.when(F.col("problem") != "", placed("problem"))).alias("problem"),
        F.min("arrival").alias("created"), F.count("*").alias("version"))
    values = rows.select(*STATE_KEYS, "arrival", F.explode(F.flatten(F.array(*[
        _tagged(name, F.col(column)) for name, column in STATE_LISTS.items()]))).alias("x")).select(
        *STATE_KEYS, "x.field", "x.value", F.struct("arrival", "x.i").alias("pos")).filter("value <> ''")
    values = values.groupBy(*STATE_KEYS, "field", "value").agg(F.min("pos").alias("pos"))
    anchors = rows.filter(F.size("added_anchors") > 0).select(*STATE_KEYS, "arrival", "added_anchors")
    said = rows.filter("problem <> ''").select(*STATE_KEYS, at.cast("double").alias("arrival"), F.col("problem").alias("line"))
    origin = rows.filter("parent_id is not null").select(
        *STATE_KEYS, (at - 0.5).cast("double").alias("arrival"), F.concat(F.lit("branched from "), F.col("parent_id")).alias("line"))
    return StateSummary(core, values, anchors, _last_lines(said.unionByName(origin)))


def _last_lines(lines: DataFrame) -> DataFrame:
    return top_rows(lines, STATE_KEYS, [F.desc("arrival")], CONTEXT).drop("rank")


def merged(old: StateSummary, new: StateSummary) -> StateSummary:
    """The summary of both parts. ``old`` may be a stored snapshot: of the events behind it nothing is read."""
    core = old.core.unionByName(new.core).groupBy(*STATE_KEYS).agg(
        F.min("workspace").alias("workspace"), F.min("person").alias("person"), F.min("goal").alias("goal"), F.max("problem").alias("problem"),
        F.min("created").alias("created"), F.sum("version").cast("bigint").alias("version"))
    values = old.values.unionByName(new.values).groupBy(*STATE_KEYS, "field", "value").agg(F.min("pos").alias("pos"))
    return StateSummary(core, values, old.anchors.unionByName(new.anchors), _last_lines(old.context.unionByName(new.context)))


def states_of(summary: StateSummary) -> DataFrame:
    """The current state of every trajectory of a summary."""
    core = summary.core.select(
        *STATE_KEYS, F.col("workspace.value").alias("workspace_id"), F.col("person.value").alias("person_id"),
        F.col("goal.value").alias("durable_goal"), F.col("problem.value").alias("current_state"), "created", "version")
    listed = summary.values.groupBy(*STATE_KEYS).agg(*[
        F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == name, F.struct("pos", "value")))),
                    lambda s: s["value"]).alias(name) for name in STATE_LISTS])
    added = summary.anchors.groupBy(*STATE_KEYS).agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("arrival", "added_anchors"))), lambda s: s["added_anchors"])).alias("anchors"))
    context = summary.context.groupBy(*STATE_KEYS).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("arrival", "line"))), lambda s: s["line"]).alias("recent_context"))
    empty = F.array().cast("array<string>")
    state = core.join(listed, STATE_KEYS, "left").join(added, STATE_KEYS, "left").join(context, STATE_KEYS, "left")
    return state.withColumns({
        "durable_goal": F.coalesce("durable_goal", F.lit("")), "current_state": F.coalesce("current_state", F.lit("")),
        "lifecycle": F.lit("active"), "resolved_questions": empty,
        "anchors": F.coalesce("anchors", F.array().cast("array<struct<type:string,value:string,strength:string>>")),
        "recent_context": F.coalesce("recent_context", empty),
        **{n: F.coalesce(n, empty) for n in STATE_LISTS},
    })


def work_states(rows: DataFrame) -> DataFrame:
    """Current state of every trajectory from its assigned events; no fold is needed once the assignment is known."""
    return states_of(summarized(rows))


def _tagged(name: str, values: Column) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.lit(name).alias("field"), i.alias("i"), v.alias("value")))


#: Fields of a state in which an event can show. Questions are never marked as resolved by an event.
DELTA_FIELDS = ["lifecycle", "durable_goal", "current_state", *STATE_LISTS, "anchors", "recent_context"]


def structural_deltas(rows: DataFrame, chunk: Column | None = None) -> DataFrame:
    """What each assigned event changed in the state of its trajectory: its ``version``, goal and current state after it, the number of
    distinct values of each list, and the ``changed`` fields. With the first event a field has changed if it is not empty.

    A list changes with a value that it did not have, the context with every line. ``chunk`` cuts a trajectory along ``arrival`` (by
    default every 50,000 positions, so a chunk has a bounded number of rows); what crosses a border travels in one row per chunk.
    """
    cut = (chunk if chunk is not None else F.floor(F.col("arrival") / 50_000)).alias("_cut")
    order, filled = ["arrival", "event_id"], lambda c: F.when(F.col(c) != "", F.col(c))
    values = rows.select(*STATE_KEYS, *order, F.explode(F.flatten(F.array(*[
        _tagged(name, F.col(column)) for name, column in STATE_LISTS.items()]))).alias("x")).filter("x.value <> ''")
    first = values.groupBy(*STATE_KEYS, "x.field", "x.value").agg(F.min(F.struct(*order)).alias("at"))
    new = first.groupBy(*STATE_KEYS, F.col("at.event_id").alias("event_id")).agg(*[F.count_if(F.col("field") == n).alias(f"new_{n}") for n in STATE_LISTS])
    slim = rows.select(*STATE_KEYS, *order, "goal", "problem", (F.size("added_anchors") > 0).alias("_anchors"),
                       ((F.col("problem") != "") | F.col("parent_id").isNotNull()).alias("_line"), cut).join(new, [*STATE_KEYS, "event_id"], "left")
    slim = slim.fillna(0, [f"new_{n}" for n in STATE_LISTS])
    known = ordered.last_before(slim, STATE_KEYS, order, F.col("_cut"), {"state_before": filled("problem")})
    now = ordered.running_totals(known, STATE_KEYS, order, F.col("_cut"), {"version": F.lit(1), **{n: F.col(f"new_{n}") for n in STATE_LISTS}})
    goals = rows.filter("goal <> ''").groupBy(*STATE_KEYS).agg(F.min(F.struct(*order, "goal")).alias("_goal"))
    now = now.join(goals, STATE_KEYS, "left")
    here = F.struct(*order)
    reached = F.struct("_goal.arrival", "_goal.event_id") <= here
    changed = {"lifecycle": F.col("version") == 1, "durable_goal": F.struct("_goal.arrival", "_goal.event_id") == here,
               "current_state": filled("problem").isNotNull() & ~filled("problem").eqNullSafe(F.col("state_before")),
               **{n: F.col(f"new_{n}") > 0 for n in STATE_LISTS}, "anchors": F.col("_anchors"), "recent_context": F.col("_line")}
    fields_ = F.array_compact(F.array(*[F.when(changed[n], F.lit(n)) for n in DELTA_FIELDS]))
    return now.select(*STATE_KEYS, *order, "version", F.when(reached, F.col("_goal.goal")).alias("durable_goal"),
                      F.coalesce(filled("problem"), "state_before").alias("current_state"), *STATE_LISTS,
                      (F.col("surfaces") - F.col("new_surfaces")).alias("surfaces_before"), fields_.alias("changed"))


TAXONOMY_VERSION, PRODUCER_VERSION = "1", "structural-1"
SIGNALS = ("trajectory_created", "state_changed", "durable_goal_changed", "structurally_inert", "failure_count", "attempt_count",
           "unresolved_question_count", "surface_count", "cross_surface_continuation")


def taxonomy_digest() -> str:
    return sha256(f"{TAXONOMY_VERSION}:{','.join(SIGNALS)}".encode()).hexdigest()


def structural_signals(deltas: DataFrame) -> DataFrame:
    """Deterministic L1 signals per delta, in long form, with the taxonomy they follow and the event they rest on."""
    created = F.col("version") == 1
    changed = F.size("changed") > 0
    values = dict(zip(SIGNALS, (
        created, changed, F.array_contains("changed", "durable_goal"), ~changed, F.col("failures"), F.col("attempts"), F.col("open_questions"),
        F.col("surfaces"),
        ~created & (F.col("surfaces_before") > 0) & (F.col("surfaces") > F.col("surfaces_before"))), strict=True))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), v.cast("string").alias("value")) for n, v in values.items()])).alias("s")
    return deltas.select("organization_id", "event_id", "trajectory_id", each).select(
        "organization_id", "event_id", "trajectory_id", "s.signal", "s.value", F.lit("L1").alias("maturity"),
        F.lit(TAXONOMY_VERSION).alias("taxonomy_version"), F.lit(taxonomy_digest()).alias("taxonomy_sha256"),
        F.lit(PRODUCER_VERSION).alias("producer_version"), F.concat(F.lit("event:"), "event_id").alias("evidence"))


def normalized(states: DataFrame) -> DataFrame:
    """Digest of each state without identifiers and with set-like fields sorted."""
    columns = []
    for f in NORMALIZED:
        c = F.col(f)
        columns.append((c if f in ORDERED_FIELDS else F.sort_array(c)).alias(f))
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return states.select(*[c for c in ("organization_id", "trajectory_id") if c in states.columns],
                         digest(body).alias("state_digest"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """States that occur more often on one side; empty when both sets are equivalent."""
    a = normalized(left).groupBy("state_digest").agg(F.count("*").alias("left_count"))
    b = normalized(right).groupBy("state_digest").agg(F.count("*").alias("right_count"))
    return a.join(b, "state_digest", "full").select(
        "state_digest", F.coalesce("left_count", F.lit(0)).alias("left_count"),
        F.coalesce("right_count", F.lit(0)).alias("right_count")).filter("left_count <> right_count")


def field_differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Differing fields of paired states, in long form; a state missing on one side differs in every field it has."""
    shape = lambda d, tag: d.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.to_json(F.struct(
            (F.col(f) if f in ORDERED_FIELDS or f not in NORMALIZED else F.sort_array(f)).alias("v"))).alias("v"))
        for f in fields])).alias("x")).select(*keys, "x.field", F.col("x.v").alias(tag))
    return shape(left, "left_value").join(shape(right, "right_value"), [*keys, "field"], "full").filter(
        ~F.col("left_value").eqNullSafe(F.col("right_value")))


def context_pack(states: DataFrame) -> DataFrame:
    """Portable copy of a state with the last six context lines, and its rendering for a prompt."""
    recent = F.when(F.size("recent_context") > 6, F.expr("slice(recent_context, -6, 6)")).otherwise(F.col("recent_context"))
    packed = states.withColumn("recent_context", recent)
    sections = [("WORK GOAL", "durable_goal"), ("CURRENT STATE", "current_state"), ("LIFECYCLE", "lifecycle"),
                ("IMPORTANT ENTITIES", "entities"), ("RELEVANT ARTIFACTS", "artifacts"), ("OPEN / UNRESOLVED", "open_questions"),
                ("DECISIONS", "decisions"), ("ALREADY TRIED", "attempts"), ("FAILURES", "failures"), ("OUTCOMES", "outcomes"),
                ("RECENT EVOLUTION", "recent_context")]
    parts = []
    for title, name in sections:
        if name in ("durable_goal", "current_state", "lifecycle"):
            parts.append(F.when(F.col(name) != "", F.concat(F.lit(title + "\n"), F.col(name))))
        else:
            lines = F.array_join(F.transform(name, lambda v: F.concat(F.lit("- "), v)), "\n")
            parts.append(F.when(F.size(name) > 0, F.concat(F.lit(title + "\n"), lines)))
    return packed.withColumn("prompt", F.concat_ws("\n\n", *parts))


def judge_view(states: DataFrame) -> DataFrame:
    """State as shown to a judge: lists unique ignoring case, the last six context lines."""
    lists = {n: unique_ignoring_case(F.col(n)) for n in ("entities", "artifacts", "open_questions", "recent_context")}
    return context_pack(states).drop("prompt").withColumns(lists)


def product_outcomes(states: DataFrame, product_events: DataFrame) -> DataFrame:
    """Apply trusted outcomes to known trajectories: unique outcomes appended in order, validation resolves the work."""
    keys = ["organization_id", "trajectory_id"]
    outcome = F.when(F.trim("description") != "", F.trim("description")).otherwise(
        F.concat_ws("=", "event_name", "status"))
    firsts = product_events.select(*keys, "at", outcome.alias("outcome"), (
        (F.col("event_name") == "deployment_validation") & (F.col("status") == "success")).alias("validated"))
    merged = firsts.groupBy(*keys, "outcome").agg(F.min("at").alias("at"), F.max("validated").alias("validated")).groupBy(
        *keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "outcome"))), lambda s: s["outcome"]).alias("_new"),
                   F.max("validated").alias("_done"))
    done = F.coalesce("_done", F.lit(False))
    note = F.lit("deployment validated successfully")
    fresh = F.filter(F.coalesce("_new", F.array().cast("array<string>")), lambda v: ~F.array_contains(F.col("outcomes"), v))
    return states.join(merged, keys, "left").withColumns({
        "outcomes": F.concat("outcomes", fresh),
        "lifecycle": F.when(done, "resolved").otherwise(F.col("lifecycle")),
        "current_state": F.when(done, note).otherwise(F.col("current_state")),
        "recent_context": F.when(done & ~F.array_contains("recent_context", note), F.concat(
            "recent_context", F.array(note))).otherwise(F.col("recent_context")),
    }).drop("_new", "_done")
