"""Signals, assessments, corrections, proposals and audit samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.functions.canonical import struct_digest

# Model signals that may be observed.
MODEL_SIGNALS = ["resistance", "frustration", "goal_shift", "progress", "regression", "repair", "refinement",
                 "disagreement", "context_loss"]
# Accepted correction actions.
CORRECTIONS = ["confirm", "attach", "new", "branch", "split", "merge"]


def policy_eligible(maturity: Column) -> Column:
    return maturity.isin("L0", "L1", "L3")


def weakest_maturity(maturity: Column) -> Column:
    """Aggregate: the weakest maturity, in the order L2, L1, L0, L3."""
    rank = F.when(maturity == "L2", 0).when(maturity == "L1", 1).when(maturity == "L0", 2).when(maturity == "L3", 3)
    return F.min_by(maturity, rank)


def model_signals(answers: DataFrame, column: str) -> DataFrame:
    """Explode a model's signal list: allowed names with values in 0..1, always of maturity L2."""
    schema = "signals ARRAY<STRUCT<name: STRING, value: DOUBLE, confidence: DOUBLE, evidence: ARRAY<STRING>>>"
    rows = answers.withColumn("_s", F.explode(F.from_json(column, schema)["signals"]))
    value = F.coalesce("_s.value", F.lit(0.0))
    return rows.filter(F.col("_s.name").isin(*MODEL_SIGNALS) & value.between(0, 1)).select(
        *[c for c in answers.columns if c != column], F.col("_s.name").alias("signal"), value.alias("value"),
        F.lit("L2").alias("maturity"), F.col("_s.confidence").alias("confidence"), F.col("_s.evidence").alias("evidence"))


def assessment_error(action: Column, candidate: Column, confidence: Column, maturity: Column) -> Column:
    """Reason why a frontier assessment is invalid, null when it is valid."""
    missing = candidate.isNull() | (candidate == "")
    return (
        F.when(~F.coalesce(action.isin("new", "attach", "branch", "abstain"), F.lit(False)), "invalid frontier action")
        .when(action.isin("attach", "branch") & missing, "candidate required")
        .when(action.isin("new", "abstain") & candidate.isNotNull(), "candidate must be null")
        .when(F.coalesce(maturity, F.lit("")) != "L2", "frontier assessment must remain L2")
        .when(~F.coalesce(confidence.between(0, 1), F.lit(False)), "confidence must be 0..1")
    )


def candidate_assessment_error(maturity: Column, *values: Column) -> Column:
    good = F.lit(True)
    for v in values:
        good = good & F.coalesce(v.between(0, 1), F.lit(False))
    return F.when(F.coalesce(maturity, F.lit("")) != "L2", "CandidateAssessment must remain L2").when(
        ~good, "assessment values must be 0..1")


def corrections(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structured correction records, and the requests with an unsupported action."""
    ok = F.coalesce(F.col("action").isin(*CORRECTIONS), F.lit(False))
    record = F.struct(F.coalesce("source", F.lit("user")).alias("source"), F.col("action").alias("decision"),
                      "trajectory_id", "reason_code")
    good = requests.filter(ok).select(
        "organization_id", "event_id", F.coalesce("decision_id", "decision_record_id").alias("decision_id"),
        record.alias("correction"), "diagnosis", "created_at")
    return good, requests.filter(~ok).withColumn("reject_reason", F.lit("unsupported correction"))


def audit_sample(rows: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` rows by textual event id, with audit ids and hidden gold. Chosen before any label is seen."""
    from loomtrace.operators.ordered import top_rows
    sample = rows.withColumn("_key", F.col("event_id").cast("string")).orderBy("_key").limit(n)
    numbered = top_rows(sample.withColumn("_all", F.lit(1)), ["_all"], [F.col("_key")], n, "_n")  # n rows only
    return numbered.select(
        F.concat(F.lit("audit_"), F.lpad(F.col("_n").cast("string"), 3, "0")).alias("audit_id"), "event_id",
        F.col("pred").alias("predicted"), F.col("gold").alias("gold_hidden"), "source",
        F.lit(None).cast("boolean").alias("human_correct"), F.lit(None).cast("boolean").alias("human_false_merge"))


def sample_digest(sample: DataFrame) -> DataFrame:
    """One digest of an audit sample (bounded by its size) from the digests of its rows in order."""
    row = struct_digest(*[c for c in sample.columns if not c.startswith("human_")])
    return sample.select("audit_id", row.alias("d")).groupBy().agg(
        F.count("*").alias("sample_size"),
        F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("audit_id", "d"))), lambda x: x["d"]), ""), 256)
        .alias("sample_sha256"))


def score_audit(rows: DataFrame) -> DataFrame:
    """INCOMPLETE while a human judgement is missing, else the rates and the acceptance gate."""
    agg = rows.agg(
        F.count("*").alias("sample_size"),
        F.count_if(F.col("human_correct").isNull() | F.col("human_false_merge").isNull()).alias("open"),
        F.count_if("human_correct").alias("correct"), F.count_if("human_false_merge").alias("false_merges"))
    rate = F.when(F.col("sample_size") > 0, F.col("correct") / F.col("sample_size")).otherwise(0.0)
    done = F.col("open") == 0
    return agg.select(
        F.when(done, "COMPLETE").otherwise("INCOMPLETE").alias("status"), "sample_size", "correct",
        F.round(rate, 6).alias("correct_rate"), "false_merges",
        (done & (rate >= 0.70) & (F.col("false_merges") == 0)).alias("milestone_pass"))


def milestone_gate(rate: Column, false_merges: Column, human_rate: Column, human_false_merges: Column) -> dict[str, Column]:
    machine = (rate >= 0.70) & (false_merges == 0)
    human = F.coalesce((human_rate >= 0.70) & (human_false_merges == 0), F.lit(False))
    return {"machine_gate": machine, "human_gate": human, "milestone_pass": machine & human}


def proposals(decisions: DataFrame, versions: DataFrame) -> DataFrame:
    """Pending proposals of a clarify-only organisation, with the version of the proposed trajectory at that time."""
    base = decisions.join(versions, ["organization_id", "trajectory_id"], "left")
    return base.select(
        "organization_id", "event_id", F.col("decision").alias("proposed_decision"),
        F.col("trajectory_id").alias("proposed_trajectory_id"), F.col("version").alias("base_version"),
        F.lit("pending").alias("status"), F.lit("clarify").alias("decision"), F.lit(True).alias("requires_confirmation"))


def resolve_proposals(pending: DataFrame, actions: DataFrame, versions: DataFrame, fresh: DataFrame) -> DataFrame:
    """Status of each proposal after confirm and reject requests.

    A confirmation is stale when the trajectory changed since, or when a fresh evaluation decides otherwise (for attach
    and branch also: chooses another trajectory). The first action on a proposal counts; repeating it changes nothing.
    """
    first = actions.groupBy("organization_id", "event_id").agg(F.min_by("action", "at").alias("action"))
    now = versions.select("organization_id", F.col("trajectory_id").alias("proposed_trajectory_id"),
                          F.col("version").alias("current_version"))
    again = fresh.select("organization_id", "event_id", F.col("decision").alias("fresh_decision"),
                         F.col("trajectory_id").alias("fresh_trajectory"))
    rows = (pending.join(first, ["organization_id", "event_id"], "left")
            .join(now, ["organization_id", "proposed_trajectory_id"], "left")
            .join(again, ["organization_id", "event_id"], "left"))
    moved = F.col("base_version").isNotNull() & ~F.col("current_version").eqNullSafe(F.col("base_version"))
    differs = ~F.col("fresh_decision").eqNullSafe(F.col("proposed_decision")) | (
        F.col("proposed_decision").isin("attach", "branch")
        & ~F.col("fresh_trajectory").eqNullSafe(F.col("proposed_trajectory_id")))
    status = (F.when(F.col("action") == "reject", "rejected").when(F.col("action").isNull(), "pending")
              .when(moved | differs, "stale").otherwise("confirmed"))
    return rows.withColumn("status", status)


def instrumentation(decisions: DataFrame, versions: DataFrame) -> DataFrame:
    return decisions.join(versions, ["organization_id", "trajectory_id"], "left").select(
        "organization_id", "event_id", F.lit("v1").alias("instrumentation_version"),
        F.col("version").alias("trajectory_version"), "decision", "source", "confidence", "candidate_score",
        "second_score", "margin", "rules")


def clarification_options(clarified: DataFrame, trajectories: DataFrame, limit: int = 5) -> DataFrame:
    """The first trajectories of the person, then *new* and *branch*, for each clarified event."""
    from loomtrace.operators.ordered import top_rows
    keys = ["organization_id", "workspace_id", "person_id"]
    # limit per person before joining, so a person with many trajectories adds `limit` rows per event
    first = top_rows(trajectories, keys, [F.col("created"), F.col("trajectory_id")], limit, "position").select(
        *keys, "position", F.col("trajectory_id").alias("option_trajectory"),
        F.coalesce(F.nullif("durable_goal", F.lit("")), "current_state").alias("label"))
    attach = clarified.join(first, keys).select(
        "organization_id", "event_id", F.lit("attach").alias("action"), "option_trajectory", "label", "position")
    fixed = clarified.select("organization_id", "event_id", F.explode(F.array(
        F.struct(F.lit("new").alias("action"), F.lit(None).cast("string").alias("option_trajectory"),
                 F.lit("Start new work").alias("label"), F.lit(limit + 1).alias("position")),
        F.struct(F.lit("branch").alias("action"), F.col("trajectory_id").alias("option_trajectory"),
                 F.lit("Related, but separate branch").alias("label"), F.lit(limit + 2).alias("position")))).alias("o")
    ).select("organization_id", "event_id", "o.*")
    return attach.unionByName(fixed)
