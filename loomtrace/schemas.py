"""Table schemas of the data model (Spark DDL)."""

ANCHOR = "STRUCT<type: STRING, value: STRING, strength: STRING>"

# one row per logged event of a trajectory
TRACE_EVENT = (
    "trajectory_id STRING, user_id STRING, event_id STRING, seq BIGINT, ts TIMESTAMP_NTZ, "
    "conversation_id STRING, thread_id STRING, goal_id STRING, actor_type STRING, actor_id STRING, "
    "text STRING, tool_name STRING, status STRING, metadata_json STRING"
)

# raw payload as delivered by a surface, before normalization
RAW_PAYLOAD = (
    "organization_id STRING, event_id STRING, workspace_id STRING, surface STRING, external_user_id STRING, "
    "conversation_id STRING, type STRING, occurred_at STRING, received_at STRING, source_sequence STRING, "
    "content_json STRING, message STRING, goal STRING, entities ARRAY<STRING>, artifacts ARRAY<STRING>, "
    "metadata_json STRING, properties_json STRING, ingest_seq BIGINT"
)

# normalized organisation event
CANONICAL_EVENT = (
    "organization_id STRING, event_id STRING, workspace_id STRING, surface STRING, external_user_id STRING, "
    "conversation_id STRING, type STRING, occurred_at STRING, received_at STRING, source_sequence STRING, "
    "text STRING, goal STRING, entities ARRAY<STRING>, artifacts ARRAY<STRING>, metadata_json STRING, "
    "ingest_seq BIGINT"
)

IDENTITY = (
    "organization_id STRING, workspace_id STRING, surface STRING, external_user_id STRING, person_id STRING"
)

# one interpreted work event, the input of routing
WORK_EVENT = (
    "organization_id STRING, workspace_id STRING, person_id STRING, event_id STRING, arrival BIGINT, "
    "conversation_id STRING, surface STRING, goal STRING, problem STRING, entities ARRAY<STRING>, "
    f"artifacts ARRAY<STRING>, anchors ARRAY<{ANCHOR}>"
)

RULE = "STRUCT<rule: STRING, effect: STRING, explanation: STRING>"

DECISION = (
    "organization_id STRING, workspace_id STRING, person_id STRING, event_id STRING, arrival BIGINT, "
    "decision STRING, trajectory_id STRING, parent_id STRING, confidence DOUBLE, source STRING, "
    "candidate_score DOUBLE, second_score DOUBLE, margin DOUBLE, candidate_count BIGINT, "
    f"set_decision STRING, gate_decision STRING, top_linker STRING, top_anchor_relevant BOOLEAN, rules ARRAY<{RULE}>"
)

WORK_STATE = (
    "organization_id STRING, workspace_id STRING, person_id STRING, trajectory_id STRING, durable_goal STRING, "
    "current_state STRING, lifecycle STRING, entities ARRAY<STRING>, artifacts ARRAY<STRING>, "
    f"anchors ARRAY<{ANCHOR}>, open_questions ARRAY<STRING>, resolved_questions ARRAY<STRING>, "
    "decisions ARRAY<STRING>, attempts ARRAY<STRING>, failures ARRAY<STRING>, outcomes ARRAY<STRING>, "
    "surfaces ARRAY<STRING>, conversation_ids ARRAY<STRING>, recent_context ARRAY<STRING>, version BIGINT"
)

ASSESSMENT = (
    "organization_id STRING, case_id STRING, provider STRING, model STRING, run INT, action STRING, "
    "candidate_id STRING, confidence DOUBLE, evidence ARRAY<STRING>, maturity STRING"
)
