"""Common table expressions of the oracle SQL: the adapters of ``sources.drivers`` written for DuckDB."""

from __future__ import annotations

from loomtrace.sources import drivers as d


def words(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


BASE = "b AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

TRACE = f"""{BASE}, te AS (
  SELECT 'u' || user_id AS trajectory_id, CAST(event_id AS VARCHAR) AS event_id, event_id AS seq, ts,
    user_id || '-' || strftime(ts, '%Y-%m-%d') AS conversation_id,
    'th_' || (k % 5) AS thread_id, 'g_' || (k % 3) AS goal_id,
    CASE event_type WHEN 'signup' THEN 'human' WHEN 'view' THEN 'agent' WHEN 'click' THEN 'tool'
      WHEN 'error' THEN 'tool' WHEN 'purchase' THEN 'tool' END AS actor_type,
    CASE WHEN event_type = 'view' THEN 'agent_' || (k % 3) END AS actor_id,
    CASE WHEN event_type IN ('signup', 'view') THEN {words(d.SUBJECTS)}[k % 7 + 1] || ' ' ||
      {words(d.VERBS)}[event_id % 5 + 1] || ' ' || {words(d.OBJECTS)}[(user_id + k) % 6 + 1] ELSE '' END AS text,
    CASE WHEN event_type IN ('click', 'error', 'purchase') THEN 'tool_' || (k % 4) END AS tool_name,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' END AS status,
    CASE WHEN event_type IN ('click', 'error', 'purchase') THEN k % 2 END AS v,
    CASE WHEN event_type IN ('signup', 'view') THEN 'prov_' || (k % 3) END AS provider,
    CASE WHEN event_type = 'signup' THEN {words(d.PRIMITIVES)}[k % 8 + 1] END AS primitive,
    CASE WHEN event_type = 'signup' THEN CAST('0.' || (k % 9 + 1) AS DOUBLE) END AS confidence
  FROM b)"""

_TICKET = "'OPS-' || (user_id * 10 + k % 4)"
ORG_TEXT = f"""CASE k % 8
    WHEN 0 THEN 'Investigating ' || {_TICKET} || ' checkout failing for customer acme' || (k % 3)
    WHEN 1 THEN 'Update ' || {_TICKET} || ': checkout service still failing again'
    WHEN 2 THEN 'We found the root cause in src/app' || (k % 5) || '.py see PR #' || k
    WHEN 3 THEN 'This revealed a gap, now design a rollout plan for project atlas' || (k % 2)
    WHEN 4 THEN 'Draft the quarterly planning note for team number ' || (user_id % 5)
    WHEN 5 THEN 'INC-' || k || ' is back, env DB_HOST_' || (k % 4) || ' trace 123e4567-e89b-12d3-a456-4266141740' ||
      lpad(CAST(k AS VARCHAR), 2, '0')
    WHEN 6 THEN 'Contact ops' || k || '@example.com or 555-123-45' || lpad(CAST(k AS VARCHAR), 2, '0') ||
      ' about repo service-' || (k % 6) || ' at 10.0.0.' || k
    ELSE 'Draft   the quarterly planning note, tenant: north' || (k % 2) || ' commit deadbee' || k ||
      ' https://wiki.example.org/p/' || k END"""

RAW = f"""{BASE}, raw AS (
  SELECT 'org_' || CASE WHEN event_id % 11 >= 9 THEN 0 ELSE user_id % 3 END AS organization_id,
    'ev_' || CASE WHEN event_id % 11 = 10 THEN event_id - 1 ELSE event_id END AS event_id,
    CASE WHEN event_id % 11 >= 9 THEN 'ws_0' WHEN k % 4 <> 0 THEN 'ws_' || (user_id % 2) END AS workspace_id,
    CASE WHEN event_id % 11 >= 9 THEN 'slack' WHEN k % 5 <> 0 THEN {words(d.SURFACES)}[k % 3 + 1] END AS surface,
    'u' || CASE WHEN event_id % 11 >= 9 THEN 0 ELSE user_id END AS external_user_id,
    'c' || CASE WHEN event_id % 11 >= 9 THEN 0 ELSE user_id * 10 + k % 3 END AS conversation_id,
    CASE WHEN k % 6 <> 0 AND event_id % 11 < 9 THEN 'human_message' END AS type,
    strftime(CASE WHEN event_id % 11 >= 9 THEN TIMESTAMP '2024-01-01 00:00:00'
      WHEN k % 10 = 0 THEN ts - INTERVAL 6 HOUR ELSE ts END, '%Y-%m-%dT%H:%M:%S.%f') AS occurred_at,
    CASE WHEN event_id % 11 >= 9 THEN '0' WHEN k % 7 = 0 THEN 's' || k ELSE CAST(event_id AS VARCHAR) END
      AS source_sequence,
    CASE WHEN event_id % 22 = 21 THEN 'changed payload' WHEN event_id % 11 >= 9 THEN 'repeated payload'
      ELSE {ORG_TEXT} END AS full_text,
    event_id AS ingest_seq, k
  FROM b)"""

ORG = f"""{BASE}, oe AS (
  SELECT 'org_' || (user_id % 3) AS organization_id, 'ev_' || event_id AS event_id,
    'ws_' || (user_id % 2) AS workspace_id, {words(d.SURFACES)}[k % 3 + 1] AS surface, 'u' || user_id AS external_user_id,
    'c' || (user_id * 10 + k % 3) AS conversation_id,
    strftime(CASE WHEN k % 10 = 0 THEN ts - INTERVAL 6 HOUR ELSE ts END, '%Y-%m-%dT%H:%M:%S.%f') AS occurred_at,
    CASE WHEN k % 7 = 0 THEN 's' || k ELSE CAST(event_id AS VARCHAR) END AS source_sequence,
    {ORG_TEXT} AS text, event_id AS ingest_seq, k, user_id AS uid
  FROM b)"""

IDENT = """ids AS (
  SELECT DISTINCT 'org_' || (user_id % 3) AS organization_id, 'ws_' || (user_id % 2) AS workspace_id, s.surface,
    'u' || user_id AS external_user_id, 'p_' || (user_id - user_id % 12 + user_id % 6) AS person_id
  FROM events, (VALUES ('slack'), ('chat')) s(surface) WHERE user_id % 4 <> 0)"""
