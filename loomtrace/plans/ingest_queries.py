"""Normalization, validation, idempotency and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.functions.text import unique_union
from loomtrace.operators import identity, ingest
from loomtrace.plans.oracle import BASE, IDENT, ORG, RAW
from loomtrace.plans.registry import Section
from loomtrace.sources import drivers

SECTION = Section()

_GOOD = f"""{RAW}, good AS (SELECT organization_id, event_id, coalesce(workspace_id, 'default') AS workspace_id,
    coalesce(surface, 'generic_chatbot') AS surface, external_user_id, conversation_id,
    coalesce(type, 'human_message') AS type, occurred_at, source_sequence, full_text AS text,
    CASE WHEN k % 3 = 0 THEN '{{"a":{{"c":3,"d":2}},"b":1}}' ELSE '{{"p":' || (k % 2) || '}}' END AS metadata,
    ingest_seq FROM raw WHERE k % 9 <> 1)"""


@SECTION.add("b01_normalized_events", f"WITH {_GOOD} SELECT * FROM good")
def _(spark, sf):
    good, _ = ingest.normalize(drivers.raw_payloads(spark, sf))
    from loomtrace.functions.canonical import canonical_json
    return good.select("organization_id", "event_id", "workspace_id", "surface", "external_user_id", "conversation_id",
                       "type", "occurred_at", "source_sequence", "text",
                       canonical_json(F.col("metadata_json")).alias("metadata"), "ingest_seq")


@SECTION.add("b01_rejected_payloads", f"""WITH {RAW} SELECT event_id, ingest_seq, 'content must be an object' AS reject_reason
  FROM raw WHERE k % 9 = 1""")
def _(spark, sf):
    _, bad = ingest.normalize(drivers.raw_payloads(spark, sf))
    return bad.select("event_id", "ingest_seq", "reject_reason")


@SECTION.add("b02_event_type_split", """SELECT event_id, event_type, 'Unsupported event_type: ' || event_type AS reject_reason
  FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN 'human_message' WHEN 'view' THEN 'agent_message'
    WHEN 'purchase' THEN 'tool_result' ELSE event_type END AS event_type FROM events)
  WHERE event_type NOT IN ('human_message', 'agent_message', 'tool_result')
  UNION ALL SELECT event_id, CASE event_type WHEN 'signup' THEN 'human_message' WHEN 'view' THEN 'agent_message'
    WHEN 'purchase' THEN 'tool_result' END, NULL FROM events WHERE event_type IN ('signup', 'view', 'purchase')""")
def _(spark, sf):
    mapped = drivers.table(spark, sf, "events").select("event_id", F.expr(
        "CASE event_type WHEN 'signup' THEN 'human_message' WHEN 'view' THEN 'agent_message' "
        "WHEN 'purchase' THEN 'tool_result' ELSE event_type END AS event_type"))
    good, bad = ingest.split_by_type(mapped)
    return good.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(bad)


@SECTION.add("b03_provider_metadata", f"""WITH {BASE} SELECT event_id, '{{"provider":"slack"' ||
    CASE WHEN k % 2 = 0 THEN ',"model":"m' || (k % 5) || '"' ELSE '' END ||
    CASE WHEN k % 3 = 0 THEN ',"external_id":"x' || event_id || '"' ELSE '' END || ',"channel_id":"ch' || (k % 4) || '"' ||
    CASE WHEN k % 4 = 1 THEN ',"slack_thread_ts":"t' || k || '"' ELSE '' END || '}}' AS metadata,
    CASE WHEN k % 7 = 0 THEN 'bot' ELSE 'slack' END AS actor_id FROM b""")
def _(spark, sf):
    k, s = F.col("k"), lambda c: c.cast("string")
    model = F.when(k % 2 == 0, F.concat(F.lit("m"), s(k % 5))).otherwise("")
    external = F.when(k % 3 == 0, F.concat(F.lit("x"), s(F.col("event_id"))))
    extra = {"channel_id": F.concat(F.lit("ch"), s(k % 4)), "slack_thread_ts": F.when(k % 4 == 1, F.concat(F.lit("t"), s(k)))}
    return drivers.events_with_k(spark, sf).select(
        "event_id", ingest.provider_metadata("slack", model, external, extra).alias("metadata"),
        F.coalesce(F.when(k % 7 == 0, "bot"), F.lit("slack")).alias("actor_id"))


@SECTION.add("b04_trace_defaults", f"""WITH {BASE} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'c' || k ELSE 'c_default' END
    AS conversation_id, CASE WHEN k % 3 = 0 THEN 't' || k ELSE 't_' || user_id END AS thread_id,
    CASE WHEN k % 5 = 0 THEN 'g' || k END AS goal_id FROM b""")
def _(spark, sf):
    k, s = F.col("k"), lambda c: c.cast("string")
    e = drivers.events_with_k(spark, sf).select(
        "event_id", "user_id", F.when(k % 2 == 0, F.concat(F.lit("c"), s(k))).alias("conversation_id"),
        F.when(k % 3 == 0, F.concat(F.lit("t"), s(k))).alias("thread_id"),
        F.when(k % 5 == 0, F.concat(F.lit("g"), s(k))).alias("goal_id"))
    return ingest.fill_from_trace(e, F.lit("c_default"), F.concat(F.lit("t_"), s(F.col("user_id"))),
                                  F.lit(None).cast("string")).drop("user_id")


@SECTION.add("b05_surface_policy", f"""WITH {ORG} SELECT organization_id, event_id, surface, organization_id <> 'org_1' OR
    surface = 'slack' AS allowed, CASE WHEN organization_id <> 'org_1' OR surface = 'slack' THEN 'surface allowed'
    ELSE 'surface is not enabled for organization' END AS reason FROM oe""")
def _(spark, sf):
    e = drivers.org_events(spark, sf)
    config = e.select("organization_id").distinct().select("organization_id", F.when(
        F.col("organization_id") == "org_1", F.array(F.lit("slack"))).otherwise(F.array().cast("array<string>"))
        .alias("allowed_surfaces"))
    return ingest.allowed_surfaces(e, config).select("organization_id", "event_id", "surface", "allowed", "reason")


_CANON = """'{"artifacts":[],"conversation_id":"' || conversation_id || '","entities":[],"event_id":"' || event_id ||
  '","external_user_id":"' || external_user_id || '","goal":"","metadata":"' || replace(metadata, '"', '\\"') ||
  '","occurred_at":"' || occurred_at || '","organization_id":"' || organization_id || '","source_sequence":"' ||
  source_sequence || '","surface":"' || surface || '","text":"' || text || '","type":"' || type || '","workspace_id":"' ||
  workspace_id || '"}'"""


@SECTION.add("b09_payload_hash", f"WITH {_GOOD} SELECT event_id, ingest_seq, sha256({_CANON}) AS payload_hash FROM good")
def _(spark, sf):
    good, _ = ingest.normalize(drivers.raw_payloads(spark, sf))
    return good.select("event_id", "ingest_seq", ingest.payload_hash().alias("payload_hash"))


@SECTION.add("f1_idempotent_ingest", f"""WITH {_GOOD}, h AS (SELECT *, sha256({_CANON}) AS payload_hash FROM good),
  g AS (SELECT organization_id, event_id, payload_hash, min(ingest_seq) AS first_seq, count(*) AS deliveries
    FROM h GROUP BY 1, 2, 3)
  SELECT *, CASE WHEN first_seq = min(first_seq) OVER (PARTITION BY organization_id, event_id) THEN 'accepted'
    ELSE 'conflict' END AS status FROM g""")
def _(spark, sf):
    good, _ = ingest.normalize(drivers.raw_payloads(spark, sf))
    return ingest.idempotency(good.withColumn("payload_hash", ingest.payload_hash()))


@SECTION.add("f1_accepted_events", f"""WITH {_GOOD} SELECT organization_id, event_id, min(ingest_seq) AS ingest_seq,
    arg_min(text, ingest_seq) AS text FROM good GROUP BY 1, 2""")
def _(spark, sf):
    good, _ = ingest.normalize(drivers.raw_payloads(spark, sf))
    return ingest.accepted_events(good).select("organization_id", "event_id", "ingest_seq", "text")


@SECTION.add("f2_first_wins_cache", """SELECT o_custkey AS signature, arg_min(o_orderstatus, o_orderkey) AS verdict,
    min(o_orderkey) AS seq FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  GROUP BY 1""")
def _(spark, sf):
    rows = drivers.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("signature"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderkey").alias("seq"))
    cached = drivers.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("signature"))
    return ingest.first_wins(rows, cached, ["signature"], "seq")


@SECTION.add("f2_last_wins_cache", """SELECT o_custkey AS signature, arg_max(o_orderstatus, o_orderkey) AS verdict,
    max(o_orderkey) AS seq FROM orders GROUP BY 1""")
def _(spark, sf):
    rows = drivers.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("signature"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderkey").alias("seq"))
    return ingest.last_wins(rows, ["signature"], "seq")


@SECTION.add("f3_ordered_unique_union", f"""WITH {BASE}, l AS (SELECT event_id, unnest(['a' || (k % 3), '', 'b' || (k % 4), NULL,
    'a' || (k % 2), 'b' || (k % 4)]) AS x, unnest(range(6)) AS i FROM b),
  f AS (SELECT event_id, x, min(i) AS i FROM l WHERE x <> '' GROUP BY 1, 2)
  SELECT event_id, string_agg(x, '|' ORDER BY i) AS merged FROM f GROUP BY 1""")
def _(spark, sf):
    k, s = F.col("k"), lambda c: c.cast("string")
    first = F.array(F.concat(F.lit("a"), s(k % 3)), F.lit(""), F.concat(F.lit("b"), s(k % 4)), F.lit(None).cast("string"))
    second = F.array(F.concat(F.lit("a"), s(k % 2)), F.concat(F.lit("b"), s(k % 4)))
    return drivers.events_with_k(spark, sf).select("event_id", F.array_join(unique_union(first, second), "|").alias("merged"))


@SECTION.add("f7_tenant_isolation", f"""WITH {_GOOD} SELECT organization_id, count(*) AS events,
    count(*) FILTER (NOT starts_with(conversation_id, 'c')) AS foreign_rows,
    count(DISTINCT event_id) AS distinct_ids FROM good GROUP BY 1""")
def _(spark, sf):
    good, _ = ingest.normalize(drivers.raw_payloads(spark, sf))
    per_id = good.groupBy("organization_id", "event_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("conversation_id").startswith("c")).alias("f"))
    return per_id.groupBy("organization_id").agg(
        F.sum("n").cast("long").alias("events"), F.sum("f").cast("long").alias("foreign_rows"),
        F.count("*").alias("distinct_ids"))


_PERSON = """coalesce(person_id, 'person_' || substr(sha256(organization_id || ':' || workspace_id || ':' || surface || ':' ||
  external_user_id), 1, 16))"""


@SECTION.add("e1_identity_resolution", f"""WITH {ORG}, {IDENT} SELECT organization_id, event_id, surface, {_PERSON} AS person_id
  FROM oe LEFT JOIN ids USING (organization_id, workspace_id, surface, external_user_id)""")
def _(spark, sf):
    return identity.resolve(drivers.org_events(spark, sf), drivers.identities(spark, sf)).select(
        "organization_id", "event_id", "surface", "person_id")


@SECTION.add("e2_anonymous_ids", f"""WITH {ORG} SELECT event_id, 'surface_' || substr(sha256(workspace_id || ':' || surface ||
    ':' || external_user_id), 1, 16) AS person_id FROM oe""")
def _(spark, sf):
    return drivers.org_events(spark, sf).select("event_id", identity.anonymous_id(
        F.col("workspace_id"), F.col("surface"), F.col("external_user_id")).alias("person_id"))


@SECTION.add("e3_identity_link_conflicts", f"""WITH {ORG}, {IDENT}, req AS (SELECT organization_id, workspace_id, surface,
    external_user_id, 'p_' || (uid - uid % 12 + uid % 6 + CASE WHEN k % 10 = 0 THEN 1000 ELSE 0 END) AS person_id,
    min(ingest_seq) AS ingest_seq FROM oe GROUP BY 1, 2, 3, 4, 5),
  f AS (SELECT organization_id, workspace_id, surface, external_user_id, arg_min(person_id, ingest_seq) AS first_person
    FROM req GROUP BY 1, 2, 3, 4)
  SELECT organization_id, workspace_id, surface, external_user_id, req.person_id,
    CASE WHEN req.person_id <> coalesce(ids.person_id, first_person) THEN 'conflict' WHEN ids.person_id IS NOT NULL
      THEN 'unchanged' ELSE 'linked' END AS outcome
  FROM req JOIN f USING (organization_id, workspace_id, surface, external_user_id)
  LEFT JOIN ids USING (organization_id, workspace_id, surface, external_user_id)""")
def _(spark, sf):
    e = drivers.org_events(spark, sf)
    uid = F.col("uid")
    person = F.concat(F.lit("p_"), (uid - uid % 12 + uid % 6 + F.when(F.col("k") % 10 == 0, 1000).otherwise(0)).cast("string"))
    requests = e.select(*identity.KEYS, person.alias("person_id"), "ingest_seq")
    return identity.link(drivers.identities(spark, sf), requests, "ingest_seq").select(
        *identity.KEYS, "person_id", "outcome")
