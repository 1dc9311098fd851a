"""Adapters from the sample tables to the data model.

Every adapter is a pure projection of a table, so it grows with the table. The texts are assembled from the row's own numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SUBJECTS = [
    "checkout gateway", "login service", "billing export", "search index", "mobile client",
    "report builder", "data pipeline",
]
VERBS = ["keeps failing on", "slows down in", "needs a rollback for", "works again on", "blocks release of"]
OBJECTS = ["staging cluster", "production cluster", "nightly build", "partner portal", "mobile beta", "audit archive"]
PRIMITIVES = ["continue", "new_topic", "clarify", "repair", "correct", "disagree", "resist", "refine"]
SURFACES = ["slack", "chat", "email"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A session of one machine may ask for a number of scan partitions, because a small file of one row group is one task."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = spark.conf.get("spark.loomtrace.scan.partitions", None)
    return scan.repartition(int(parts)) if parts else scan


def pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index + 1).cast("int"))


def events_with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a trace log: a user is a trajectory."""
    e = events_with_k(spark, sf_dir)
    k, uid, eid, kind = F.col("k"), F.col("user_id"), F.col("event_id"), F.col("event_type")
    actor = (
        F.when(kind == "signup", "human").when(kind == "view", "agent")
        .when(kind.isin("click", "error", "purchase"), "tool")
    )
    spoken = F.concat_ws(" ", pick(SUBJECTS, k % 7), pick(VERBS, eid % 5), pick(OBJECTS, (uid + k) % 6))
    metadata = (
        F.when(kind == "signup", F.concat(
            F.lit('{"provider": "prov_'), (k % 3).cast("string"), F.lit('", "behavior": {"primitive": "'),
            pick(PRIMITIVES, k % 8), F.lit('", "confidence": 0.'), (k % 9 + 1).cast("string"), F.lit("}}")))
        .when(kind == "view", F.concat(F.lit('{"provider": "prov_'), (k % 3).cast("string"), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"v": '), (k % 2).cast("string"), F.lit("}")))
    )
    return e.select(
        F.concat(F.lit("u"), uid.cast("string")).alias("trajectory_id"),
        uid.cast("string").alias("user_id"),
        eid.cast("string").alias("event_id"),
        eid.alias("seq"),
        "ts",
        F.concat(uid.cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("conversation_id"),
        F.concat(F.lit("th_"), (k % 5).cast("string")).alias("thread_id"),
        F.concat(F.lit("g_"), (k % 3).cast("string")).alias("goal_id"),
        actor.alias("actor_type"),
        F.when(kind == "view", F.concat(F.lit("agent_"), (k % 3).cast("string"))).alias("actor_id"),
        F.when(actor.isin("human", "agent"), spoken).otherwise("").alias("text"),
        F.when(actor == "tool", F.concat(F.lit("tool_"), (k % 4).cast("string"))).alias("tool_name"),
        F.when(kind == "error", "failed").when(kind == "purchase", "success").alias("status"),
        metadata.alias("metadata_json"),
    )


def org_text(k: Column, uid: Column) -> Column:
    """Work messages with tickets, customers, files, incidents and contact data."""
    ticket = F.concat(F.lit("OPS-"), (uid * 10 + k % 4).cast("string"))
    s = lambda c: c.cast("string")
    kind = k % 8
    return (
        F.when(kind == 0, F.concat(F.lit("Investigating "), ticket, F.lit(" checkout failing for customer acme"), s(k % 3)))
        .when(kind == 1, F.concat(F.lit("Update "), ticket, F.lit(": checkout service still failing again")))
        .when(kind == 2, F.concat(F.lit("We found the root cause in src/app"), s(k % 5), F.lit(".py see PR #"), s(k)))
        .when(kind == 3, F.concat(F.lit("This revealed a gap, now design a rollout plan for project atlas"), s(k % 2)))
        .when(kind == 4, F.concat(F.lit("Draft the quarterly planning note for team number "), s(uid % 5)))
        .when(kind == 5, F.concat(F.lit("INC-"), s(k), F.lit(" is back, env DB_HOST_"), s(k % 4),
                                  F.lit(" trace 123e4567-e89b-12d3-a456-4266141740"), F.lpad(s(k), 2, "0")))
        .when(kind == 6, F.concat(F.lit("Contact ops"), s(k), F.lit("@example.com or 555-123-45"), F.lpad(s(k), 2, "0"),
                                  F.lit(" about repo service-"), s(k % 6), F.lit(" at 10.0.0."), s(k)))
        .otherwise(F.concat(F.lit("Draft   the quarterly planning note, tenant: north"), s(k % 2),
                            F.lit(" commit deadbee"), s(k), F.lit(" https://wiki.example.org/p/"), s(k)))
    )


def raw_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as surface payloads. Every 11th row repeats the previous id, every 22nd with another text."""
    e = events_with_k(spark, sf_dir)
    k, uid, eid = F.col("k"), F.col("user_id"), F.col("event_id")
    s = lambda c: c.cast("string")
    base = F.when(eid % 11 == 10, eid - 1).otherwise(eid)
    text = F.when(eid % 22 == 21, F.lit("changed payload")).when(eid % 11 >= 9, F.lit("repeated payload")).otherwise(org_text(k, uid))
    occurred = F.when(eid % 11 >= 9, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).when(
        k % 10 == 0, F.expr("ts - INTERVAL 6 HOURS")).otherwise(F.col("ts"))
    repeated = eid % 11 >= 9
    return e.select(
        F.concat(F.lit("org_"), s(F.when(repeated, F.lit(0)).otherwise(uid % 3))).alias("organization_id"),
        F.concat(F.lit("ev_"), s(base)).alias("event_id"),
        F.when(repeated, F.lit("ws_0")).when(k % 4 != 0, F.concat(F.lit("ws_"), s(uid % 2))).alias("workspace_id"),
        F.when(repeated, F.lit("slack")).when(k % 5 != 0, pick(SURFACES, k % 3)).alias("surface"),
        F.concat(F.lit("u"), s(F.when(repeated, F.lit(0)).otherwise(uid))).alias("external_user_id"),
        F.concat(F.lit("c"), s(F.when(repeated, F.lit(0)).otherwise(uid * 10 + k % 3))).alias("conversation_id"),
        F.when((k % 6 != 0) & ~repeated, F.lit("human_message")).alias("type"),
        F.date_format(occurred, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("occurred_at"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("received_at"),
        F.when(repeated, F.lit("0")).when(k % 7 == 0, F.concat(F.lit("s"), s(k))).otherwise(s(eid)).alias("source_sequence"),
        F.when(k % 9 == 1, F.lit("[1, 2]")).when(k % 2 == 0, F.to_json(F.struct(text.alias("text")))).alias("content_json"),
        F.when(k % 2 == 1, text).alias("message"),
        F.lit(None).cast("string").alias("goal"),
        F.lit(None).cast("array<string>").alias("entities"),
        F.lit(None).cast("array<string>").alias("artifacts"),
        F.when(k % 3 == 0, F.lit('{"b": 1.0, "a": {"d": 2, "c": 3}}')).alias("metadata_json"),
        F.concat(F.lit('{"p": '), s(k % 2), F.lit("}")).alias("properties_json"),
        eid.alias("ingest_seq"),
    )


def org_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as clean organisation events with texts (no duplicates), one row per event."""
    e = events_with_k(spark, sf_dir)
    k, uid, eid = F.col("k"), F.col("user_id"), F.col("event_id")
    s = lambda c: c.cast("string")
    occurred = F.when(k % 10 == 0, F.expr("ts - INTERVAL 6 HOURS")).otherwise(F.col("ts"))
    return e.select(
        F.concat(F.lit("org_"), s(uid % 3)).alias("organization_id"),
        F.concat(F.lit("ev_"), s(eid)).alias("event_id"),
        F.concat(F.lit("ws_"), s(uid % 2)).alias("workspace_id"),
        pick(SURFACES, k % 3).alias("surface"),
        F.concat(F.lit("u"), s(uid)).alias("external_user_id"),
        F.concat(F.lit("c"), s(uid * 10 + k % 3)).alias("conversation_id"),
        F.lit("human_message").alias("type"),
        F.date_format(occurred, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("occurred_at"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("received_at"),
        F.when(k % 7 == 0, F.concat(F.lit("s"), s(k))).otherwise(s(eid)).alias("source_sequence"),
        org_text(k, uid).alias("text"),
        F.lit("").alias("goal"),
        F.array().cast("array<string>").alias("entities"),
        F.array().cast("array<string>").alias("artifacts"),
        F.lit("{}").alias("metadata_json"),
        eid.alias("ingest_seq"),
        "k", uid.alias("uid"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known identities: users not divisible by 4, two users share a person; slack and chat are linked."""
    u = table(spark, sf_dir, "events").select("user_id").distinct().filter("user_id % 4 <> 0")
    s = lambda c: c.cast("string")
    uid = F.col("user_id")
    return u.select(
        F.concat(F.lit("org_"), s(uid % 3)).alias("organization_id"),
        F.concat(F.lit("ws_"), s(uid % 2)).alias("workspace_id"),
        F.explode(F.array(F.lit("slack"), F.lit("chat"))).alias("surface"),
        F.concat(F.lit("u"), s(uid)).alias("external_user_id"),
        F.concat(F.lit("p_"), s(uid - uid % 12 + uid % 6)).alias("person_id"),
    )


LIFECYCLES = ["active", "waiting", "resolved", "blocked"]
CATEGORIES = ["same_work", "same_topic", "branching", "recurrence", "unrelated"]


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as linkage cases: an order is an incoming message, each of its lines a candidate piece of work."""
    li = table(spark, sf_dir, "lineitem")
    o, p, u = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    s = lambda c: c.cast("string")
    piece = lambda cond, *parts: F.when(cond, F.concat(*parts)).otherwise("")
    incoming = F.concat(
        F.lit("Notice"), piece(o % 3 == 0, F.lit(" OPS-"), s(o % 4)), piece(o % 5 == 0, F.lit(" customer acme"), s(o % 2)),
        piece(o % 7 == 0, F.lit(" repo svc"), s(o % 3)), piece(o % 11 == 0, F.lit(" this revealed more work")),
        piece(o % 4 == 1, F.lit(" still failing")), piece(o % 6 == 1, F.lit(" it is back")))
    goal = F.concat(F.lit("goal "), s(u % 5))
    state = F.concat(
        F.lit("Handling"), piece(p % 3 == 0, F.lit(" OPS-"), s(u % 4)), piece(p % 4 == 0, F.lit(" customer acme"), s(u % 2)),
        piece(p % 5 == 0, F.lit(" repo svc"), s(u % 3)))
    empty = F.array().cast("array<string>")
    return li.select(
        o.alias("case_id"),
        F.concat(F.lit("c"), F.lpad(s(F.col("l_linenumber")), 3, "0"), F.lit("_"), s(p), F.lit("_"), s(u)).alias("candidate_id"),
        pick(CATEGORIES, o % 5).alias("category"),
        incoming.alias("incoming_text"),
        F.when(o % 9 == 0, F.concat(F.lit("goal "), s(o % 5))).otherwise("").alias("incoming_goal"),
        F.when(o % 8 == 0, F.array(F.concat(F.lit("Ent"), s(o % 3)))).otherwise(empty).alias("incoming_entities"),
        F.when(o % 13 == 0, F.array(F.concat(F.lit("art"), s(o % 2)))).otherwise(empty).alias("incoming_artifacts"),
        goal.alias("candidate_goal"), state.alias("candidate_state"),
        F.concat_ws(" ", goal, state).alias("candidate_text"),
        pick(LIFECYCLES, p % 4).alias("lifecycle"),
        F.when(u % 2 == 0, F.array(F.concat(F.lit("ent"), s(u % 3)))).otherwise(empty).alias("candidate_entities"),
        F.when(u % 3 == 0, F.array(F.concat(F.lit("art"), s(u % 2)))).otherwise(empty).alias("candidate_artifacts"),
        ((p * 37 + u * 11) % 101 / 100.0).alias("score"),
        (F.col("l_linenumber").cast("long") * 1000000000 + p * 10000 + u).alias("created"),
        (u % 4 == 3).alias("other_person"), (p % 2 == 0).alias("unresolved"),
        pick(["attach", "new", "branch", "attach", "new"], o % 5).alias("expected_decision"),
    )


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as stored model opinions: two providers per case, three runs each."""
    o = F.col("o_orderkey")
    role = F.explode(F.arrays_zip(
        F.array(F.lit("primary"), F.lit("verifier")).alias("provider"), F.array(F.lit(0), F.lit(1)).alias("i"))).alias("r")
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", role).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run"))
    i = F.col("r.i")
    turn = (o + i * (F.col("o_custkey") % 3) + F.when(o % 10 == 0, F.col("run")).otherwise(0)) % 4
    action = pick(["new", "attach", "branch", "abstain"], turn)
    cid = F.when(action.isin("attach", "branch"), F.concat(F.lit("t"), (o % 7 + F.when(o % 17 == 0, i).otherwise(0)).cast("string")))
    return base.filter(~((i == 1) & (o % 9 == 4))).select(
        F.lit("org_0").alias("organization_id"), o.alias("case_id"), F.col("r.provider").alias("provider"),
        F.lit("m1").alias("model"), "run", action.alias("action"), cid.alias("candidate_id"),
        ((o * 7 + i * 13) % 41 / 100.0 + 0.6).alias("confidence"),
        F.when(o % 50 == 0, "L1").otherwise("L2").alias("maturity"))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stored log of routing decisions: a user's work within 50 event ids is one trajectory."""
    e = events_with_k(spark, sf_dir)
    k, uid, eid = F.col("k"), F.col("user_id"), F.col("event_id")
    s = lambda c: c.cast("string")
    work = F.concat(F.lit("tr_"), s(uid), F.lit("_"), s(F.floor(eid / 50)))
    rows = e.select("k", "user_id", "event_id", work.alias("work"))
    first = rows.filter("k % 10 NOT IN (1, 2)").groupBy("work").agg(F.min("event_id").alias("first"))
    decision = F.when(k % 10 == 2, "clarify").when(k % 10 == 1, "branch").when(eid == F.col("first"), "new").otherwise("attach")
    score = k * 37 % 101 / 100.0
    return rows.join(first, "work", "left").select(
        F.concat(F.lit("org_"), s(uid % 3)).alias("organization_id"), F.concat(F.lit("ws_"), s(uid % 2)).alias("workspace_id"),
        F.concat(F.lit("u"), s(uid)).alias("person_id"), F.concat(F.lit("ev_"), s(eid)).alias("event_id"), eid.alias("arrival"),
        decision.alias("decision"), F.when(k % 10 == 1, F.concat(F.lit("br_"), s(eid))).otherwise(F.col("work")).alias("trajectory_id"),
        F.when(k % 10 == 1, F.col("work")).alias("parent_id"), ((k % 31 + 70) / 100.0).alias("confidence"),
        pick(["rule", "gate", "judge"], k % 3).alias("source"), score.alias("candidate_score"), F.when(k % 4 != 0, score / 2).alias("second_score"),
        F.array(F.concat(F.lit("rule_"), s(k % 4))).alias("rules"), F.array().cast("array<struct<type:string,value:string,strength:string>>").alias("added_anchors"),
        pick(SURFACES, eid % 3).alias("surface"), F.concat(F.lit("c"), s(k % 3)).alias("conversation_id"),
        F.when(k % 3 != 0, F.concat(F.lit("goal "), s(k % 5))).otherwise("").alias("goal"),
        F.when(k % 4 != 0, F.concat(F.lit("note "), s(k))).otherwise("").alias("problem"),
        F.when(k % 6 == 0, F.array(F.concat(F.lit("try "), s(eid % 2)))).otherwise(F.array().cast("array<string>")).alias("attempts"),
        F.when(k % 5 == 3, F.array(F.concat(F.lit("err "), s(k % 2)))).otherwise(F.array().cast("array<string>")).alias("failures"),
        F.when(k % 7 == 0, F.array(F.concat(F.lit("q "), s(eid % 3)))).otherwise(F.array().cast("array<string>")).alias("unresolved"),
        *(F.array().cast("array<string>").alias(c) for c in ("entities", "artifacts", "decisions", "outcomes")), "k")
