"""Table reads, schema evolution, digests and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.operators import audit
from loomtrace.plans.oracle import BASE, TRACE
from loomtrace.plans.registry import Section
from loomtrace.session import new_folder
from loomtrace.sources import drivers, tables

SECTION = Section()


@SECTION.add("a1_load_trajectory", f"""WITH {TRACE} SELECT event_id, seq, actor_type, coalesce(text, '') AS text, tool_name
  FROM te WHERE trajectory_id = 'u7'""")
def _(spark, sf):
    return tables.load_trajectory(drivers.trace_events(spark, sf), "u7").select(
        "event_id", "seq", "actor_type", "text", "tool_name")


@SECTION.add("a2_append_events", "SELECT event_id, event_type, user_id FROM events")
def _(spark, sf):
    """Two appends to a log partitioned by type, read back whole."""
    path, e = new_folder(spark), drivers.table(spark, sf, "events").select("event_id", "event_type", "user_id")
    tables.append_events(e.filter("event_id % 2 = 0"), path, ["event_type"])
    tables.append_events(e.filter("event_id % 2 = 1"), path, ["event_type"])
    return spark.read.schema(e.schema).parquet(path).select("event_id", "event_type", "user_id")


@SECTION.add("a2_refused_appends", """SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'first' ELSE 'second' END AS part,
    2 AS refused FROM events WHERE event_id % 3 < 2""")
def _(spark, sf):
    """Two appends of new events are taken; one that repeats an event of the log, and one that holds an event twice, are refused whole."""
    path, e = new_folder(spark), drivers.table(spark, sf, "events").select("event_id", "event_type")
    third, refused = F.col("event_id") % 3, 0
    tables.append_new(e.filter(third == 0).withColumn("part", F.lit("first")), path, ["event_id"])
    tables.append_new(e.filter(third == 1).withColumn("part", F.lit("second")), path, ["event_id"])
    for rows in (e.filter((third == 2) | (F.col("event_id") % 30 == 0)), e.filter(third == 2).union(e.filter("event_id % 30 = 2"))):
        try:
            tables.append_new(rows.withColumn("part", F.lit("third")), path, ["event_id"])
        except tables.DuplicateRows:
            refused += 1
    return spark.read.parquet(path).select("event_id", "event_type", "part", F.lit(refused).alias("refused"))


@SECTION.add("a3_json_lines", f"""WITH {BASE} SELECT event_id, event_type, round(value, 6) AS value, k FROM b""")
def _(spark, sf):
    """A file of JSON lines with blank lines between them, read with a fixed schema."""
    path = new_folder(spark)
    drivers.events_with_k(spark, sf).select(F.explode(F.array(
        F.to_json(F.struct("event_id", "event_type", "value", "k")), F.lit(""))).alias("line")).write.text(path)
    lines = tables.read_jsonl(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE, k BIGINT")
    return lines.withColumn("value", F.round("value", 6))


@SECTION.add("a5_append_jsonl", """SELECT event_id, event_type, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS record_id,
    '2024-01-01' AS recorded_at FROM events""")
def _(spark, sf):
    path, e = new_folder(spark), drivers.table(spark, sf, "events").select(F.col("event_id").cast("bigint").alias("event_id"), "event_type")
    tables.append_jsonl(e.filter("event_id % 2 = 0"), path, F.lit("2024-01-01"))
    tables.append_jsonl(e.filter("event_id % 2 = 1"), path, F.lit("2024-01-01"))
    return tables.read_jsonl(spark, path, "event_id BIGINT, event_type STRING, record_id STRING, recorded_at STRING")


@SECTION.add("a6_snapshots", """SELECT o_custkey, count(*) AS now, count(*) FILTER (o_orderkey % 2 = 0) AS before FROM orders GROUP BY 1""")
def _(spark, sf):
    """Two versions of a snapshot, each read back, side by side."""
    root, o = new_folder(spark), drivers.table(spark, sf, "orders")
    tables.save_snapshot(o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.count("*").alias("before")), root, 1)
    tables.save_snapshot(o.groupBy("o_custkey").agg(F.count("*").alias("now")), root, 2)
    both = tables.load_snapshot(spark, root, 2).join(tables.load_snapshot(spark, root, 1), "o_custkey", "left")
    return both.withColumn("before", F.coalesce("before", F.lit(0)).cast("bigint"))


@SECTION.add("a7_audit_table", """SELECT o_orderkey AS event_id, o_orderdate::VARCHAR AS created_at, o_orderstatus AS decision FROM orders WHERE o_custkey % 3 = 1""")
def _(spark, sf):
    """An audit table of all organisations, read back for one of them."""
    root = new_folder(spark)
    rows = drivers.table(spark, sf, "orders").select(F.concat(F.lit("org_"), (F.col("o_custkey") % 3).cast("string")).alias("organization_id"),
                                                     F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("string").alias("created_at"),
                                                     F.col("o_orderstatus").alias("decision"))
    tables.append_audit(rows, root, "decisions")
    return tables.read_audit(spark, root, "decisions", "org_1").select("event_id", "created_at", "decision")


@SECTION.add("a9_feature_matrix", """SELECT label, count(*) AS n, sum(len(embedding)) AS numbers FROM embeddings GROUP BY 1""")
def _(spark, sf):
    path = new_folder(spark)
    tables.save_features(drivers.table(spark, sf, "embeddings").select(F.col("embedding").alias("feature"), "label"), path)
    return spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("feature")).alias("numbers"))


@SECTION.add("a4_benchmark_digests", """SELECT item_id, sha256(text) AS digest, item_id % 10 <> 3 AS matches FROM benchmark""")
def _(spark, sf):
    """The benchmark frozen as one file per item, its bytes digested and compared with a stored table of what they should be."""
    root, items = new_folder(spark), drivers.table(spark, sf, "benchmark").select("item_id", "text")
    named = items.select("text", F.col("item_id").alias("item"))
    named.write.partitionBy("item").option("lineSep", "\u0000").text(f"{root}/files")
    expected = items.select(F.col("item_id").cast("string").alias("file"), F.sha2(F.when(F.col("item_id") % 10 == 3, F.concat("text", F.lit(" "))).otherwise(
        F.col("text")), 256).alias("sha256"))
    expected.write.parquet(f"{root}/digests")
    checked = tables.verify_digests(spark, f"{root}/files/*/*.txt", spark.read.parquet(f"{root}/digests"), name=-2, end=1)
    return checked.select(F.regexp_extract("file", "[0-9]+", 0).cast("bigint").alias("item_id"), F.col("actual").alias("digest"), F.col("match").alias("matches"))


@SECTION.add("a4_json_array", "SELECT item_id, length(text)::BIGINT AS letters, sha256(text) AS digest FROM benchmark")
def _(spark, sf):
    """The benchmark frozen as one JSON array over many lines, read back with a fixed schema. A benchmark is a bounded list of items, so
    one task may write it."""
    path, items = new_folder(spark), drivers.table(spark, sf, "benchmark").select("item_id", "text")
    body = items.agg(F.to_json(F.sort_array(F.collect_list(F.struct("item_id", "text"))), {"pretty": "true"}).alias("value"))
    body.write.text(path)
    read = tables.read_json_array(spark, path, "item_id BIGINT, text STRING")
    return read.select("item_id", F.length("text").cast("bigint").alias("letters"), F.sha2("text", 256).alias("digest"))


@SECTION.add("a8_schema_evolution", f"""WITH {TRACE} SELECT event_id, CASE WHEN seq % 2 = 0 THEN thread_id END AS thread_id,
    CASE WHEN seq % 2 = 0 THEN goal_id END AS goal_id, actor_type FROM te""")
def _(spark, sf):
    e = drivers.trace_events(spark, sf).select("event_id", "thread_id", "goal_id", "actor_type", "seq")
    old = e.filter("seq % 2 = 1").drop("thread_id", "goal_id")
    return tables.evolve(old, e.filter("seq % 2 = 0")).drop("seq")


@SECTION.add("a10_list_trajectories", f"""WITH {BASE} SELECT 'u' || user_id AS trajectory_id, 'org_' || (user_id % 3) AS organization_id,
    strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created, arg_min(event_type, event_id) AS goal, arg_max(event_type, event_id) AS current_state
  FROM b WHERE user_id % 3 = 1 AND user_id % 2 = 0 GROUP BY 1, 2""")
def _(spark, sf):
    e = drivers.org_events(spark, sf).join(drivers.table(spark, sf, "events").select(
        F.col("event_id").alias("ingest_seq"), "event_type", "ts"), "ingest_seq")
    states = e.groupBy(F.col("external_user_id").alias("trajectory_id"), "organization_id", "workspace_id").agg(
        F.min("ts").alias("created"), F.min_by("event_type", "ingest_seq").alias("goal"),
        F.max_by("event_type", "ingest_seq").alias("current_state"))
    return tables.list_trajectories(states, "org_1", "ws_0").select(
        "trajectory_id", "organization_id", F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), "goal", "current_state")


@SECTION.add("a11_list_corrections", """SELECT o_orderkey AS correction_id, CASE WHEN o_orderkey % 4 = 0 THEN 'k' || (o_custkey % 3) END AS kind,
    o_orderkey % 4 = 0 AS has_diagnosis FROM orders WHERE o_custkey % 3 = 1""")
def _(spark, sf):
    o = drivers.table(spark, sf, "orders")
    c = o.select(F.concat(F.lit("org_"), (F.col("o_custkey") % 3).cast("string")).alias("organization_id"),
                 F.col("o_orderkey").alias("correction_id"), F.col("o_orderdate").alias("created_at"),
                 F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('{"kind":"k'), (F.col("o_custkey") % 3).cast("string"),
                                                               F.lit('"}'))).alias("diagnosis_json"))
    return tables.list_corrections(c, "org_1").select(
        "correction_id", F.col("diagnosis.kind").alias("kind"), F.col("diagnosis").isNotNull().alias("has_diagnosis"))


@SECTION.add("i7_corrections", """SELECT o_orderkey AS event_id, ['confirm', 'attach', 'merge', 'delete'][o_orderkey % 4 + 1] AS action,
    o_orderkey % 4 <> 3 AS accepted FROM orders""")
def _(spark, sf):
    action = drivers.pick(["confirm", "attach", "merge", "delete"], F.col("o_orderkey") % 4)
    none = F.lit(None).cast("string")
    requests = drivers.table(spark, sf, "orders").select(
        F.lit("org_0").alias("organization_id"), F.col("o_orderkey").alias("event_id"), action.alias("action"),
        *[none.alias(c) for c in ("decision_id", "decision_record_id", "source", "trajectory_id", "reason_code", "diagnosis")],
        F.col("o_orderdate").alias("created_at"))
    good, bad = audit.corrections(requests)
    return good.select("event_id", F.col("correction.decision").alias("action"), F.lit(True).alias("accepted")).unionByName(
        bad.select("event_id", "action", F.lit(False).alias("accepted")))
