"""Readers and writers of the tables."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from loomtrace.session import durable, release

AUDIT_ORDER = {  # read order per audit table
    "decisions": ["created_at", "event_id"], "corrections": ["created_at", "correction_id"],
    "signals": ["created_at", "signal_id"], "proposals": ["created_at", "proposal_id"],
    "recovery_cases": ["ordinal", "case_id"], "adjudications": ["created_at", "case_id"],
}


def load_trajectory(events: DataFrame, trajectory_id: str) -> DataFrame:
    """Events of one trajectory; the filter reaches the scan, null text and metadata are filled."""
    return events.filter(F.col("trajectory_id") == trajectory_id).withColumns({
        "text": F.coalesce("text", F.lit("")), "metadata_json": F.coalesce("metadata_json", F.lit("{}"))}).orderBy("ts", "seq")


def append_events(events: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to the event log. Idempotency is decided before, by ``operators.ingest``."""
    writer = events.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


class DuplicateRows(ValueError):
    """An append that holds keys twice, or keys that the table has already."""


def append_new(rows: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """Append rows with new keys; any key that is there already, or twice among the rows, refuses the whole append.

    The table is partitioned by a hash of the key, and only the partitions that the rows fall into are compared (of the key columns), so a
    small append does not read a large log. One writer at a time.
    """
    spark = rows.sparkSession
    new = durable(rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
    counts = new.groupBy("bucket", *key).count()
    twice = counts.filter("count > 1").count()
    known = 0
    if exists(spark, path):
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        there = spark.read.schema(new.schema).parquet(path).filter(F.col("bucket").isin(touched)).select("bucket", *key)
        known = there.join(counts, ["bucket", *key], "left_semi").count()
    if twice or known:
        release(new)
        raise DuplicateRows(f"{twice} keys occur twice and {known} are in the table already")
    new.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
    release(new)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class Snapshots:
    """Versions of a set of tables. A version counts once its manifest is there, which is written last and never over another.

    Readers take the latest committed version; what a failed or unfinished writer left has no manifest and is not seen. Two writers of one
    version cannot both commit where the file system refuses to create a file twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self.path(f"{self.root}/manifests")
        if not self.fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self.fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def write(self, tables: dict[str, DataFrame]) -> dict:
        """Write the tables into a folder of their own and give the manifest that would commit them."""
        folder = f"{self.root}/data/{uuid4().hex}"
        for name, table in tables.items():
            table.write.parquet(f"{folder}/{name}")
        return {"folder": folder, "tables": {n: t.schema.json() for n, t in tables.items()}}

    def commit(self, manifest: dict, version: int) -> int:
        """Make the tables of ``manifest`` version ``version``; fails if that version is committed already."""
        stream = self.fs.create(self.path(f"{self.root}/manifests/{version:09d}.json"), False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return version

    def save(self, tables: dict[str, DataFrame]) -> int:
        return self.commit(self.write(tables), (self.latest() or 0) + 1)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of the latest committed version, or of ``version``."""
        version = self.latest() if version is None else version
        if version not in self.versions():
            raise LookupError(f"no committed version {version}")
        file = self.spark.read.text(f"{self.root}/manifests/{version:09d}.json", wholetext=True).first()[0]
        manifest = json.loads(file)
        return self.spark.read.schema(StructType.fromJson(json.loads(manifest["tables"][name]))).parquet(f"{manifest['folder']}/{name}")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def append_jsonl(rows: DataFrame, path: str, recorded_at: Column | None = None) -> None:
    """Append records with a deterministic ``record_id`` and ``recorded_at``."""
    body = F.to_json(F.struct(*rows.columns))
    rows.withColumns({"record_id": F.sha2(body, 256), "recorded_at": recorded_at if recorded_at is not None else F.current_timestamp()}
                     ).write.mode("append").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A frozen benchmark stored as one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def verify_digests(spark: SparkSession, path: str, expected: DataFrame, name: int = -1, end: int = 0) -> DataFrame:
    """SHA-256 of the bytes of each file joined with the expected digest (``file``, ``sha256``).

    ``name`` is the part of the path that names the file (-1: the last; a folder ``key=value`` is named by its value); ``end`` bytes at the
    end of a file, such as a line separator, are left out.
    """
    part = F.element_at(F.split("path", "/"), name)
    content = F.substring(F.col("content"), F.lit(1), F.length("content") - end) if end else F.col("content")
    files = spark.read.format("binaryFile").load(path).select(
        F.regexp_replace(part, "^[^=]+=", "").alias("file"), F.sha2(content, 256).alias("actual"))
    return files.join(expected, "file", "left").withColumn("match", F.coalesce(F.col("actual") == F.col("sha256"), F.lit(False)))


def save_snapshot(states: DataFrame, root: str, version: int) -> str:
    """Write a snapshot as its own version folder. A reader takes the last one whose write has finished."""
    target = f"{root}/version={version:08d}"
    states.write.mode("errorifexists").parquet(target)
    return target


def load_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/version={version:08d}")


def append_audit(rows: DataFrame, root: str, table: str) -> None:
    if table not in AUDIT_ORDER:
        raise ValueError(f"unknown audit table: {table}")
    rows.write.mode("append").partitionBy("organization_id").parquet(f"{root}/{table}")


def read_audit(spark: SparkSession, root: str, table: str, organization_id: str) -> DataFrame:
    """Rows of one organisation (partition pruning) in the table's order."""
    rows = spark.read.parquet(f"{root}/{table}").filter(F.col("organization_id") == organization_id)
    return rows.orderBy(*[c for c in AUDIT_ORDER[table] if c in rows.columns])


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an older layout together with the current one; columns that were added later are null."""
    return new.unionByName(old, allowMissingColumns=True)


def list_trajectories(states: DataFrame, organization_id: str, workspace_id: str | None = None, person_id: str | None = None) -> DataFrame:
    rows = states.filter(F.col("organization_id") == organization_id)
    if workspace_id is not None:
        rows = rows.filter(F.col("workspace_id") == workspace_id)
    if person_id is not None:
        rows = rows.filter(F.col("person_id") == person_id)
    return rows.orderBy("created", "trajectory_id")


def person_listing(states: DataFrame) -> DataFrame:
    return states.select("trajectory_id", F.col("durable_goal").alias("goal"), "current_state", "lifecycle", "surfaces", "conversation_ids")


def list_corrections(corrections: DataFrame, organization_id: str) -> DataFrame:
    """Corrections of an organisation with the diagnosis parsed when present."""
    return corrections.filter(F.col("organization_id") == organization_id).withColumn(
        "diagnosis", F.from_json("diagnosis_json", "kind STRING, note STRING")).orderBy("created_at", "correction_id")


def save_features(rows: DataFrame, path: str) -> None:
    """Feature matrix sink: ``feature ARRAY<FLOAT>`` and ``label``."""
    rows.select("feature", "label").write.mode("errorifexists").parquet(path)
