"""Streams that keep their state by key in the state store: nothing of earlier batches is read again.

``trajectory_state`` holds one value of fixed size for each trajectory, ``idempotent`` the payload digest of each event id. Both take the
rows of a key in order within a batch; a batch is as large as the source's trigger makes it. Keys are dealt to cells (``pages``), as a call to
the store for each key costs far more than the key's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from loomtrace.functions.canonical import metadata_fingerprint
from loomtrace.operators import ingest, signals
from loomtrace.session import durable, new_folder, release
from loomtrace.streaming.pages import Pages, cell

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds after the last update at which the state of a key is dropped; 0 keeps it.
KEEP_FOREVER = 0

_COUNTS = ["event_count", "human_events", "agent_events", "tool_events", "conversation_count", "agent_count", "agent_handoffs",
           "duplicate_tool_calls", "cross_agent_duplicate_actions", "tool_switches", "tool_failures", "consecutive_tool_failures",
           "recovery_count", *signals.BEHAVIOUR_COUNTERS]
_FACTS = {"last_agent_id": "string", "has_agent": "boolean", "agent_raw": "string", "last_outcome": "string", "has_tool": "boolean",
          "last_tool_name": "string", "tool_fp": "string", "tool_has_agent": "boolean", "tool_agent": "string", "last_behavior": "string",
          "behavior_confidence": "double"}
_VALUE = ", ".join([*(f"{c} bigint" for c in _COUNTS), *(f"{c} {t}" for c, t in _FACTS.items())])
_NAMES = [*_COUNTS, *_FACTS]
_PRIMITIVES = {p: n for n, p in signals.BEHAVIOUR_COUNTERS.items()}
_EVENT = ("conversation_id", "actor_type", "actor_id", "tool_name", "status", "fp", "behaves", "primitive", "confidence")
#: Columns of a state row, as ``signals.state`` gives them.
STATE = ("trajectory_id string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", unresolved boolean, recovered boolean, last_agent_id string, "
         "last_tool_name string, last_behavior string, behavior_confidence double")


def _none(value):
    """Pandas' ways to say null as ``None``."""
    return None if value is None or value != value else value


def in_order(rows: Iterator[pd.DataFrame], *more: str) -> list[tuple]:
    """The columns ``more`` and ``_EVENT`` of a batch's rows by time."""
    batch = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "seq"], kind="stable")
    return list(zip(*([_none(x) for x in batch[c].tolist()] for c in (*more, *_EVENT)), strict=True))


def _frame(states: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(states).astype({c: "object" for c in ("trajectory_id", "last_agent_id", "last_tool_name", "last_behavior")})


class TrajectoryCounters(StatefulProcessor):
    """Counters and last facts of a trajectory; which conversations and agents it has met is kept entry by entry in the store."""

    def __init__(self, ttl_ms: int = KEEP_FOREVER):
        self.ttl_ms = ttl_ms or None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", _VALUE, self.ttl_ms)
        self.met = handle.getMapState("met", "kind string, id string", "n int", self.ttl_ms)

    def _first(self, kind: str, name: str | None) -> int:
        if not name or self.met.containsKey((kind, name)):
            return 0
        self.met.updateValue((kind, name), (1,))
        return 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield _frame([self._after(key[0], in_order(rows))])

    def _after(self, trajectory: str | None, events: list[tuple]) -> dict:
        """The state row after ``events`` (``_EVENT``), which follow each other in time."""
        met: set[tuple] = set()  # conversations and agents looked up in this batch
        held = self.value.get()
        s = dict(zip(_NAMES, held, strict=True)) if held is not None else {**dict.fromkeys(_COUNTS, 0), **dict.fromkeys(_FACTS), "behavior_confidence": 0.0}
        for conversation, actor, actor_id, tool, status, fp, behaves, primitive, confidence in events:
            if ("c", conversation) not in met:
                met.add(("c", conversation))
                s["conversation_count"] += self._first("c", conversation)
            s["event_count"] += 1
            if actor in ("human", "agent", "tool"):
                s[f"{actor}_events"] += 1
            if actor == "agent":
                if actor_id:
                    if ("a", actor_id) not in met:
                        met.add(("a", actor_id))
                        s["agent_count"] += self._first("a", actor_id)
                    s["agent_handoffs"] += s["last_agent_id"] is not None and s["last_agent_id"] != actor_id
                    s["last_agent_id"] = actor_id
                s["has_agent"], s["agent_raw"] = True, actor_id
            elif actor == "tool":
                if s["has_tool"]:
                    if s["last_tool_name"] == tool and s["tool_fp"] == fp:
                        s["duplicate_tool_calls"] += 1
                        s["cross_agent_duplicate_actions"] += bool(s["tool_has_agent"] and s["has_agent"] and s["tool_agent"] != s["agent_raw"])
                    s["tool_switches"] += bool(tool and s["last_tool_name"] and tool != s["last_tool_name"])
                s["has_tool"], s["last_tool_name"], s["tool_fp"], s["tool_has_agent"], s["tool_agent"] = True, tool, fp, s["has_agent"], s["agent_raw"]
                if status == "failed":
                    s["tool_failures"] += 1
                    s["consecutive_tool_failures"] += 1
                elif status == "success":
                    s["recovery_count"] += s["last_outcome"] == "failed"
                    s["consecutive_tool_failures"] = 0
                if status in ("failed", "success"):
                    s["last_outcome"] = status
            if behaves:
                s["last_behavior"], s["behavior_confidence"] = primitive, float(confidence)
                if primitive in _PRIMITIVES:
                    s[_PRIMITIVES[primitive]] += 1
        self.value.update(tuple(int(s[c]) for c in _COUNTS) + tuple(s[c] for c in _FACTS))
        return {"trajectory_id": trajectory, **{c: int(s[c]) for c in _COUNTS}, "unresolved": s["last_outcome"] == "failed",
                "recovered": s["last_outcome"] == "success" and s["tool_failures"] > 0, "last_agent_id": s["last_agent_id"],
                "last_tool_name": s["last_tool_name"], "last_behavior": s["last_behavior"], "behavior_confidence": s["behavior_confidence"]}

    def close(self) -> None:
        pass


class CellsOfTrajectories(TrajectoryCounters):
    """``TrajectoryCounters`` for all trajectories of a cell, their state in its pages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = Pages(handle, self.ttl_ms)
        super().init(self.pages)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        by: dict[str | None, list[tuple]] = {}
        for trajectory, *event in in_order(rows, "trajectory_id"):
            by.setdefault(trajectory, []).append(event)
        self.pages.open(timerValues)
        out = []
        for trajectory, events in by.items():
            self.pages.key = (trajectory,)
            out.append(self._after(trajectory, events))
        self.pages.close()
        yield _frame(out)


def trajectory_state(events: DataFrame, ttl_ms: int = KEEP_FOREVER) -> DataFrame:
    """A stream of state rows (``signals.state``) for a stream of trace events whose batches follow each other in time: in each batch one
    row for every trajectory that it touches. ``ttl_ms`` drops trajectories that have been silent so long."""
    behaviour = signals.behaviour()
    slim = events.select("trajectory_id", "ts", "seq", "conversation_id", "actor_type", "actor_id", "tool_name", "status",
                         metadata_fingerprint(F.col("metadata_json")).alias("fp"), behaviour.isNotNull().alias("behaves"),
                         behaviour["primitive"].alias("primitive"), F.coalesce(behaviour["confidence"], F.lit(0.0)).alias("confidence"))
    return slim.withColumn("cell", cell("trajectory_id")).groupBy("cell").transformWithStateInPandas(
        CellsOfTrajectories(ttl_ms), STATE, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")


class Deliveries(StatefulProcessor):
    """The digest of the payload that an event id was accepted with, its first delivery and the number of them; the same for each other
    digest, entry by entry. Most ids have one payload, so a batch asks the store for one value of an id and puts one back."""

    def __init__(self, names: list[str], ttl_ms: int = KEEP_FOREVER):
        self.digest, self.seq, self.ttl_ms = names.index("payload_hash"), names.index("ingest_seq"), ttl_ms or None
        self.names = [*names, "first_seq", "deliveries", "status", "is_new"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        facts = "first_seq bigint, deliveries bigint"
        self.accepted = handle.getValueState("accepted", f"payload_hash string, {facts}", self.ttl_ms)
        self.others = handle.getMapState("others", "payload_hash string", facts, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        firsts: dict[str, list] = {}
        for row in rows:
            self._note(firsts, row)
        yield from (Row(*self.names)(*out) for out in self._settled(firsts))

    def _note(self, firsts: dict[str, list], row: tuple) -> None:
        """Per digest the first row and the count: copies cost nothing."""
        old = firsts.setdefault(row[self.digest], [row, 0])
        old[1] += 1
        if row[self.seq] < old[0][self.seq]:
            old[0] = row

    def _settled(self, firsts: dict[str, list]) -> Iterator[tuple]:
        held, touched = self.accepted.get(), False
        for digest, (row, n) in sorted(firsts.items(), key=lambda x: (x[1][0][self.seq], x[0])):
            new = held is None
            if new or digest == held[0]:
                first, count = (row[self.seq], n) if new else (held[1], held[2] + n)
                held, touched, status = (digest, first, count), True, "accepted"
            else:
                first, before = self.others.getValue((digest,)) or (row[self.seq], 0)
                count, status = before + n, "conflict"
                self.others.updateValue((digest,), (first, count))
            yield (*row, first, count, status, new)
        if touched:
            self.accepted.update(held)

    def close(self) -> None:
        pass


class CellsOfDeliveries(Deliveries):
    """``Deliveries`` for all event ids of a cell, their state in its pages. Rows come and go as strings; the sequence number is a string too."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = Pages(handle, self.ttl_ms)
        super().init(self.pages)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.names[:-4]
        by: dict[tuple, dict[str, list]] = {}
        for batch in rows:
            columns = [[_none(x) for x in batch.iloc[:, i - len(names)].tolist()] for i in range(len(names))]  # tuples of rows rename some columns
            columns[self.seq] = [x if x is None else int(x) for x in columns[self.seq]]
            for org, event, row in zip(columns[names.index("organization_id")], columns[names.index("event_id")], zip(*columns, strict=True), strict=True):
                self._note(by.setdefault((org, event), {}), row)
        self.pages.open(timerValues)
        out = []
        for self.pages.key, firsts in by.items():
            out += self._settled(firsts)
        self.pages.close()
        yield pd.DataFrame(out, columns=self.names, dtype=object)


#: Makes JSON that reads back as it was.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def idempotent(events: DataFrame, ttl_ms: int = KEEP_FOREVER) -> DataFrame:
    """A stream of canonical events with ``payload_hash``, ``first_seq, deliveries, status`` so far and ``is_new``: one row per event id and
    payload that a batch delivers. The first delivery of an id wins, and of deliveries with one sequence number the smaller digest;
    ``is_new`` marks the row with which it was accepted."""
    hashed = events.withColumn("payload_hash", ingest.payload_hash())
    texts = [f.name for f in hashed.schema.fields if f.dataType.typeName() == "string"]
    rest = [f.name for f in hashed.schema.fields if f.name not in (*texts, "ingest_seq")]
    packed = hashed.select(cell("organization_id", "event_id").alias("cell"), *texts, F.col("ingest_seq").cast("string"),
                           F.to_json(F.struct(*rest), _EXACT).alias("other_columns") if rest else F.lit(None).cast("string").alias("other_columns"))
    schema = ", ".join(f"`{c}` string" for c in [*texts, "other_columns"]) + ", ingest_seq bigint"
    names = [c for c in packed.columns if c != "cell"]
    out = packed.groupBy("cell").transformWithStateInPandas(
        CellsOfDeliveries(names, ttl_ms), f"{schema}, first_seq bigint, deliveries bigint, status string, is_new boolean",
        outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None")
    of = StructType([f for f in hashed.schema.fields if f.name in rest])
    read = F.from_json("other_columns", of, _EXACT)
    return out.withColumn("other_columns", read).select(*(F.col("other_columns")[c].alias(c) if c in rest else F.col(c).cast(hashed.schema[c].dataType).alias(c) for c in hashed.columns),
                                                "first_seq", "deliveries", "status", "is_new")


class LateSink:
    """Writes each batch, with accepted events flagged as late against the latest time of their organisation in the batch or before it.

    Of what was there before only the last batch's table of latest times is read, one row per organisation. A batch that is retried
    replaces its folders.
    """

    LATEST = "organization_id string, latest timestamp"

    def __init__(self, root: str):
        self.root = root

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"{self.root}/deliveries/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)  # the state is computed once, everything below reads it
        rows = spark.read.schema(batch.schema).parquet(folder)
        before = spark.read.schema(self.LATEST).parquet(f"{self.root}/latest/batch={batch_id - 1}") if batch_id else spark.createDataFrame([], self.LATEST)
        occurred = F.try_to_timestamp("occurred_at")
        new = rows.filter("is_new")
        flagged = ingest.late_flags(new).join(before.withColumnRenamed("latest", "before"), "organization_id", "left")
        late = F.col("late_event") | F.coalesce(occurred < F.col("before"), F.lit(False))
        flagged.withColumns(dict.fromkeys(("late_event", "history_disordered", "recompute_recommended"), late)).drop("before").write.mode("overwrite").parquet(
            f"{self.root}/accepted/batch={batch_id}")
        here = new.select("organization_id", occurred.alias("latest")).filter("latest IS NOT NULL")
        here.union(before).groupBy("organization_id").agg(F.max("latest").alias("latest")).write.mode("overwrite").parquet(f"{self.root}/latest/batch={batch_id}")

    def deliveries(self, spark: SparkSession) -> DataFrame:
        """Per event id and payload what is known after the last batch."""
        rows = spark.read.parquet(f"{self.root}/deliveries")
        keys = ["organization_id", "event_id", "payload_hash"]
        return rows.groupBy(*keys).agg(F.max_by(F.struct("first_seq", "deliveries", "status"), "batch").alias("x")).select(*keys, "x.*")

    def accepted(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/accepted").drop("batch")


class LatestSink:
    """Writes each batch; reading gives the last row of each key."""

    def __init__(self, root: str, key: str):
        self.root, self.key = root, key

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(f"{self.root}/rows")
        rest = [c for c in rows.columns if c not in (self.key, "batch")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(self.key, "x.*")


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the caller's session is left as it is."""
    session = spark.newSession()
    for name in ("spark.checkpoint.dir", "spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if (value := spark.conf.get(name, None)) is not None and spark.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # with a time to live they would never end
    return session


def replay(rows: DataFrame, order: str, key: list[str], batches: int, root: str) -> None:
    """Write a table as the files of a stream: ``batches`` appends in ranges of ``order``, and all rows of a key in one file of each.

    The borders are quantiles, so batches are about equally large; what ties at a border stays together.
    """
    held = durable(rows)  # each part below reads it again
    borders = held.stat.approxQuantile(order, [i / batches for i in range(1, batches)], 0.001)
    edges = [None, *sorted(set(borders)), None]
    for low, high in zip(edges, edges[1:]):
        part = held.filter((F.lit(True) if low is None else F.col(order) > low) & (F.lit(True) if high is None else F.col(order) <= high))
        part.repartition(*key).write.mode("append").parquet(root)
    release(held)


def run_all(stream: DataFrame, sink, root: str) -> None:
    """Process what the source has, batch by batch, and stop."""
    query = stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def replayed(spark: SparkSession, rows: DataFrame, order: str, key: list[str], batches: int = 4) -> tuple[DataFrame, str]:
    """``rows`` as a stream of about ``batches`` micro-batches in a session with RocksDB state, and its folder."""
    root = new_folder(spark)
    replay(rows, order, key, batches, f"{root}/source")
    files = spark.read.parquet(f"{root}/source").inputFiles()
    stream = stateful_session(spark).readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(f"{root}/source")
    return stream, root
