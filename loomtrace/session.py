"""Session helpers: builder for local use, tables in the shared checkpoint folder, partitioning helpers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def local_session(app: str = "loomtrace", cores: str = "*", shuffle_partitions: int = 8, checkpoint_dir: str | None = None) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.loomtrace.scan.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set (tests on one machine) it is a folder in the warehouse, which a cluster shares as well; it is then set
    as the context's checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """An unused path in the shared folder, for what a query writes through a sink and reads back."""
    return f"{shared_folder(spark)}/sinks/{uuid4().hex}"


def durable(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, so lost executors restart nothing before it, and computes ``df`` once (``checkpoint()`` would
    compute it twice unless it is cached). Worth it only for a step that is read more than once. ``release`` deletes it.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` has written and nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        root = f"{shared_folder(spark)}/tables/"
        for name in {f.split("/tables/")[1].split("/")[0] for f in table.inputFiles() if "/tables/" in f}:
            path = spark._jvm.org.apache.hadoop.fs.Path(root + name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Most rows of a table of few short columns that ``with_small`` broadcasts.
SMALL = 250_000


def with_small(rows: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join with a table that has a row per value of ``key``. Where the values are few, a join by shuffle would put all rows into as
    many tasks as there are values; the table is stored, counted, and broadcast if it is small enough."""
    held = durable(small)
    return rows.join(broadcast(held) if held.count() <= SMALL else held, key, how)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition by ``keys`` for work that costs far more time than its bytes suggest.

    The explicit number keeps adaptive execution from merging such partitions by size alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def by_key_balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Like ``by_key``, but cut by sampled key ranges: rows of a key stay together, and large keys do not share a partition
    by a chance of hashing. Sampling reads ``df`` once more, so store a costly ``df`` first (``durable``).
    """
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
