"""Tables in the folder that all machines of a cluster share, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if it has at most this many rows; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of rows that go to a Python worker in one batch. Executors hold a batch of each task beside their heap, workers once more.
BATCH_BYTES = 4 << 20

_own_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset a temporary one, on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="quarry-")
    return _own_folders[app]


def durable(df: DataFrame, name: str = "table", **options) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lost executors can't lose it, and nothing above it runs twice. options: the writer's."""
    spark = df.sparkSession
    plain_unions(spark)
    path = f"{shared_folder(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_unions(spark: SparkSession) -> None:
    """Unions shall not count as partitioned by their parts' keys: parts whose partitions were coalesced differently can't be zipped."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def spread(df: DataFrame) -> DataFrame:
    """df in no more partitions than tasks can run at once: what each task hands on for every query does not grow with the table."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most about BATCH_BYTES at a time from now on; ten thousand rows, Spark's own limit, can be any size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def written(spark: SparkSession) -> list[str]:
    """The tables that durable() wrote for this application, oldest first."""
    return list(_written.get(spark.sparkContext.applicationId, ()))


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that durable() wrote, once nothing reads them any more."""
    known = _written.get(spark.sparkContext.applicationId, [])
    jvm = spark._jvm
    for p in paths:
        if p in known:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
            known.remove(p)


def numbered(df: DataFrame, order: str, column: str, first: int = 1) -> DataFrame:
    """df with numbers from `first` on in the order of a column, without one task that sees all rows: ranges are sorted and counted."""
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    placed = durable(placed.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    base, offsets = first, []
    for part, n in sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect()):  # a row for each partition
        offsets.append((part, base))
        base += n
    known = df.sparkSession.createDataFrame(offsets, "__part int, __base long")
    return placed.join(F.broadcast(known), "__part").withColumn(column, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


def at_hand(df: DataFrame, most: int) -> tuple[DataFrame, pa.Table] | None:
    """df as a table that the plan holds itself, and its rows, if these are at most so many; else None. df runs once, up to that many rows."""
    rows = df.limit(most + 1).toArrow()
    return None if rows.num_rows > most else (df.sparkSession.createDataFrame(rows), rows)


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows. It is counted first, so it should be cheap or durable."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
