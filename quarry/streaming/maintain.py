"""Index maintenance from a stream of file events.

Events are (event_id, ts, kind, path, new_path) with kind reindex, deindex or rename. Micro-batches are merged in foreachBatch: a batch's last
event for each path decides. State is a Parquet table of (path, ts, event_id, live) in buckets by path; deindexed paths stay in it as tombstones, so that an
older event that comes late doesn't revive them. A batch writes only the buckets it touches, to a new folder, so a batch that runs again gives the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import extension_of

STATE = "path string, ts timestamp, event_id long"


def classify(events: DataFrame, extensions: tuple[str, ...] = ("md",)) -> DataFrame:
    """One or two rows (path, ts, event_id, live) for each event; files that are not eligible count as deindexed.

    A rename of which both names are eligible moves, from an eligible to another name deindexes, the other way round indexes, else is ignored.
    """
    fits = lambda c: F.coalesce(extension_of(F.col(c)).isin(*extensions) & ~F.regexp_extract(c, r"([^/]*)$", 1).startswith("~$"), F.lit(False))
    old = events.where(fits("path")).select("path", "ts", "event_id", (F.col("kind") == "reindex").alias("live"))
    new = events.where((F.col("kind") == "rename") & fits("new_path")).select(F.col("new_path").alias("path"), "ts", "event_id", F.lit(True).alias("live"))
    return old.unionByName(new)


def last_events(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, ts, event_id, live): for each path the last by (ts, event_id) of the state and the changes; deindexed paths stay as tombstones."""
    newest = F.max_by(F.struct("ts", "event_id", "live"), F.struct("ts", "event_id", ~F.col("live")))
    return state.select(*_COLUMNS).unionByName(changes.select(*_COLUMNS)).groupBy("path").agg(newest.alias("e")).select("path", "e.ts", "e.event_id", "e.live")


def merge(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The live paths (path, ts, event_id) after changes. state: (path, ts, event_id), with tombstones if it has a column live."""
    known = state if "live" in state.columns else state.withColumn("live", F.lit(True))
    return last_events(known, changes).where("live").drop("live")


def batch_state(events: DataFrame, extensions: tuple[str, ...] = ("md",)) -> DataFrame:
    """What the stream's state is once all events were read."""
    return merge(events.sparkSession.createDataFrame([], STATE), classify(events, extensions))


#: Buckets of the state; a batch rewrites those of its paths, and every FULL-th batch all of them, so that older batches need not be read.
BUCKETS, FULL = 64, 32
_COLUMNS = ("path", "ts", "event_id", "live")
_STORED = "path string, ts timestamp, event_id long, live boolean, bucket int, version long"


def _stored(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """The rows of each bucket's newest version after a batch."""
    if number < 0:
        return spark.createDataFrame([], _STORED)
    rows = spark.read.schema(_STORED).parquet(*(f"{folder}/state-{k}" for k in range(number // FULL * FULL, number + 1)))
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"], "left_semi")


def maintain(events: DataFrame, folder: str, extensions: tuple[str, ...] = ("md",), trigger: dict | None = None):
    """Starts a query that keeps the state table under `folder`, a folder state-<n> for each batch."""
    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")
        changes = classify(batch, extensions)
        before = _stored(spark, folder, number - 1)
        if number % FULL:
            touched = [r[0] for r in changes.select(bucket).distinct().collect()]  # at most BUCKETS
            before = before.where(F.col("bucket").isin(touched)) if touched else before.limit(0)
        new = last_events(before, changes).select(*_COLUMNS, bucket.alias("bucket"), F.lit(number).cast("long").alias("version"))
        new.repartition("bucket").write.mode("overwrite").parquet(f"{folder}/state-{number}")

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def last_state(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """(path, ts, event_id) of the live paths after a batch."""
    return _stored(spark, folder, number).where("live").select("path", "ts", "event_id")


def drop_versions(spark: SparkSession, folder: str, number: int) -> None:
    """Deletes the folders that no batch after this one reads."""
    for k in range(number // FULL * FULL):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state-{k}")
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def debounced(events: DataFrame, gap: str = "500 milliseconds") -> DataFrame:
    """(path, first, last, events): bursts of a path's events no further apart than the gap."""
    w = F.session_window("ts", gap)
    return events.groupBy("path", w).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events")).drop("session_window")


def maintain_index(events: DataFrame, root: str, folder: str, checkpoint: str, extensions: tuple[str, ...] = ("md",), trigger: dict | None = None, **how):
    """Starts a query that keeps the index under folder up with the files under root: each batch brings the paths that it names to what they
    are on disk when it runs. how: as rebuild() takes it.

    An event only says where to look, so late, repeated and reordered events do no harm, and a batch that runs again after it was written
    finds nothing to do. A batch of more paths than are looked up one by one is a scan of the whole folder, whatever it names.
    """
    from quarry.sources.index import MOST_PATHS, rebuild

    spark = events.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        named = batch.select(F.explode(F.array("path", "new_path")).alias("path")).where("path is not null").distinct()
        paths = [r["path"] for r in named.limit(MOST_PATHS + 1).collect()]
        if paths:
            rebuild(spark, root, folder, extensions, only=paths if len(paths) <= MOST_PATHS else None, **how)

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()
