"""The history of evaluation runs: a table in versions, of which each holds the newest runs that a number and a budget of bytes allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.model import Corpus, SearchOptions
from quarry.operators.evaluation import Fingerprint, Run, evaluate, regressions
from quarry.sources.index import _file

# Runs that are kept, and bytes of a history.
RUNS, BYTES = 10, 64 << 20
SCHEMA = "run_id string, started string, fingerprint string, documents long, chunks long, content string, query_id long, metric string, k int, value double"


def history_versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the complete versions under folder, oldest first."""
    fs, p = _file(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[8:]) for n in names if n.startswith("history-") and fs.exists(_file(spark, f"{folder}/{n}/_SUCCESS")[1]))


def load_history(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each value of each run: of a query, or of all queries where query_id is null. Empty where nothing was recorded."""
    known = history_versions(spark, folder)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/history-{known[-1]:010d}") if known else spark.createDataFrame([], SCHEMA)


def run_rows(run: Run, fingerprint: Fingerprint, run_id: str, started: str) -> DataFrame:
    values = run.aggregate.select(F.lit(None).cast("long").alias("query_id"), "metric", "k", "value").unionByName(run.metrics.select("query_id", "metric", "k", "value"))
    head = run.snapshot.select(F.lit(run_id).alias("run_id"), F.lit(started).alias("started"), F.lit(fingerprint.digest()).alias("fingerprint"), "documents", "chunks", "content")
    return head.crossJoin(values).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")))  # one row of heads


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id", "started", "fingerprint").agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))).alias("bytes"))


def record_run(spark: SparkSession, folder: str, run: Run, fingerprint: Fingerprint, run_id: str, started: str, runs: int = RUNS, budget: int = BYTES) -> DataFrame | None:
    """Puts a run in front of the history, and returns the regressions against the run before it; None if there is none of the same fingerprint.

    Only the last run is compared with, so that a change of settings never hides behind an older run. The newest runs stay, at most `runs` of
    them and as many as have at most `budget` bytes as JSON; a run that is over the budget alone is a ValueError and leaves the history as it was.
    """
    before, rows = load_history(spark, folder), run_rows(run, fingerprint, run_id, started)
    own = _sizes(rows).first()["bytes"]
    if own > budget:
        raise ValueError(f"the run has {own} bytes, the history at most {budget}: ask fewer queries or keep fewer values of k")
    known = _sizes(before.where(F.col("run_id") != run_id)).orderBy(F.desc("started"), F.desc("run_id")).limit(max(runs - 1, 0)).collect()  # a row for each run that may stay
    last = _sizes(before).orderBy(F.desc("started"), F.desc("run_id")).limit(1).collect()
    kept, total = [], own
    for r in known:
        total += r["bytes"]
        if total > budget:
            break
        kept.append(r["run_id"])
    versions = history_versions(spark, folder)
    number = (versions or [0])[-1] + 1
    rows.unionByName(before.where(F.col("run_id").isin(kept))).coalesce(1).write.mode("overwrite").parquet(f"{folder}/history-{number:010d}")  # at most `budget` bytes
    for old in versions[:-1]:  # the last one may still be read
        fs, p = _file(spark, f"{folder}/history-{old:010d}")
        fs.delete(p, True)
    if not last or last[0]["run_id"] == run_id or last[0]["fingerprint"] != fingerprint.digest():
        return None
    return regressions(run.aggregate, before.where((F.col("run_id") == last[0]["run_id"]) & F.col("query_id").isNull()).select("metric", "k", "value"))


def evaluate_and_record(corpus: Corpus, golden: DataFrame, folder: str, fingerprint: Fingerprint, run_id: str, started: str, options: SearchOptions | None = None, ks: tuple[int, ...] = (1, 5, 10)) -> tuple[Run, DataFrame | None]:
    """evaluate(), recorded: the run, and its regressions against the run before it if that one is comparable."""
    run = evaluate(corpus, golden, options, ks)
    return run, record_run(corpus.chunks.sparkSession, folder, run, fingerprint, run_id, started)
