"""A log of runs that survives retries: parameters, metrics by batch, status and artifacts.

Everything a run writes goes to a folder of its own name (run, and batch or status), which a repeated write replaces. A micro-batch that
Spark repeats after a failure therefore adds nothing, and neither does a driver that is started again with the run's id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUS = "run_id string, status string, step int, at timestamp, params map<string,string>, tags map<string,string>, error string"
METRICS = "run_id string, batch long, name string, value double"
STEPS = {"RUNNING": 0, "FINISHED": 1, "FAILED": 1}


def named(run_id: str) -> str:
    """A run's id as a folder's name."""
    if not run_id or set(run_id) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_."):
        raise ValueError(f"{run_id!r} is no run id: letters, digits, - _ and . only")
    return run_id


class RunLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _put(self, rows: DataFrame, *where: str) -> None:
        rows.write.mode("overwrite").parquet("/".join([self.path, *where]))

    def _read(self, kind: str, schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
        try:
            return reader.parquet(f"{self.path}/{kind}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def mark(self, run_id: str, status: str, params: dict | None = None, tags: dict | None = None, error: str | None = None) -> None:
        text = lambda d: {k: str(v) for k, v in (d or {}).items()}
        row = self.spark.createDataFrame([(named(run_id), status, STEPS[status], text(params), text(tags), error)], STATUS.replace("at timestamp, ", ""))
        self._put(row.withColumn("at", F.current_timestamp()).select(*[f.split()[0] for f in STATUS.split(", ")]).coalesce(1), "status", run_id, str(STEPS[status]))

    def log(self, run_id: str, batch: int, metrics: DataFrame) -> None:
        """One batch's metrics: every number of a table of one row, or a table of name and value."""
        if set(metrics.columns) != {"name", "value"}:
            pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value")) for c in metrics.columns])
            metrics = metrics.select(F.explode(pairs).alias("m")).select("m.*")
        rows = metrics.select(F.lit(named(run_id)).alias("run_id"), F.lit(batch).cast("long").alias("batch"), F.col("name").cast("string"), F.col("value").cast("double"))
        self._put(rows.coalesce(1), "metrics", run_id, str(batch))

    def keep(self, run_id: str, name: str, table: DataFrame) -> None:
        """An artifact: a table of any size under the run's name."""
        self._put(table, "artifacts", named(run_id), named(name))

    def artifact(self, run_id: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/artifacts/{named(run_id)}/{named(name)}")

    def sink(self, run_id: str, measure: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For writeStream.foreachBatch: measure() of each micro-batch under its number."""
        return lambda rows, batch: self.log(run_id, batch, measure(rows))

    @contextmanager
    def run(self, run_id: str, params: dict | None = None, tags: dict | None = None) -> Iterator[RunLog]:
        """RUNNING until the block ends: FINISHED, or FAILED with the error, which goes on."""
        self.mark(run_id, "RUNNING", params, tags)
        try:
            yield self
        except BaseException as e:
            self.mark(run_id, "FAILED", params, tags, f"{type(e).__name__}: {e}"[:2000])
            raise
        self.mark(run_id, "FINISHED", params, tags)

    def runs(self) -> DataFrame:
        """run_id, status, at, params, tags, error and metrics (a map with each metric's value of the last batch that has it)."""
        last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("step"), F.desc("at")))
        status = self._read("status", STATUS).withColumn("_r", last).where("_r = 1").drop("_r", "step")
        latest = self._read("metrics", METRICS).groupBy("run_id", "name").agg(F.max_by("value", "batch").alias("value"))
        metrics = latest.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metrics"))
        return status.join(metrics, "run_id", "left")

    def history(self, name: str) -> DataFrame:
        """run_id, batch, value of one metric."""
        return self._read("metrics", METRICS).where(F.col("name") == name).select("run_id", "batch", "value")
