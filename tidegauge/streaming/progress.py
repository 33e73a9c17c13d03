"""Live observability: what the queries of a session report of their batches, kept as a table.

A listener appends progress events as JSON lines; ``operators.health`` reads them back as lag, progress
and rollups.  Counts of a stream's rows (errors, anomalies) are observed metrics, computed while the rows
pass, so that telemetry costs no second pass.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidegauge.operators.health import parse_progress, progress_table

OBSERVED = "telemetry"


def observed(df: DataFrame, **counts: Column) -> DataFrame:
    """``df`` whose every batch reports its rows and, by name, how many of them a condition holds for."""
    return df.observe(OBSERVED, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counts.items()])


class ProgressLog(StreamingQueryListener):
    """Appends progress events to ``path``: ``every`` at a time, and all when a query ends or ``flush`` is called.

    Only queries in ``names`` are kept, if given.  A session that is lost loses the events not yet
    written, fewer than ``every``; the batches themselves are in the queries' checkpoints.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20, names: set[str] | None = None) -> None:
        self._spark, self._path, self._every, self._names = spark, path, every, names
        self._waiting: list[str] = []
        self._lock = threading.Lock()
        self._runs: dict[str, str | None] = {}
        self._ended: dict[str | None, threading.Event] = {}

    def _end_of(self, name: str | None) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(name, threading.Event())

    def wait(self, name: str | None, seconds: float) -> bool:
        """Whether the events of a query that has ended are all written: they arrive a little after its end."""
        return self._end_of(name).wait(seconds)

    def onQueryStarted(self, event) -> None:
        self._runs[str(event.runId)] = event.name

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self._names is not None and event.progress.name not in self._names:
            return
        with self._lock:
            self._waiting.append(event.progress.json)
            full = len(self._waiting) >= self._every
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()
        self._end_of(self._runs.pop(str(event.runId), None)).set()

    def flush(self) -> None:
        with self._lock:
            lines, self._waiting = self._waiting, []
            if lines:
                self._spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("append").text(self._path)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress events of a folder, one row a query, run and batch: a batch that ran again counts once, as its last report says."""
    lines = spark.read.schema("value string").text(path)
    parsed = parse_progress(lines, "value")
    last = parsed.groupBy("name", "id", "batchId").agg(F.max_by(F.struct(*parsed.columns), "timestamp").alias("p"))
    return last.select("p.*")


def batches(progress: DataFrame, anomalies: str = "anomalies") -> DataFrame:
    """Batches as ``health.batch_rollup`` takes them; anomalies are an observed count, 0 where none is reported."""
    table = progress_table(progress)
    found = progress.select("name", "batchId", F.coalesce(F.col("observedMetrics")[OBSERVED][anomalies], F.lit(0)).cast("bigint").alias("anomalies"))
    # batches without input (they only close windows) are no work of the source
    rows = table.filter(F.col("numInputRows") > 0).join(found, (table["name"].eqNullSafe(found["name"])) & (table["batchId"] == found["batchId"])).drop(found["name"]).drop(found["batchId"])
    return rows.select(F.col("name").alias("query"), "ts", F.col("numInputRows").alias("rows"), "anomalies", F.col("trigger_ms").alias("duration_ms"))
