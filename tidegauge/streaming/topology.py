"""Streams: sinks, keyed upserts, retention, and the queries that make metrics and anomalies live.

Metrics run in update mode for dashboards and once more in append mode for detection: append emits a
window once, when the watermark has passed it, so what is scored is closed and scored once.  A sink
that fails stops its query; the query starts again from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators import metrics as M
from tidegauge.operators.enrich import enrich
from tidegauge.sources.events import parse_events
from tidegauge.streaming import chained as C

WATERMARK = "2 minutes"
TECHNICAL = ("kafka_ts", "kafka_partition", "kafka_offset", "status_class", "is_client_error", "apdex_weight", "ingest_latency_ms", "is_slow")
PAYLOAD = ("event_id", "event_time", "service", "region", "host", "ip", "method", "path", "endpoint", "status", "status_class", "bytes_sent", "response_time_ms", "upstream_time_ms", "user_agent", "user_id", "session_id", "country", "country_name", "city", "lat", "lon", "asn", "org", "device", "browser", "os", "is_bot", "is_error", "cache_status", "attack_label")
#: Keys of each table, and days for which its rows are kept.
KEYS = {
    "metrics_global": ["window_start"], "metrics_endpoint": ["window_start", "endpoint", "method"], "metrics_ip": ["window_start", "ip"], "metrics_status": ["window_start", "status_class"],
    "metrics_geo": ["window_start", "country"], "metrics_service": ["window_start", "service"], "sessions": ["session_id", "session_start"], "anomalies": ["anomaly_id"],
}
RETENTION_DAYS = {"metrics_global": 14, "metrics_endpoint": 14, "metrics_ip": 14, "metrics_status": 14, "metrics_geo": 14, "metrics_service": 14, "anomalies": 14, "alerts": 14, "incidents": 14, "sessions": 2, "raw": 1}
TIMES = {"sessions": "session_start", "alerts": "fired_at", "incidents": "last_seen_at", "raw": "event_time"}


def live_events(raw: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return enrich(parse_events(raw)).withWatermark("event_time", watermark)


def sanitize(df: DataFrame) -> DataFrame:
    """Not-a-number and infinite values become null, in columns and in arrays of numbers."""
    real = (T.DoubleType, T.FloatType)

    def clean(x: Column) -> Column:
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)

    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, real):
            out[f.name] = clean(F.col(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, real):
            out[f.name] = F.transform(f.name, clean)
        elif isinstance(f.dataType, T.MapType) and isinstance(f.dataType.valueType, real):
            out[f.name] = F.transform_values(f.name, lambda k, v: clean(v))
    return df.withColumns(out) if out else df


def latest_by_key(updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    if order is None:
        return updates.dropDuplicates(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return updates.withColumn("_n", rank).filter("_n = 1").drop("_n")


def merge(existing: DataFrame, updates: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``existing`` with the latest update of each key; columns that an update lacks, or has null, are kept."""
    new = latest_by_key(updates, keys, order)
    names = existing.columns + [c for c in new.columns if c not in existing.columns]
    a, b = existing.alias("a"), new.alias("b")
    joined = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]), "full_outer")

    def pick(c: str) -> Column:
        sides = [F.col(f"{t}.{c}") for t, cols in (("b", new.columns), ("a", existing.columns)) if c in cols]
        return F.coalesce(*sides).alias(c)

    return joined.select(*[pick(c) for c in names])


def _materialized(df: DataFrame) -> DataFrame:
    """``df`` from files in the shared checkpoint folder: the dates that it was read from are about to be
    overwritten, so nothing may be computed from them again, whatever executors are lost."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("upserts need spark.checkpoint.dir, a folder that all executors share")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def upsert(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], time: str = "window_start", order: str | None = None) -> None:
    """Idempotent keyed write to a table partitioned by date and hour; only the hours of the updates are read and rewritten.

    ``time`` is one of the keys, so a key never changes its hour.  Rows without a time are kept in a part of their own.
    """
    dated = updates.withColumns({"date": F.to_date(time), "hour": F.hour(time)}).persist()
    try:
        touched: dict = {}  # one entry an hour of the batch
        for day, hour in dated.select("date", "hour").distinct().collect():
            touched.setdefault(day, []).append(hour)
        if not touched:
            return
        parts = [F.col("date").isNull() if day is None else (F.col("date") == F.lit(day)) & F.col("hour").isin(hours) for day, hours in touched.items()]
        try:
            old = spark.read.parquet(path).filter(reduce(lambda a, b: a | b, parts))
        except Exception as e:  # a table that isn't there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            merged = latest_by_key(dated, keys, order)
        else:
            merged = merge(old, dated, keys, order)
        merged = _materialized(merged)
        # one file an hour, several of a large one
        merged.hint("rebalance", "date", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "hour").parquet(path)
    finally:
        dated.unpersist()


def raw_events(events: DataFrame) -> DataFrame:
    """What the raw table keeps of an event, once an id: within the watermark on a stream."""
    kept = events.drop(*[c for c in TECHNICAL if c in events.columns]).withColumn("ingested_at", F.current_timestamp()).withColumn("date", F.to_date("event_time"))
    return kept.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else kept.dropDuplicates(["event_id"])


def write_raw(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return raw_events(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("date").outputMode("append").trigger(**trigger or {"processingTime": "5 seconds"}).start()


def enriched_payload(events: DataFrame) -> DataFrame:
    """(key, value): the address and the event as JSON, as a message sink takes them."""
    return events.select(F.col("ip").alias("key"), F.to_json(F.struct(*[c for c in PAYLOAD if c in events.columns])).alias("value"))


def anomaly_payload(anomalies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value) messages of anomalies, and their number by severity."""
    return anomalies.select(F.col("entity").alias("key"), F.to_json(F.struct("*")).alias("value")), anomalies.groupBy("severity").agg(F.count("*").alias("n"))


def apply_retention(df: DataFrame, table: str, now) -> DataFrame:
    """Rows that are young enough; incidents also while they aren't resolved."""
    time = TIMES.get(table, "window_start")
    young = F.col(time) >= F.lit(now).cast("timestamp") - F.expr(f"interval {RETENTION_DAYS[table]} days")
    return df.filter(young | (F.col("status") != "resolved")) if table == "incidents" else df.filter(young)


#: Families that are emitted once, when their window or session is closed: update mode doesn't take them.
APPEND_ONLY = ("metrics_ip", "metrics_status", "concentration", "sessions")


def families(events: DataFrame, metric_window: str = "1 minute", geo_window: str = "5 minutes", gap: str = "15 minutes") -> dict[str, DataFrame]:
    """The streaming forms of the metric families: one aggregation each, or a chain of them (``APPEND_ONLY``)."""
    return {
        "metrics_global": M.global_metrics(events, metric_window),
        "metrics_endpoint": M.endpoint_metrics(events, metric_window),
        "ip_endpoint": M.ip_endpoint_metrics(events, metric_window),
        "metrics_geo": M.geo_metrics(events, geo_window),
        "metrics_service": M.service_metrics(events, metric_window),
        "metrics_ip": C.ip_metrics(events, metric_window),
        "metrics_status": C.status_metrics(events, metric_window),
        "concentration": C.concentration(events, metric_window),
        "sessions": M.session_metrics(events, gap),
    }


def start_family(df: DataFrame, name: str, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", **trigger) -> StreamingQuery:
    return df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(**trigger or {"processingTime": "10 seconds"}).start()


def detection_sink(spark: SparkSession, history_path: str, anomalies_path: str, analyze: Callable[[DataFrame], DataFrame], keys: list[str], lookback: str = "3 days") -> Callable[[DataFrame, int], None]:
    """A sink for closed windows: joins them to the stored history, scores them, and writes both.

    History is read back only as far as the lookback reaches.  Windows of this batch alone are
    reported; anomalies are written by id, so a repeated batch changes nothing.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        upsert(spark, history_path, batch, keys)
        low = batch.agg(F.min("window_start")).first()[0]
        rows = spark.read.parquet(history_path)
        span = F.lit(low) - F.expr(f"interval {lookback}")
        recent = rows.filter((F.col("window_start") >= span) & (F.col("date") >= span.cast("date"))).drop("date", "hour")
        found = analyze(recent).join(batch.select("window_start").distinct(), "window_start", "left_semi")
        upsert(spark, anomalies_path, found, ["anomaly_id"])

    return process
