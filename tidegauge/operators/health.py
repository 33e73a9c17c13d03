"""Pipeline observability over streaming progress, batch telemetry and health samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSETS = "map<string,map<string,bigint>>"
PROGRESS = (
    "struct<id:string,name:string,batchId:bigint,timestamp:string,numInputRows:bigint,inputRowsPerSecond:double,processedRowsPerSecond:double,"
    "durationMs:map<string,bigint>,observedMetrics:map<string,map<string,double>>,stateOperators:array<struct<numRowsTotal:bigint,memoryUsedBytes:bigint>>,sources:array<struct<description:string,endOffset:string,latestOffset:string>>>"
)


def parse_progress(raw: DataFrame, column: str = "json") -> DataFrame:
    """Progress events of streaming queries (their JSON) as rows."""
    return raw.select(F.from_json(column, PROGRESS).alias("p")).select("p.*")


def source_lag(progress: DataFrame) -> DataFrame:
    """Offsets between the end of a batch and the latest, by query and topic."""
    sources = progress.select("name", "batchId", F.explode("sources").alias("s"))
    read = sources.select("name", "batchId", F.from_json("s.endOffset", OFFSETS).alias("end"), F.from_json("s.latestOffset", OFFSETS).alias("latest"))
    topics = read.select("name", "batchId", "end", F.explode("latest").alias("topic", "parts"))
    parts = topics.select("name", "batchId", "topic", F.col("end")[F.col("topic")].alias("ends"), F.explode("parts").alias("partition", "latest"))
    behind = F.greatest(F.col("latest") - F.coalesce(F.try_element_at("ends", F.col("partition")), F.lit(0)), F.lit(0))
    return parts.groupBy("name", "batchId", "topic").agg(F.sum(behind).alias("lag"))


def progress_table(progress: DataFrame) -> DataFrame:
    rows = F.aggregate(F.coalesce("stateOperators", F.array().cast("array<struct<numRowsTotal:bigint,memoryUsedBytes:bigint>>")), F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s["numRowsTotal"], F.lit(0)))
    return progress.select("name", "batchId", F.try_to_timestamp("timestamp").alias("ts"), "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", F.try_element_at("durationMs", F.lit("triggerExecution")).alias("trigger_ms"), rows.alias("state_rows"))


def batch_rollup(batches: DataFrame, now, minutes: int = 15) -> tuple[DataFrame, DataFrame]:
    """Batches of the last minutes by query, and by minute."""
    recent = batches.filter(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"interval {minutes} minutes"))
    by_query = recent.groupBy("query").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.sum("anomalies").alias("anomalies"), F.round(F.avg("duration_ms"), 1).alias("avg_duration_ms"), F.max("duration_ms").alias("max_duration_ms"))
    by_minute = recent.groupBy(F.window("ts", "1 minute")["start"].alias("t")).agg(F.sum("rows").alias("rows"), F.round(F.avg("duration_ms"), 1).alias("duration_ms"))
    return by_query, by_minute


def freshness(global_rows: DataFrame, now) -> DataFrame:
    """Age of the newest window."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("window_start"))
    out = global_rows.agg(F.max("window_start").alias("newest"), age.alias("age_seconds"))
    return out.withColumn("status", F.when(F.col("age_seconds").isNull(), "stalled").when(F.col("age_seconds") < 180, "healthy").when(F.col("age_seconds") < 600, "degraded").otherwise("stalled"))


def throughput(global_rows: DataFrame, now, minutes: int = 5) -> DataFrame:
    recent = global_rows.filter((F.col("window_start") > F.lit(now).cast("timestamp") - F.expr(f"interval {minutes} minutes")) & (F.col("window_start") <= F.lit(now).cast("timestamp")))
    return recent.agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.count("*").alias("windows"), (F.coalesce(F.sum("requests"), F.lit(0)) / (60.0 * minutes)).alias("rps"))


def component_status(samples: DataFrame, now, stale_seconds: int = 90) -> tuple[DataFrame, DataFrame]:
    """The latest sample of each component (stale ones are down), and the status of all."""
    latest = samples.groupBy("component").agg(F.max("ts").alias("ts"), F.max_by("status", "ts").alias("status"))
    old = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts") > stale_seconds
    parts = latest.withColumn("status", F.when(old, "down").otherwise(F.col("status")))
    bad = lambda s: F.count_if(F.col("status") == s) > 0
    return parts, parts.agg(F.when(bad("down"), "down").when(bad("degraded"), "degraded").otherwise("healthy").alias("status"))
