"""Time series, totals, histograms and runs over metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.stats import severity_rank
from tidegauge.operators.sketches import range_metric

#: How each metric is made of its windows.
METRICS = {
    "requests": ("sum", "requests"), "rps": ("rate", "requests"), "error_rate": ("ratio", ("errors_4xx", "errors_5xx")), "server_error_rate": ("ratio", ("errors_5xx",)),
    "errors_4xx": ("sum", "errors_4xx"), "errors_5xx": ("sum", "errors_5xx"), "bytes_sent": ("sum", "bytes_sent"),
    **{m: ("avg", m) for m in ["p50_response_time", "p90_response_time", "p95_response_time", "p99_response_time", "avg_response_time", "unique_ips", "unique_sessions", "apdex", "bot_ratio", "cache_hit_rate", "ip_gini", "path_entropy"]},
}
LADDER = (60, 300, 600, 900, 1800, 3600, 7200, 10800, 21600)
STATUS_CLASSES = ("2xx", "3xx", "4xx", "5xx")


def bucket_seconds(span_seconds: float, points: int = 500) -> int:
    """The first step of the ladder that keeps a chart near the number of points; beyond it whole minutes."""
    return next((b for b in LADDER if span_seconds / b <= points), max(60, int(span_seconds / points) // 60 * 60))


def bucket(seconds: int, time: str = "window_start") -> Column:
    return F.window(time, f"{seconds} seconds")["start"]


def _span(df: DataFrame, time: str = "window_start") -> float:
    low, high = df.agg(F.min(F.unix_timestamp(time)), F.max(F.unix_timestamp(time))).first()
    return 0.0 if low is None else float(high - low)


def metric(name: str, seconds: int) -> Column:
    """Aggregate of a catalogued metric in a bucket; ratios are sums over sums."""
    kind, source = METRICS[name]
    if kind == "sum":
        return F.coalesce(F.sum(source), F.lit(0)).cast("double").alias(name)
    if kind == "rate":
        return (F.coalesce(F.sum(source), F.lit(0)) / max(seconds, 1)).alias(name)
    if kind == "ratio":
        top = sum((F.sum(c) for c in source[1:]), F.sum(source[0]))
        return F.coalesce(F.try_divide(top, F.sum("requests")), F.lit(0.0)).alias(name)
    return F.coalesce(F.avg(source), F.lit(0.0)).alias(name)


def _or(merged: Column | None, mean: Column) -> Column:
    return mean if merged is None else F.coalesce(merged, F.lit(0.0))


def timeseries(df: DataFrame, metrics: list[str] | None = None, bucket_s: int | str = 60) -> DataFrame:
    """One wide row a bucket; "auto" picks the bucket from the span of the rows.

    Percentiles and distinct counts are those of the bucket where rows keep sketches, else means over its windows.
    """
    seconds = bucket_seconds(_span(df)) if bucket_s == "auto" else int(bucket_s)
    metrics = [m for m in (metrics or list(METRICS)) if m in METRICS and (METRICS[m][0] != "avg" or m in df.columns)]
    return df.groupBy(bucket(seconds).alias("t")).agg(*[F.round(_or(range_metric(df, m), metric(m, seconds)), 4).alias(m) for m in metrics])


def drop_open_bucket(df: DataFrame, seconds: int, now, time: str = "t") -> DataFrame:
    """Without the last bucket if it still fills."""
    return df.filter(F.unix_timestamp(time) + seconds <= F.unix_timestamp(F.lit(now).cast("timestamp")))


def _kpis(df: DataFrame, seconds: Column, pick: Column | None = None) -> dict[str, Column]:
    def of(c: str) -> Column:
        return F.when(pick, F.col(c)) if pick is not None else F.col(c)

    requests, errors = F.coalesce(F.sum(of("requests")), F.lit(0)), F.coalesce(F.sum(of("errors_4xx")) + F.sum(of("errors_5xx")), F.lit(0))
    server = F.coalesce(F.sum(of("errors_5xx")), F.lit(0))
    rate = lambda x: F.coalesce(F.try_divide(x, requests), F.lit(0.0))
    means = {m: F.round(_or(range_metric(df, m, pick), F.coalesce(F.avg(of(m)), F.lit(0.0))), d) for m, d in (("p50_response_time", 1), ("p95_response_time", 1), ("p99_response_time", 1), ("avg_response_time", 1), ("unique_ips", 0), ("unique_sessions", 0), ("bot_ratio", 4), ("cache_hit_rate", 4))}
    return {
        "requests": requests, "rps": F.round(requests / seconds, 4), "peak_rps": F.round(F.coalesce(F.max(of("rps")), F.lit(0.0)), 4), "errors": errors,
        "errors_4xx": F.coalesce(F.sum(of("errors_4xx")), F.lit(0)), "errors_5xx": server, "error_rate": F.round(rate(errors), 5), "server_error_rate": F.round(rate(server), 5),
        "availability": F.round(1 - rate(server), 5), "bytes_sent": F.coalesce(F.sum(of("bytes_sent")), F.lit(0)), "apdex": F.round(F.coalesce(F.avg(of("apdex")), F.lit(1.0)), 4),
        **means, "windows": F.count_if(pick) if pick is not None else F.count("*"),
    }


def kpi_totals(df: DataFrame, start, end) -> DataFrame:
    """One row of totals over a closed range; percentiles and distinct counts as in ``timeseries``."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    seconds = F.greatest(F.unix_timestamp(high) - F.unix_timestamp(low), F.lit(1))
    return df.filter(F.col("window_start").between(low, high)).agg(*[c.alias(n) for n, c in _kpis(df, seconds).items()])


def kpi_deltas(df: DataFrame, start, end, metrics=("requests", "errors", "error_rate", "p95_response_time", "apdex", "unique_ips")) -> DataFrame:
    """Change in percent against the period of the same length before, null where that was 0; one pass."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    length = F.unix_timestamp(high) - F.unix_timestamp(low)
    epoch = F.unix_timestamp("window_start")
    rows = df.filter(epoch.between(F.unix_timestamp(low) - length, F.unix_timestamp(high))).withColumn("_now", F.col("window_start") >= low)
    now, before = _kpis(df, length, F.col("_now")), _kpis(df, length, ~F.col("_now"))
    both = rows.agg(*[now[m].cast("double").alias(f"n_{m}") for m in metrics], *[before[m].cast("double").alias(f"b_{m}") for m in metrics])
    return both.select(*[F.round(F.when(F.col(f"b_{m}") != 0, (F.col(f"n_{m}") - F.col(f"b_{m}")) / F.col(f"b_{m}") * 100), 2).alias(f"{m}_delta") for m in metrics])


def status_breakdown(status_rows: DataFrame, seconds: int = 3600) -> DataFrame:
    """Requests of each status class by bucket, zero-filled."""
    wide = status_rows.groupBy(bucket(seconds).alias("t")).pivot("status_class", list(STATUS_CLASSES)).agg(F.sum("requests"))
    return wide.fillna(0)


def baseline_band(baseline: DataFrame, metric_name: str, day_type: str) -> DataFrame:
    """Usual range by time of day."""
    minutes = F.col("bucket") * 15
    rows = baseline.filter((F.col("metric") == metric_name) & (F.col("day_type") == day_type))
    label = F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int"))
    return rows.select("bucket", label.alias("time"), "median", F.col("p25").alias("low"), F.col("p75").alias("high"), "p95", "samples")


def weekly_heatmap(df: DataFrame) -> DataFrame:
    """Weekday (0: Monday) x hour."""
    grouped = df.groupBy(F.weekday("window_start").alias("weekday"), F.hour("window_start").alias("hour"))
    seconds = F.sum(F.unix_timestamp("window_end") - F.unix_timestamp("window_start"))
    return grouped.agg(
        F.sum("requests").alias("requests"),
        F.round(F.sum("requests") / seconds, 4).alias("rps"),
        F.round(F.coalesce(F.try_divide(F.sum("errors_4xx") + F.sum("errors_5xx"), F.sum("requests")), F.lit(0.0)), 5).alias("error_rate"),
        F.round(F.avg("p95_response_time"), 1).alias("p95_response_time"),
        F.count("*").alias("windows"),
    )


def log_histogram(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """Events by bucket and status class, zero-filled, with the total."""
    wide = events.groupBy(bucket(seconds, "event_time").alias("t")).pivot("status_class", list(STATUS_CLASSES)).count().fillna(0)
    return wide.withColumn("total", sum((F.col(c) for c in STATUS_CLASSES[1:]), F.col(STATUS_CLASSES[0])))


FACETS = ("status", "method", "endpoint", "service", "country", "device", "browser")


def log_facets(events: DataFrame, dims: tuple[str, ...] = FACETS, k: int = 8) -> DataFrame:
    """The k most frequent values of each dimension; the events are read once."""
    present = [d for d in dims if d in events.columns]
    pairs = events.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in present])).alias("p")).select("p.*")
    counts = pairs.filter(F.col("value").isNotNull()).groupBy("dim", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def anomaly_bands(anomalies: DataFrame) -> DataFrame:
    """Windows with anomalies, touching or overlapping ones merged; each run has its worst severity.

    A window's anomalies are first reduced to one row.
    """
    worst = F.max(F.struct(severity_rank(F.col("severity")).alias("rank"), F.col("severity"), F.col("score"), F.col("headline")))
    per_window = anomalies.groupBy("window_start").agg(F.max("window_end").alias("window_end"), worst.alias("worst"))
    order = Window.orderBy("window_start")
    before = F.max("window_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = per_window.withColumn("_new", F.when(before.isNull() | (F.col("window_start") > before), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("run").agg(F.min("window_start").alias("start"), F.max("window_end").alias("end"), F.max("worst").alias("worst"), F.count("*").alias("windows"))
    return found.select("start", "end", "worst.severity", F.col("worst.headline").alias("label"), "windows")


def merged_feed(fresh: DataFrame, stored: DataFrame, start, end) -> DataFrame:
    """Fresh and stored anomalies of a range, one row an id (the fresh one), newest window first."""
    both = fresh.withColumn("_rank", F.lit(0)).unionByName(stored.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    rows = both.filter(F.col("window_start").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    first = F.row_number().over(Window.partitionBy("anomaly_id").orderBy("_rank"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_rank", "_n").orderBy(F.desc("window_start"), "anomaly_id")
