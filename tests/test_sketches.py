"""Range percentiles and distinct counts from merged sketches: error bounds, any order of merging, streams, odd rows."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import sketches as K

T0 = datetime(2026, 3, 2)


def events(spark, n=120_000, hours=6):
    """Latency grows from hour to hour and is skewed; the same addresses come back in every window."""
    rows = spark.range(n).withColumn("h", (F.col("id") % hours).cast("int"))
    return rows.select(
        F.timestamp_add("SECOND", F.col("h") * 3600 + F.pmod(F.xxhash64("id"), F.lit(3600)), F.lit(T0)).alias("event_time"),
        (F.exp(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)) / 2_000) * F.pow(F.lit(3.0), F.col("h"))).alias("response_time_ms"),
        F.format_string("10.%d", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(9_000))).alias("ip"),
        F.format_string("s%d", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(300))).alias("session_id"),
        F.pmod(F.xxhash64("id", F.lit(4)), F.lit(40)).cast("string").alias("user_id"),
        F.format_string("/p%d", F.col("id") % 3).alias("endpoint"),
    )


def test_ranges_are_within_the_bounds_and_means_of_percentiles_are_not(spark):
    log = events(spark).cache()
    rows = K.sketched_metrics(log, "1 minute").cache()
    got = K.range_totals(rows, T0, T0 + timedelta(days=1)).first()
    values = np.sort([r[0] for r in log.select("response_time_ms").collect()])
    for p in K.POINTS:
        rank = np.searchsorted(values, got[f"p{round(p * 100)}_response_time"], "right") / len(values)
        assert abs(rank - p) <= K.RANK_ERROR, p
    for name, true in (("unique_ips", 9_000), ("unique_sessions", 300), ("unique_users", 40)):
        assert abs(got[name] - true) <= 3 * K.DISTINCT_ERROR * true, name
    assert got["requests"] == 120_000
    # what the rollup replaces: the mean of the windows' percentiles is far from the range's
    mean = rows.select(F.avg(K.percentile_of(F.col("latency_sketch"), 0.5))).first()[0]
    assert abs(np.searchsorted(values, mean) / len(values) - 0.5) > 10 * K.RANK_ERROR
    log.unpersist(), rows.unpersist()


def test_rollups_of_rollups_and_by_key(spark):
    log = events(spark, 30_000)
    rows = K.sketched_metrics(log, "5 minutes", ("endpoint",))
    hours = K.merged(rows, [F.date_trunc("hour", "window_start").alias("t"), "endpoint"])
    twice = K.merged(hours, ["endpoint"])
    errors = K.rank_errors(twice, log, ["endpoint"]).collect()
    assert len(errors) == 3 and all(v <= 2 * K.RANK_ERROR for r in errors for k, v in r.asDict().items() if k != "endpoint")
    by_hour = K.range_timeseries(rows, 3600)
    bucketed = log.withColumn("t", F.date_trunc("hour", "event_time"))
    errors = K.rank_errors(by_hour, bucketed, ["t"]).collect()
    assert len(errors) == 6 and all(v <= 2 * K.RANK_ERROR for r in errors for k, v in r.asDict().items() if k != "t")
    assert {r["requests"] for r in by_hour.collect()} == {5_000}


def test_streams_keep_the_same_sketches(spark, tmp_path):
    log = events(spark, 6_000)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in")).withWatermark("event_time", "1 minute")
    K.sketched_metrics(stream, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("sketched").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    live, batch = K.range_totals(spark.table("sketched"), T0, T0 + timedelta(days=1)), K.sketched_metrics(log, "10 minutes")
    a, b = live.first(), K.range_totals(batch, T0, T0 + timedelta(days=1)).first()
    assert a["requests"] == b["requests"] == 6_000 and a["unique_sessions"] == b["unique_sessions"]
    assert all(v <= K.RANK_ERROR * 2 for v in K.rank_errors(live.withColumn("k", F.lit(1)), log.withColumn("k", F.lit(1)), ["k"]).drop("k").first())


def test_nulls_ties_and_no_rows(spark):
    odd = spark.createDataFrame([(T0, None, None, None, None), (T0, 5.0, "a", None, "u"), (T0, 5.0, "a", None, "v"), (T0 + timedelta(hours=1), None, None, None, None)], "event_time timestamp, response_time_ms double, ip string, session_id string, user_id string")
    rows = K.sketched_metrics(odd, "1 minute")
    by_hour = {r["t"]: r for r in K.range_timeseries(rows, 3600).collect()}
    first, second = by_hour[T0], by_hour[T0 + timedelta(hours=1)]
    assert (first["requests"], first["p50_response_time"], first["p99_response_time"], first["unique_ips"], first["unique_sessions"], first["unique_users"]) == (3, 5.0, 5.0, 1, 0, 2)
    assert (second["requests"], second["p50_response_time"], second["unique_ips"]) == (1, None, 0)
    none = K.range_totals(rows, T0 - timedelta(days=2), T0 - timedelta(days=1)).first()
    assert none["requests"] is None and none["p95_response_time"] is None and none["unique_users"] == 0
    assert K.range_timeseries(rows.limit(0), 3600).count() == 0 and K.sketched_metrics(odd.limit(0)).count() == 0
