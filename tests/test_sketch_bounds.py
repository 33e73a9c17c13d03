"""Merged distinct counts stay well inside their stated bound, also for sets that sketches misjudge."""

from datetime import datetime

from pyspark.sql import functions as F

from tidegauge.operators import sketches as K

T0 = datetime(2026, 3, 2)


def test_merged_counts_of_sets_that_small_sketches_misjudge(spark):
    # the worst of 1,500 such sets under sketches of 2^12 registers, merged from ten windows: off by 4.2 % and more
    keys = spark.range(30_000).select("id", F.explode(F.array(*[F.lit(s) for s in (1132, 1232, 641)])).alias("salt")).select("salt", F.format_string("%d-%d", "salt", "id").alias("ip"))
    log = keys.select(F.timestamp_add("MINUTE", F.substring("ip", -1, 1).cast("int"), F.lit(T0)).alias("event_time"), F.lit(1.0).alias("response_time_ms"), "ip", F.col("ip").alias("session_id"), F.col("ip").alias("user_id"), F.col("salt").cast("string").alias("endpoint"))
    rows = K.merged(K.sketched_metrics(log, "1 minute", ("endpoint",)), ["endpoint"]).select(*K.IDENTITIES).collect()
    assert len(rows) == 3 and all(abs(n - 30_000) <= 2 * K.DISTINCT_ERROR * 30_000 for r in rows for n in r)
