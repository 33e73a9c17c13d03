"""Flags and weights derived from single events; the same columns for batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Satisfied up to this latency, tolerated up to four times of it.
APDEX_MS = 500.0


def enrich(df: DataFrame) -> DataFrame:
    """Adds status class, error kinds, cache hit, slow and the apdex weight; fills nulls of flags and numbers.

    ``ingest_latency_ms`` is the transport time less the event time in whole seconds, where the
    transport time ``kafka_ts`` is known.
    """
    status = F.coalesce("status", F.lit(0))
    latency = F.coalesce("response_time_ms", F.lit(0.0))
    weight = F.when(latency <= APDEX_MS, 1.0).when(latency <= 4 * APDEX_MS, 0.5).otherwise(0.0)
    out = df.withColumns({
        "status_class": F.concat(F.floor(status / 100).cast("string"), F.lit("xx")),
        "is_client_error": (status >= 400) & (status < 500),
        "is_server_error": status >= 500,
        "is_error": status >= 400,
        "is_not_found": status == 404,
        "is_auth_fail": status.isin(401, 403) & F.coalesce(F.col("path").contains("/auth/"), F.lit(False)),
        "is_cache_hit": F.coalesce(F.col("cache_status") == "HIT", F.lit(False)),
        "is_slow": latency > APDEX_MS,
        "is_bot": F.coalesce("is_bot", F.lit(False)),
        "bytes_sent": F.coalesce("bytes_sent", F.lit(0).cast("bigint")),
        "response_time_ms": latency,
        "apdex_weight": weight,
    })
    if "kafka_ts" in df.columns:
        seconds = F.unix_timestamp("kafka_ts") - F.unix_timestamp("event_time")
        return out.withColumn("ingest_latency_ms", (seconds * 1000).cast("double"))
    return out.withColumn("ingest_latency_ms", F.lit(None).cast("double"))
