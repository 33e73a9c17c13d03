"""Access-log events: schema, streaming and batch sources, and preparation.

One event is one request.  ``prepare_events`` accepts any subset of the columns; what is absent gets
its default, what doesn't parse becomes null or zero, and rows without a timestamp go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
_NUMBERS = {"schema_version": _I, "status": _I, "bytes_sent": _L, "bytes_received": _L, "response_time_ms": _D, "upstream_time_ms": _D, "lat": _D, "lon": _D, "is_bot": _B}
#: The columns of an event, in order.
EVENT_COLUMNS = ["event_id", "schema_version", "timestamp", "ingest_ts", "service", "region", "host", "ip", "method", "path", "endpoint", "query", "protocol", "status", "bytes_sent", "bytes_received", "response_time_ms", "upstream_time_ms", "referrer", "user_agent", "user_id", "session_id", "request_id", "country", "country_name", "city", "lat", "lon", "asn", "org", "device", "browser", "os", "is_bot", "cache_status", "tls_version", "attack_label"]
EVENT_SCHEMA = T.StructType([T.StructField(c, _NUMBERS.get(c, _S)) for c in EVENT_COLUMNS])

#: Values that stand for what a batch of events lacks.
DEFAULTS = {"service": "unknown", "ip": "0.0.0.0", "method": "GET", "endpoint": "/", "path": "/", "country": "??", "country_name": "Unknown", "asn": "AS0", "org": "unknown", "user_agent": "", "is_bot": False}


def read_events_stream(spark: SparkSession, fmt: str = "kafka", options: dict[str, str] | None = None) -> DataFrame:
    """Stream of raw messages (value, timestamp, partition, offset).

    Kafka: give servers and topic as options; the cap per trigger and tolerance of lost data have
    defaults.  File formats: json text lines from ``path``, for replays and tests.
    """
    options = dict(options or {})
    if fmt == "kafka":
        settings = {"startingOffsets": "latest", "maxOffsetsPerTrigger": "200000", "failOnDataLoss": "false"} | options
        return spark.readStream.format("kafka").options(**settings).load()
    path = options.pop("path")
    settings = {"maxFilesPerTrigger": "8"} | options
    lines = spark.readStream.format("text").options(**settings).load(path)
    return lines.select(F.col("value").cast("binary").alias("value"), F.current_timestamp().alias("timestamp"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"))


def parse_events(raw: DataFrame) -> DataFrame:
    """Decoded events with transport time, partition and offset; rows without time, status or endpoint go."""
    payload = raw.select(
        F.from_json(F.col("value").cast("string"), EVENT_SCHEMA).alias("payload"),
        F.col("timestamp").alias("kafka_ts"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
    )
    parsed = payload.select("payload.*", "kafka_ts", "kafka_partition", "kafka_offset").withColumn("event_time", F.try_to_timestamp("timestamp"))
    return parsed.filter(F.col("event_time").isNotNull() & F.col("status").isNotNull() & (F.col("status") > 0) & F.col("endpoint").isNotNull())


def _number(df: DataFrame, column: str, kind: str, default) -> Column:
    if column not in df.columns:
        return F.lit(default).cast(kind)
    value = F.col(column)
    text = value.cast("string")
    found = text.try_cast("double")
    found = F.when(F.isnan(found) | (F.abs(found) == float("inf")), None).otherwise(found)
    return F.coalesce(found.try_cast(kind), F.lit(default).cast(kind))


def prepare_events(df: DataFrame) -> DataFrame:
    """Batch events with every column, of the right type; the time of an event is ``event_time``."""
    columns: dict[str, Column] = {}
    for c in EVENT_COLUMNS:
        kind = EVENT_SCHEMA[c].dataType.simpleString()
        if c in ("status", "bytes_sent", "bytes_received", "response_time_ms", "upstream_time_ms"):
            columns[c] = _number(df, c, kind, 0)
        elif c in df.columns and c != "timestamp":
            columns[c] = F.coalesce(F.col(c).cast("string").try_cast(kind), F.lit(DEFAULTS[c]).cast(kind)) if c in DEFAULTS else F.col(c).cast("string").try_cast(kind)
        elif c != "timestamp":
            columns[c] = F.lit(DEFAULTS.get(c)).cast(kind)
    source = "event_time" if "event_time" in df.columns else "timestamp"
    when = df.schema[source].dataType
    time = F.try_to_timestamp(F.col(source)) if isinstance(when, T.StringType) else F.col(source).cast("timestamp")
    return df.withColumn("_time", time).filter(F.col("_time").isNotNull()).select(F.col("_time").alias("event_time"), *[c.alias(n) for n, c in columns.items()])


def sample_events(df: DataFrame, fraction: float, seed: int = 7, key: str | None = None) -> DataFrame:
    """Bernoulli sample; with a ``key``, by its hash, so that a task that runs again draws the same rows."""
    if key is None:
        return df.sample(withReplacement=False, fraction=fraction, seed=seed)
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double")
    return df.filter(drawn < fraction * 2**32)


def load_metrics(spark: SparkSession, path: str, start=None, end=None, time: str = "window_start") -> DataFrame:
    """Stored metrics between two times (both included), in order of time."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp"))
        df = df.filter(F.col("date") >= F.lit(start).cast("timestamp").cast("date")) if "date" in df.columns else df
    if end is not None:
        df = df.filter(F.col(time) <= F.lit(end).cast("timestamp"))
        df = df.filter(F.col("date") <= F.lit(end).cast("timestamp").cast("date")) if "date" in df.columns else df
    return df.orderBy(time)


#: The events table of the test data as an access log; the same text runs in Spark and in DuckDB.
ACCESS_LOG_SQL = """
select cast(event_id as string) as event_id, cast(ts as timestamp) as event_time, cast(user_id as string) as user_id,
  case when event_type='error' then case k % 4 when 0 then 500 when 1 then 404 when 2 then 401 else 503 end
       when k % 10 = 0 then 304 when event_type='purchase' then 201 else 200 end as status,
  case when event_type in ('purchase','signup') then 'POST' else 'GET' end as method,
  case event_type when 'signup' then '/api/v1/auth/signup' when 'purchase' then '/api/v1/checkout'
       when 'error' then case when k % 4 = 2 then '/api/v1/auth/login' else '/api/v1/search' end
       when 'click' then '/api/v1/products' else '/' end as endpoint,
  concat(case event_type when 'signup' then '/api/v1/auth/signup' when 'purchase' then '/api/v1/checkout'
       when 'error' then case when k % 4 = 2 then '/api/v1/auth/login' else '/api/v1/search' end
       when 'click' then '/api/v1/products' else '/' end, '/', cast(k as string)) as path,
  concat('10.0.0.', cast(user_id % 256 as string)) as ip,
  concat('s', cast(user_id as string)) as session_id,
  concat('svc-', cast(user_id % 5 as string)) as service,
  concat('C', cast(user_id % 25 as string)) as country,
  concat('Country ', cast(user_id % 25 as string)) as country_name,
  concat('City ', cast(k % 3 as string)) as city,
  cast(user_id % 25 as double) as lat, cast(user_id % 7 as double) as lon,
  concat('AS', cast(user_id % 11 as string)) as asn, concat('org-', cast(user_id % 11 as string)) as org,
  value*10 as response_time_ms, cast(k*100 as bigint) as bytes_sent,
  user_id % 20 = 0 as is_bot,
  case when k % 3 = 0 then 'HIT' else 'MISS' end as cache_status,
  concat('ua-', cast(k % 7 as string)) as user_agent, concat('host-', cast(k % 4 as string)) as host,
  case when k % 2 = 0 then 'desktop' else 'mobile' end as device, concat('browser-', cast(k % 4 as string)) as browser,
  case when event_type='error' and user_id % 50 = 7 then 'error_spike' end as attack_label
from (select *, cast(regexp_extract(props,'([0-9]+)',1) as int) as k from events) as keyed
"""


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(ACCESS_LOG_SQL.replace("from events)", "from {events})"), events=events)
