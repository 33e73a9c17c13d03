"""Percentiles and distinct counts over ranges, from mergeable sketches that windows keep.

The mean of windows' percentiles is no percentile of the range, and a sum of distinct counts counts
again who comes back.  A window's KLL sketch of latencies and HLL sketches of identities are columns of
its row; a rollup over any range, bucket or coarser key merges them, without events.  A merged KLL
sketch answers with a value whose rank is within ``RANK_ERROR`` of the asked one, an HLL sketch within
three times ``DISTINCT_ERROR``, whatever the number of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a KLL sketch: some 3 KB a window at most.
KLL_K = 400
#: Single-sided rank error of a KLL sketch of that size with 99 % confidence, a little rounded up.
RANK_ERROR = 0.0075
LG_HLL = 14
#: Stated error of a distinct count.  The standard error of 2^14 registers (16 KB a sketch at most) is half of it, so that three
#: stated errors hold in any number of ranges; three standard errors of its own are passed by some ranges among many.
DISTINCT_ERROR = 0.0163
POINTS = (0.5, 0.9, 0.95, 0.99)
#: Identities counted, by the name that their count has.
IDENTITIES = {"unique_ips": "ip", "unique_sessions": "session_id", "unique_users": "user_id"}
SKETCHES = ("latency_sketch", *[f"{name}_sketch" for name in IDENTITIES])


def sketch_columns() -> list[Column]:
    """The sketches of a group of events, as aggregates."""
    return [F.kll_sketch_agg_double("response_time_ms", KLL_K).alias("latency_sketch"), *[F.hll_sketch_agg(F.col(c).cast("string"), LG_HLL).alias(f"{name}_sketch") for name, c in IDENTITIES.items()]]


def sketched_metrics(events: DataFrame, window: str = "1 minute", keys: tuple[str, ...] = ()) -> DataFrame:
    """Window x keys: requests, the latency sketch and the sketches of identities; for batch and stream."""
    grouped = events.groupBy(F.window("event_time", window).alias("window"), *keys).agg(F.count("*").alias("requests"), *sketch_columns())
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "requests", *SKETCHES)


def range_metric(df: DataFrame, name: str, pick: Column | None = None) -> Column | None:
    """The aggregate of a percentile or distinct count over rows that keep sketches; None for other metrics or rows."""
    def of(c: str) -> Column:
        return F.when(pick, F.col(c)) if pick is not None else F.col(c)

    point = name.removesuffix("_response_time").removeprefix("p")
    if name.endswith("_response_time") and point.isdecimal() and "latency_sketch" in df.columns:
        return percentile_of(F.kll_merge_agg_double(of("latency_sketch"), KLL_K), int(point) / 100)
    if name in IDENTITIES and f"{name}_sketch" in df.columns:
        return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(of(f"{name}_sketch"))), F.lit(0)).cast("double")
    return None


def percentile_of(sketch: Column, p: float) -> Column:
    """Null for a sketch without values."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p)))


def merged(rows: DataFrame, keys: list[Column | str], points: tuple[float, ...] = POINTS) -> DataFrame:
    """Sketched rows rolled up: requests, range percentiles, distinct counts, and the merged sketches, which merge on."""
    out = rows.groupBy(*keys).agg(
        F.sum("requests").alias("requests"),
        F.kll_merge_agg_double("latency_sketch", KLL_K).alias("latency_sketch"),
        *[F.hll_union_agg(c).alias(c) for c in SKETCHES[1:]],
    )
    return out.withColumns({
        **{f"p{round(p * 100)}_response_time": percentile_of(F.col("latency_sketch"), p) for p in points},
        **{name: F.coalesce(F.hll_sketch_estimate(f"{name}_sketch"), F.lit(0)).cast("bigint") for name in IDENTITIES},
    })


def range_timeseries(rows: DataFrame, seconds: int, points: tuple[float, ...] = POINTS) -> DataFrame:
    """One row a bucket of time, from windows of any length that divides it."""
    return merged(rows, [F.window("window_start", f"{seconds} seconds")["start"].alias("t")], points)


def range_totals(rows: DataFrame, start, end, keys: tuple[str, ...] = (), points: tuple[float, ...] = POINTS) -> DataFrame:
    """Totals over a closed range of windows, of all or by ``keys`` (endpoints, services); no rows give no keys, and one row of all."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return merged(rows.filter(F.col("window_start").between(low, high)), list(keys), points)


def rank_errors(estimates: DataFrame, events: DataFrame, keys: list[str], points: tuple[float, ...] = POINTS) -> DataFrame:
    """How far each estimated percentile's rank among the events is from the asked one, 0 where it is inside the ranks of its ties.

    Both frames carry ``keys``; the estimates are one row a key.
    """
    asked = {f"p{round(p * 100)}_response_time": p for p in points}
    values = events.select(*keys, F.col("response_time_ms").alias("_v")).filter(F.col("_v").isNotNull())
    joined = values.join(estimates.select(*keys, *asked), keys)
    n = F.count("*").cast("double")

    def error(c: str, p: float) -> Column:
        below, upto = F.count_if(F.col("_v") < F.col(c)) / n, F.count_if(F.col("_v") <= F.col(c)) / n
        return F.greatest(below - p, p - upto, F.lit(0.0)).alias(c.replace("response_time", "rank_error"))

    return joined.groupBy(*keys).agg(*[error(c, p) for c, p in asked.items()])
