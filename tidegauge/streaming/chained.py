"""Metric families that need several aggregations, as chains of stateful aggregations in append mode.

Each level groups by the window of the level before, so a window's groups leave a level together when
the watermark passes it, and the next level counts whole windows.  What is counted as distinct is a key of
the state, spread over tasks like any other; most frequent routes are mergeable sketches, Gini and entropy
come from the histogram of counts, which has at most sqrt(2 n) entries for n requests.  The same functions take batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators import metrics as M

#: Routes tracked by a sketch of the most frequent ones: counts are exact while a group has at most three quarters as many.
TRACKED = 10_000
#: Entries read from such a sketch before ties are put in order.
MARGIN = 64


def _top(sketch: str, k: int) -> Column:
    """The k most frequent items of a sketch, ties in order of the item, with their counts."""
    entries = F.expr(f"approx_top_k_estimate({sketch}, {max(MARGIN, 2 * k)})")
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-e["count"]).alias("minus"), e["item"].alias("item"))))
    return F.slice(F.transform(ordered, lambda e: F.struct(e["item"].alias("endpoint"), (-e["minus"]).alias("requests"))), 1, k)


def ip_metrics(events: DataFrame, window: str = "1 minute", min_requests: int = 1, paths: int = 10) -> DataFrame:
    """Window x ip from window x ip x route, agent and session: the columns of the batch rollup.

    Routes, agents and sessions go down one chain and are counted as keys of the state, so their numbers are
    exact.  Sample paths are a merged sketch of frequent routes; among routes of the same count a null one comes last.
    """
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("key")) for d in ("endpoint", "user_agent", "session_id")])
    keyed = events.withColumn("_p", F.explode(dims)).withColumns({"dim": F.col("_p.dim"), "key": F.col("_p.key")})
    counts = keyed.groupBy(F.window("event_time", window).alias("window"), "ip", "dim", "key").agg(
        F.count("*").alias("n"),
        M.total("is_error").alias("errors"),
        M.total("is_not_found").alias("not_found"),
        M.total("is_auth_fail").alias("auth_fails"),
        F.sum("bytes_sent").alias("bytes_sent"),
        F.sum("response_time_ms").alias("latency"),
        F.count("response_time_ms").alias("timed"),
        F.max("response_time_ms").alias("max_response_time"),
        F.sum(F.col("is_bot").cast("double")).alias("bots"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        *[F.min(c).alias(c) for c in ("country", "asn", "org")],
        F.max("attack_label").alias("attack_label"),
        F.expr(f"approx_top_k_accumulate(key, {TRACKED}) filter (where dim = 'endpoint')").alias("frequent"),
    )
    is_route, n = F.col("dim") == "endpoint", F.col("n").cast("double")

    def of_routes(value: Column | str) -> Column:
        # each event is in one route, and again in its agent and its session
        return F.sum(F.when(is_route, F.col(value) if isinstance(value, str) else value))

    def known(dim: str) -> Column:
        return F.count_if((F.col("dim") == dim) & F.col("key").isNotNull())

    rolled = counts.groupBy("window", "ip").agg(
        of_routes("n").alias("requests"),
        of_routes("errors").alias("errors"),
        of_routes("not_found").alias("not_found"),
        of_routes("auth_fails").alias("auth_fail_count"),
        of_routes("bytes_sent").alias("bytes_sent"),
        F.try_divide(of_routes("latency"), of_routes("timed")).alias("avg_response_time"),
        F.max("max_response_time").alias("max_response_time"),
        F.count_if(is_route).alias("unique_paths"),
        (of_routes("bots") / of_routes("n")).alias("bot_ratio"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        *[F.min(c).alias(c) for c in ("country", "asn", "org")],
        known("user_agent").alias("unique_user_agents"),
        known("session_id").alias("unique_sessions"),
        F.max("attack_label").alias("dominant_attack_label"),
        of_routes(n * F.log2(n)).alias("_n_log_n"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("_frequent"),
    )
    requests = F.col("requests").cast("double")
    span = F.col("last_seen").cast("double") - F.col("first_seen").cast("double")
    return M.bounds(rolled.filter(F.col("requests") >= min_requests)).withColumns({
        "sample_paths": F.transform(_top("_frequent", paths), lambda e: e["endpoint"]),
        "path_entropy": F.when(F.col("unique_paths") < 2, 0.0).otherwise((F.log2(requests) - F.col("_n_log_n") / requests) / F.log2(F.col("unique_paths").cast("double"))),
        "error_ratio": M.share("errors"),
        "not_found_ratio": M.share("not_found"),
        "bytes_per_request": M.share("bytes_sent"),
        "burstiness": M.burstiness(F.col("requests"), span, M.window_seconds()),
        "rps": F.col("requests") / M.window_seconds(),
    }).drop("_n_log_n", "_frequent")


def concentration(events: DataFrame, window: str = "1 minute") -> DataFrame:
    """Gini over ips, entropy over routes, busiest ip: counts, then the histogram of counts, then the window.

    Both dimensions go down one chain, so there is no join of streams.
    """
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("key")) for d in ("ip", "endpoint")])
    keyed = events.select("event_time", F.explode(dims).alias("p")).select("event_time", "p.dim", "p.key")
    counts = keyed.groupBy(F.window("event_time", window).alias("window"), "dim", "key").agg(F.count("*").alias("n"))
    least = F.when(F.count_if(F.col("key").isNull()) > 0, None).otherwise(F.min("key"))
    histogram = counts.groupBy("window", "dim", "n").agg(F.count("*").alias("m"), least.alias("least"))
    is_ip, n, m = F.col("dim") == "ip", F.col("n").cast("double"), F.col("m")
    one = histogram.groupBy("window").agg(
        F.array_sort(F.collect_list(F.when(is_ip, F.struct("n", "m")))).alias("_h"),
        F.sum(F.when(is_ip, m)).alias("n_ips"),
        F.sum(F.when(is_ip, F.col("n") * m)).alias("_total"),
        F.max(F.when(is_ip, F.col("n"))).alias("_most"),
        F.max_by("least", F.when(is_ip, F.col("n"))).alias("top_ip"),
        F.sum(F.when(~is_ip, m)).alias("_routes"),
        F.sum(F.when(~is_ip, m * n * F.log2(n))).alias("_n_log_n"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("s"))

    def step(acc: Column, e: Column) -> Column:
        # the sum of (2 rank - ips - 1) n over ranks before + 1 .. before + m, which share one count
        ranks = e["m"] * (2 * acc["before"] + e["m"] + 1) - e["m"] * (F.col("n_ips") + 1)
        return F.struct((acc["before"] + e["m"]).alias("before"), (acc["s"] + e["n"] * ranks).alias("s"))

    total = F.col("_total").cast("double")
    return M.bounds(one).select(
        "window_start", "window_end", "n_ips",
        (F.aggregate("_h", start, step)["s"] / (F.col("n_ips") * F.col("_total"))).alias("ip_gini"),
        "top_ip", (F.col("_most") / total).alias("top_ip_share"),
        F.when(F.col("_routes") < 2, 0.0).otherwise((F.log2(total) - F.col("_n_log_n") / total) / F.log2(F.col("_routes").cast("double"))).alias("path_entropy"),
    )


def status_metrics(events: DataFrame, window: str = "1 minute", top: int = 5) -> DataFrame:
    """Window x status class from window x code; the busiest endpoints by merged sketches of frequent items."""
    codes = events.groupBy(F.window("event_time", window).alias("window"), "status_class", "status").agg(
        F.count("*").alias("n"), F.sum("response_time_ms").alias("latency"), F.expr(f"approx_top_k_accumulate(endpoint, {TRACKED})").alias("frequent")
    )
    rolled = codes.groupBy("window", "status_class").agg(
        F.sum("n").alias("requests"),
        (F.sum("latency") / F.sum("n")).alias("avg_response_time"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("status").cast("string").alias("key"), F.col("n").alias("value"))))).alias("codes"),
        F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("_frequent"),
    )
    return M.bounds(rolled).withColumn("top_endpoints", _top("_frequent", top)).drop("_frequent")
