"""Detection jobs: metric rows scored against their strict past, fused into anomalies.

Every job takes metric tables and returns anomalies; thresholds and gates are parameters whose
defaults are fixed values of the product.  A detection must be statistically unusual and material.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.stats import anomaly, dedupe, emit, make_anomalies, median, rule, soft_score
from tidegauge.operators import detectors as D
from tidegauge.operators.sliding import with_past

#: Thresholds, with the names that users edit.
THRESHOLDS = {"zscore_threshold": 3.5, "ewma_alpha": 0.25, "error_rate_threshold": 0.08, "latency_p95_multiplier": 2.5, "ip_rps_threshold": 25.0, "scan_unique_paths": 30.0, "auth_fail_threshold": 15.0, "min_history_points": 12}
#: Gates.
ENDPOINT_MIN_REQUESTS, RATE_MIN_SAMPLE, GEO_MIN_REQUESTS = 40, 100, 50
SERVER_ERROR_FLOOR, SERVER_ERROR_DELTA = 0.02, 0.015
COLD_START_PENALTY, COLD_CUSUM_PENALTY = 1.8, 1.6
GLOBAL_FEATURES = ["rps", "error_rate", "server_error_rate", "p95_response_time", "unique_ips", "bytes_per_request", "ip_gini", "path_entropy", "bot_ratio"]
IP_FEATURES = ["requests", "unique_paths", "unique_user_agents", "error_ratio", "not_found_ratio", "auth_fail_count", "avg_response_time", "bytes_per_request", "path_entropy", "burstiness"]
SESSION_FEATURES = ["requests", "duration_seconds", "error_count", "unique_endpoints", "requests_per_minute"]
DAY = 86_400


def _t(thresholds: dict | None) -> dict:
    return THRESHOLDS | (thresholds or {})


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def latency_is_material(p95: Column, baseline: Column) -> Column:
    """Slow in absolute terms, or far slower than usual."""
    slow = (p95 >= 400) & (p95 >= baseline * 1.6) | (p95 >= 250) & (p95 >= baseline * 3)
    return F.when(baseline <= 0, p95 >= 400).otherwise(slow)


def cube(*scores: Column) -> Column:
    return F.cbrt(reduce(lambda a, b: a * b, [F.greatest(s, F.lit(1e-6)) for s in scores]))


#: Adds the detector struct ``isolation_forest`` to metric rows (``learning.detector``).
Forest = Callable[[DataFrame], DataFrame]


def _with_forest(rows: DataFrame, forest: Forest | None) -> DataFrame:
    return forest(rows) if forest is not None else rows.withColumn("isolation_forest", D.neutral("isolation_forest"))


def analyze_global(rows: DataFrame, thresholds: dict | None = None, lookback_seconds: int = 3 * DAY, bucket_minutes: int = 15, forest: Forest | None = None) -> DataFrame:
    """Traffic spike or drop, concentrated burst, error spike, latency and unusual profile of the platform.

    One row a window; all kinds are looked for in one pass.
    """
    t = _t(thresholds)
    z, points, alpha = t["zscore_threshold"], t["min_history_points"], t["ewma_alpha"]
    base = _with_forest(rows, forest)
    for c in ("ip_gini", "path_entropy", "bot_ratio", "bytes_per_request"):
        base = base if c in base.columns else base.withColumn(c, F.lit(0.0))
    # one series: chunks of its numbers are read in order once, rows get a few statistics of their past
    wanted = {"requests": ("stats", "ewma", "cusum", "trend", "seasonal"), "error_rate": ("stats", "cusum", "seasonal"), "server_error_rate": ("stats",), "p95_response_time": ("stats", "ewma", "seasonal")}
    base = with_past(base, wanted, lookback_seconds, GLOBAL_FEATURES, alpha=alpha, bucket_minutes=bucket_minutes)
    base = base.withColumn("mahalanobis", D.mahalanobis_of(F.col("p_mahalanobis"), GLOBAL_FEATURES, 2 * points, z))
    volume, failures, server, latency = (F.col(f"p_{c}") for c in wanted)
    usual = lambda p, v, label: D.seasonal_of(F.struct(p["s_n"].cast("int").alias("n"), p["s_median"].alias("median"), p["s_sigma"].alias("sigma")), v, z, label=label)
    requests, rate, p95 = F.col("requests").cast("double"), F.col("error_rate"), F.col("p95_response_time")
    base = base.withColumn("_seasonal", usual(volume, requests, "request volume"))
    blind = F.col("_seasonal.cold")
    base = base.withColumn("_zt", F.when(blind, z * COLD_START_PENALTY).otherwise(z)).withColumn("_ct", F.when(blind, 5.0 * COLD_CUSUM_PENALTY).otherwise(5.0))
    base = base.withColumns({
        "_up": D.robust_z_of(volume, requests, F.col("_zt"), points, "up", "request volume"),
        "_down": D.robust_z_of(volume, requests, F.col("_zt"), points, "down", "request volume"),
        "_ewma": D.ewma_of(volume, volume["n"], requests, F.col("_zt"), points, "request volume"),
        "_cusum": D.cusum_of(volume, requests, 0.5, F.col("_ct"), points, "request volume"),
        "_trend": D.trend_of(volume, volume["n"], requests, z, points, "request volume"),
        "_rows": F.when(volume["n"] > 0, volume["median"]).otherwise(requests),
        "_server": F.when(server["n"] > 0, server["median"]).otherwise(0.0),
        "_p95": F.when(latency["n"] > 0, latency["median"]).otherwise(p95),
    })
    base = base.withColumn("_burst", cube(soft_score(requests / F.greatest(F.col("_rows"), F.lit(1.0)), 2.2, 4.0), soft_score(F.col("ip_gini"), 0.72, 6.0), soft_score(1 - F.col("path_entropy"), 0.55, 5.0)))
    shown = ["requests", "rps", "error_rate", "server_error_rate", "p95_response_time", "p99_response_time", "unique_ips", "unique_sessions", "ip_gini", "path_entropy"]
    shown = [c for c in shown if c in base.columns]
    entity, known = F.lit("all-traffic"), volume["n"] > 0
    flood = rule(F.col("_burst"), F.lit("volume is concentrated in few sources and few routes"))
    budget = rule(soft_score(rate, t["error_rate_threshold"], 2.5), F.concat(D.number(rate * 100, 1), F.lit("% of requests failed")))
    slow = rule(soft_score(p95 / F.greatest(F.col("_p95"), F.lit(1.0)), t["latency_p95_multiplier"], 4.0), F.concat(F.lit("p95 "), D.number(p95, 0), F.lit(" ms vs "), D.number(F.col("_p95"), 0)))
    found = base.withColumns({
        "_any_spike": anomaly(base, "traffic_spike", "global", entity, [F.col(c) for c in ("_up", "_ewma", "_seasonal", "_cusum", "_trend")], F.concat(F.lit("Request volume spike: "), D.number(requests, 0)), shown),
        "_ddos": anomaly(base, "ddos_burst", "global", entity, [flood, F.col("_up"), F.col("_ewma")], F.concat(F.lit("Concentrated burst from "), D.number(F.col("unique_ips"), 0), F.lit(" sources")), shown, (F.col("requests") > 0) & known & (F.col("_burst") >= 0.35)),
        "_err": anomaly(
            base, "error_spike", "global", entity,
            [D.robust_z_of(failures, rate, z, points, "up", "error rate"), D.cusum_of(failures, rate, 0.5, 4.0, points, "error rate"), usual(failures, rate, "error rate"), budget],
            F.concat(F.lit("Error rate at "), D.number(rate * 100, 1), F.lit("%")), shown,
            F.col("server_error_rate") >= F.greatest(F.col("_server") + SERVER_ERROR_DELTA, F.lit(SERVER_ERROR_FLOOR)),
        ),
        "_lat": anomaly(
            base, "latency_anomaly", "global", entity,
            [D.robust_z_of(latency, p95, z, points, "up", "p95 latency"), D.ewma_of(latency, latency["n"], p95, z, points, "p95 latency"), usual(latency, p95, "p95 latency"), slow],
            F.concat(F.lit("Latency: p95 at "), D.number(p95, 0), F.lit(" ms")), shown, latency_is_material(p95, F.col("_p95")),
        ),
    })
    # a drop is looked for only where no spike reached the floor, confirmed or not
    found = found.withColumns({
        "_spike": F.when((F.col("requests") > 0) & (~blind | (F.col("_trend.score") >= 0.5)), F.col("_any_spike")),
        "_drop": anomaly(base, "traffic_drop", "global", entity, [F.col("_down"), F.col("_seasonal"), F.col("_trend")], F.concat(F.lit("Traffic dropped to "), D.number(requests, 0)), shown, F.col("_any_spike").isNull()),
    })
    quiet = reduce(lambda x, y: x & y, [F.col(c).isNull() for c in ("_spike", "_drop", "_ddos", "_err", "_lat")])
    odd = quiet & known & (F.greatest("mahalanobis.score", "isolation_forest.score") >= 0.55)
    found = found.withColumn("_odd", anomaly(base, "multivariate_anomaly", "global", entity, [F.col("mahalanobis"), F.col("isolation_forest")], F.lit("Traffic profile unlike any recent one"), shown, odd))
    return emit(found, "_spike", "_drop", "_ddos", "_err", "_lat", "_odd")


def _with_share(rows: DataFrame) -> DataFrame:
    """A row's share of all requests of its window."""
    totals = rows.groupBy("window_start").agg(F.sum("requests").alias("_window_total"))
    return rows.join(totals, "window_start").withColumn("_share", F.col("requests") / F.greatest(F.col("_window_total"), F.lit(1)))


def analyze_endpoints(rows: DataFrame, thresholds: dict | None = None, lookback_seconds: int = DAY // 2, min_requests: int = ENDPOINT_MIN_REQUESTS, rate_min: int = RATE_MIN_SAMPLE) -> DataFrame:
    """Slow endpoints, failing endpoints and unusual shares of traffic; the best of an endpoint's methods stays."""
    t = _t(thresholds)
    z, points, alpha = t["zscore_threshold"], t["min_history_points"], t["ewma_alpha"]
    base = D.with_history(_with_share(rows), ["p95_response_time", "server_error_rate", "_share"], ["endpoint"], lookback_seconds, tie="method").filter(F.col("requests") >= min_requests)
    p95, server, share = F.col("p95_response_time"), F.col("server_error_rate"), F.col("_share")
    base = base.withColumns({"_p95": F.coalesce(median(F.col("h_p95_response_time")), p95), "_server": F.coalesce(median(F.col("h_server_error_rate")), F.lit(0.0)), "_usual": F.coalesce(median(F.col("h__share")), share)})
    shown, entity = ["requests", "error_rate", "p50_response_time", "p95_response_time", "p99_response_time", "apdex", "unique_ips"], F.col("endpoint")
    shown = [c for c in shown if c in rows.columns]
    slow = rule(soft_score(p95 / F.greatest(F.col("_p95"), F.lit(1.0)), t["latency_p95_multiplier"], 4.0), F.concat(F.lit("p95 "), D.number(p95, 0), F.lit(" ms vs "), D.number(F.col("_p95"), 0)))
    service = "service" if "service" in rows.columns else None
    late = anomaly(base, "slow_endpoint", "endpoint", entity, [D.robust_z(F.col("h_p95_response_time"), p95, z, points, "up", "p95"), D.ewma(F.col("h_p95_response_time"), p95, alpha, z, points, "p95"), slow], F.concat(entity, F.lit(" is slow: p95 "), D.number(p95, 0), F.lit(" ms")), shown, latency_is_material(p95, F.col("_p95")), service=service)
    failing = rule(soft_score(server, max(t["error_rate_threshold"] / 2, 0.02), 2.5), F.concat(D.number(server * 100, 1), F.lit("% failed server-side")))
    material = (F.col("requests") >= rate_min) & (server >= SERVER_ERROR_FLOOR) & (server >= F.col("_server") + SERVER_ERROR_DELTA)
    errors = anomaly(base, "error_spike", "endpoint", entity, [D.robust_z(F.col("h_server_error_rate"), server, z, points, "up", "5xx rate"), D.cusum(F.col("h_server_error_rate"), server, 0.5, 4.0, points, "5xx rate"), failing], F.concat(entity, F.lit(" fails: "), D.number(server * 100, 1), F.lit("% server errors")), shown, material, service=service)
    large = (F.col("requests") >= rate_min) & (share >= F.greatest(F.col("_usual") * 1.5, F.col("_usual") + 0.03))
    unusual = anomaly(base, "traffic_spike", "endpoint", entity, [D.robust_z(F.col("h__share"), share, z + 0.5, points, "up", "share of traffic")], F.concat(F.lit("Unusual share of traffic on "), entity), shown, large, service=service)
    return dedupe(emit(base.withColumns({"_late": late, "_errors": errors, "_unusual": unusual}), "_late", "_errors", "_unusual"))


def ip_population(rows: DataFrame, top_n: int = 400) -> DataFrame:
    """The busiest addresses of each window: the population that others are compared with."""
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy(F.desc("requests"), "ip"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= top_n).drop("_rank")


def analyze_ips(rows: DataFrame, thresholds: dict | None = None, top_n: int = 400, forest: Forest | None = None, scrape_requests: int = 60, min_volume: float = 30.0) -> DataFrame:
    """Flooding, scanning, credential stuffing, scraping, and behaviour that no rule explains; all in one pass."""
    t = _t(thresholds)
    people = D.with_mahalanobis(_with_forest(ip_population(rows, top_n), forest), IP_FEATURES, ["window_start"], 20, t["zscore_threshold"], extra={"_middle": F.percentile("requests", 0.5)})
    seconds = F.greatest(F.unix_timestamp("window_end") - F.unix_timestamp("window_start"), F.lit(1))
    base = people.filter(F.col("requests") >= 5).withColumn("_rps", F.col("requests") / seconds)
    entity, shown = F.col("ip"), ["requests", "unique_paths", "unique_user_agents", "error_ratio", "not_found_ratio", "auth_fail_count", "avg_response_time", "bytes_sent", "path_entropy", "burstiness"]
    models, limit = [F.col("isolation_forest"), F.col("mahalanobis")], t["ip_rps_threshold"]
    base = base.withColumns({
        "_flood": soft_score(F.col("_rps"), limit),
        "_scanning": cube(soft_score(F.col("unique_paths").cast("double"), t["scan_unique_paths"]), soft_score(F.col("not_found_ratio"), 0.35), soft_score(F.col("path_entropy"), 0.6, 4.0)),
    })
    kind = F.when(F.col("_rps") >= 2 * limit, "ddos_burst").otherwise("suspicious_ip")
    fails = F.col("auth_fail_count").cast("double")
    bulk = F.least(F.lit(0.95), soft_score(F.col("requests").cast("double"), 120.0) * 0.7 + 0.3)
    found = base.withColumns({
        "_volume": anomaly(base, kind, "ip", entity, [rule(F.col("_flood"), F.concat(D.number(F.col("_rps"), 1), F.lit(" requests a second"))), *models], F.concat(entity, F.lit(" floods the platform")), shown, F.col("_flood") >= 0.4),
        "_scan": anomaly(base, "endpoint_scan", "ip", entity, [rule(F.col("_scanning"), F.lit("many routes, many of them not found")), *models], F.concat(entity, F.lit(" enumerates endpoints")), shown, F.col("_scanning") >= 0.35),
        "_auth": anomaly(base, "auth_abuse", "ip", entity, [rule(soft_score(fails, t["auth_fail_threshold"], 2.5), F.concat(D.number(fails, 0), F.lit(" failed logins"))), models[0]], F.concat(F.lit("Credential stuffing from "), entity), shown, fails >= max(t["auth_fail_threshold"] / 2, 3)),
        "_scrape": anomaly(base, "data_scraping", "ip", entity, [rule(bulk, F.lit("steady volume on few routes")), *models], F.concat(F.lit("Bulk extraction from "), entity), shown, (F.col("requests") >= scrape_requests) & (F.col("path_entropy") <= 0.35) & (F.col("unique_paths") <= 6)),
    })
    unknown = reduce(lambda x, y: x & y, [F.col(c).isNull() for c in ("_volume", "_scan", "_auth", "_scrape")])
    rest = unknown & (F.col("requests") >= F.greatest(F.lit(min_volume), 3 * F.col("_middle"))) & (F.greatest("isolation_forest.score", "mahalanobis.score") >= 0.85)
    found = found.withColumn("_odd", anomaly(base, "suspicious_ip", "ip", entity, models, F.concat(entity, F.lit(" behaves unlike other sources")), shown, rest))
    return emit(found, "_volume", "_scan", "_auth", "_scrape", "_odd")


def analyze_geo(rows: DataFrame, thresholds: dict | None = None, lookback_seconds: int = 2 * DAY, min_requests: int = GEO_MIN_REQUESTS) -> DataFrame:
    """Countries whose share of traffic is unusual, or that are new."""
    t = _t(thresholds)
    base = D.with_history(_with_share(rows), ["_share"], ["country"], lookback_seconds).filter(F.col("requests") >= min_requests)
    share = F.col("_share")
    base = base.withColumn("_usual", F.coalesce(median(F.col("h__share")), F.lit(0.0)))
    new = (F.size("h__share") < 3) & (F.col("requests") >= 3 * min_requests)
    origin = F.when(new, rule(F.lit(0.7), F.lit("no meaningful history of this origin"))).otherwise(D.neutral("rule"))
    keep = share >= F.greatest(F.col("_usual") * 1.5, F.col("_usual") + 0.01)
    return make_anomalies(base, "geo_anomaly", "country", F.col("country"), [D.robust_z(F.col("h__share"), share, t["zscore_threshold"] + 0.5, 8, "up", "share of traffic"), origin], F.concat(F.lit("Unusual traffic from "), F.col("country")), ["requests", "error_rate", "unique_ips", "p95_response_time", "_share", "_usual"], keep)


def analyze_sessions(sessions: DataFrame, thresholds: dict | None = None, min_requests: int = 15, slot: str = "5 minutes") -> DataFrame:
    """Abnormal sessions among those that end in the same slot."""
    t = _t(thresholds)
    placed = sessions.withColumns({"window_start": F.col("session_start"), "window_end": F.col("session_end"), "_slot": F.window("session_end", slot)["start"]})
    base = D.with_mahalanobis(placed, SESSION_FEATURES, ["_slot"], 20, t["zscore_threshold"]).filter(F.col("requests") >= min_requests)
    pace = rule(soft_score(F.col("requests_per_minute"), 90.0), F.concat(D.number(F.col("requests_per_minute"), 0), F.lit(" requests a minute")))
    return make_anomalies(base, "session_anomaly", "session", F.col("session_id"), [pace, F.col("mahalanobis")], F.concat(F.lit("Abnormal session "), F.col("session_id")), SESSION_FEATURES)


def closed_unscored(rows: DataFrame, scored: DataFrame, keys: list[str], now, watermark: str = "2 minutes") -> DataFrame:
    """Rows of windows that ended before the watermark and have not been scored."""
    closed = rows.filter(F.col("window_end") <= F.lit(now).cast("timestamp") - F.expr(f"interval {watermark}"))
    return closed.join(scored.select(*keys).distinct(), keys, "left_anti")


def rescore(tables: dict[str, DataFrame], thresholds: dict | None = None, **gates) -> DataFrame:
    """All anomalies of stored metrics: a range is recomputed and replaced as a whole.

    ``gates``: further arguments by table, a trained forest among them (``metrics_global={"forest": ...}``).
    """
    jobs = {"metrics_global": analyze_global, "metrics_endpoint": analyze_endpoints, "metrics_ip": analyze_ips, "metrics_geo": analyze_geo, "sessions": analyze_sessions}
    return dedupe(_union([job(tables[name], thresholds, **gates.get(name, {})) for name, job in jobs.items() if name in tables]))


