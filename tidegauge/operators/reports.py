"""Tables, profiles and drill-downs over logs, metrics, anomalies and incidents.

Top-k is sort with limit (one bounded heap a task) or a ranked window a group; rows of one entity are
found by filter; lists inside a row hold at most as many items as their report shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.stats import severity_rank
from tidegauge.operators.series import bucket, kpi_deltas, kpi_totals, timeseries
from tidegauge.operators.sketches import range_metric

COUNT_CAP = 200_000
SORTS = {"timestamp": "event_time", "latency": "response_time_ms", "status": "status", "bytes": "bytes_sent"}
ATTACKS = ("ddos_burst", "endpoint_scan", "auth_abuse", "data_scraping", "suspicious_ip", "geo_anomaly", "bot_surge")


def ratio(top: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(top, whole), F.lit(0.0))


def search_logs(events: DataFrame, sort: str = "timestamp", descending: bool = True, limit: int = 50, offset: int = 0, cap: int = COUNT_CAP) -> tuple[DataFrame, DataFrame]:
    """A page of (already filtered) events, and their number up to a cap (with a flag)."""
    key = F.col(SORTS.get(sort, "event_time"))
    page = events.orderBy(key.desc() if descending else key.asc(), "event_id").offset(offset).limit(limit)
    count = events.select(F.lit(1).alias("x")).limit(cap + 1).agg(F.least(F.count("*"), F.lit(cap)).alias("total"), (F.count("*") > cap).alias("capped"))
    return page, count


def event_context(events: DataFrame, ip_rows: DataFrame, event_id: str) -> dict[str, DataFrame]:
    """One event, its session's trail and its address's latest windows."""
    one = events.filter(F.col("event_id") == event_id).limit(1)
    trail = events.join(F.broadcast(one.select("session_id")), "session_id", "left_semi").orderBy("event_time", "event_id").limit(80)
    windows = ip_rows.join(F.broadcast(one.select("ip")), "ip", "left_semi").orderBy(F.desc("window_start")).limit(20)
    return {"event": one, "session": trail, "ip_windows": windows}


def overview(global_rows: DataFrame, anomalies: DataFrame, incidents: DataFrame, alerts: DataFrame, start, end) -> dict[str, DataFrame]:
    high = F.lit(end).cast("timestamp")
    live = incidents.filter(F.col("status").isin("open", "acknowledged"))
    return {
        "totals": kpi_totals(global_rows, start, end),
        "deltas": kpi_deltas(global_rows, start, end),
        "series": timeseries(global_rows.filter(F.col("window_start").between(F.lit(start).cast("timestamp"), high)), ["requests", "error_rate", "p95_response_time"], "auto"),
        "anomalies": anomalies.filter(F.col("window_start").between(F.lit(start).cast("timestamp"), high)).groupBy("severity").agg(F.count("*").alias("n")),
        "open_incidents": live.agg(F.count("*").alias("n")),
        "firing_alerts": alerts.filter((F.col("fired_at") >= high - F.expr("interval 1 hour")) & (F.col("fired_at") <= high)).agg(F.count("*").alias("n")),
        "top_incidents": live.orderBy(severity_rank(F.col("severity")).desc(), F.desc("score"), "incident_id").limit(5),
    }


def endpoint_table(rows: DataFrame, sort: str = "requests", limit: int | None = 50, service: str | None = None, search: str | None = None) -> DataFrame:
    """Endpoints of a range: sums, percentiles, share of traffic and latency budget.

    Percentiles and distinct addresses are those of the range where rows keep sketches, else the mean and
    the largest of the windows.
    """
    rows = rows.filter(F.col("service") == service) if service else rows
    rows = rows.filter(F.lower("endpoint").contains(search.lower())) if search else rows
    grouped = rows.groupBy("endpoint", "method").agg(
        F.sum("requests").alias("requests"),
        F.sum("errors").alias("errors"),
        F.sum("errors_5xx").alias("errors_5xx"),
        *[F.round(F.avg(c) if range_metric(rows, c) is None else range_metric(rows, c), 2).alias(c) for c in ("p50_response_time", "p95_response_time", "p99_response_time")],
        F.round(F.avg("avg_response_time"), 2).alias("avg_response_time"),
        F.round(F.avg("apdex"), 4).alias("apdex"),
        F.sum("bytes_sent").alias("bytes_sent"),
        (F.max("unique_ips") if range_metric(rows, "unique_ips") is None else range_metric(rows, "unique_ips")).cast("bigint").alias("unique_ips"),
    )
    total = grouped.agg(F.sum("requests").alias("_all"))  # one row
    out = grouped.crossJoin(F.broadcast(total)).withColumns({
        "traffic_share": F.round(ratio(F.col("requests"), F.col("_all")), 5),
        "error_rate": F.round(ratio(F.col("errors"), F.col("requests")), 5),
        "latency_budget": F.round(F.col("p95_response_time") / 500, 3),
    }).drop("_all")
    key = F.asc("apdex") if sort == "apdex" else F.desc(sort)
    return out if limit is None else out.orderBy(key, "endpoint", "method").limit(limit)


def endpoint_sparklines(rows: DataFrame, top: int = 20, seconds: int = 60) -> DataFrame:
    """Series of the busiest endpoints as an array."""
    busy = rows.groupBy("endpoint", "method").agg(F.sum("requests").alias("requests")).orderBy(F.desc("requests"), "endpoint", "method").limit(top)
    keys = ["endpoint", "method"]
    points = rows.join(F.broadcast(busy.select(*keys)), keys, "left_semi").groupBy(*keys, bucket(max(60, seconds)).alias("t")).agg(F.sum("requests").alias("requests"), F.round(F.avg("p95_response_time"), 2).alias("p95"))
    lists = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "requests", "p95"))).alias("points"))
    return busy.join(lists, keys, "left")


def endpoint_detail(rows: DataFrame, anomalies: DataFrame, events: DataFrame, endpoint: str, seconds: int = 300) -> dict[str, DataFrame]:
    own, logs = rows.filter(F.col("endpoint") == endpoint), events.filter(F.col("endpoint") == endpoint)
    return {
        "series": own.groupBy(bucket(seconds).alias("t")).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.avg("p95_response_time").alias("p95_response_time")).orderBy("t"),
        "summary": endpoint_table(own, limit=10),
        "anomalies": anomalies.filter((F.col("entity_type") == "endpoint") & (F.col("entity") == endpoint)).orderBy(F.desc("window_start"), "anomaly_id").limit(60),
        "slowest": logs.orderBy(F.desc("response_time_ms"), "event_id").limit(20),
        "errors": logs.filter(F.col("status") >= 400).orderBy(F.desc("event_time"), "event_id").limit(20),
    }


def endpoint_highlights(table: DataFrame) -> DataFrame:
    """Totals, slowest and worst of an endpoint table."""
    return table.agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.count("*").alias("endpoints"),
        F.max_by("endpoint", F.struct("p95_response_time", "endpoint")).alias("slowest"), F.max("p95_response_time").alias("slowest_p95"),
        F.min_by("endpoint", F.struct("apdex", "endpoint")).alias("worst"), F.min("apdex").alias("worst_apdex"),
    )


def service_rollup(rows: DataFrame) -> DataFrame:
    grouped = rows.groupBy("service").agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum("errors_5xx").alias("errors_5xx"),
        F.round(F.avg("avg_response_time"), 2).alias("avg_response_time"), F.round(F.avg("p95_response_time"), 2).alias("p95_response_time"), F.round(F.avg("p99_response_time"), 2).alias("p99_response_time"),
        F.round(F.avg("apdex"), 4).alias("apdex"), F.max("unique_hosts").alias("unique_hosts"),
    )
    error, server = F.round(ratio(F.col("errors"), F.col("requests")), 5), F.round(ratio(F.col("errors_5xx"), F.col("requests")), 5)
    status = F.when(F.col("server_error_rate") > 0.05, "critical").when((F.col("error_rate") > 0.08) | (F.col("apdex") < 0.85), "degraded").otherwise("healthy")
    return grouped.withColumn("error_rate", error).withColumn("server_error_rate", server).withColumn("status", status)


def session_analytics(sessions: DataFrame, limit: int = 50, offset: int = 0) -> dict[str, DataFrame]:
    summary = sessions.agg(
        F.count("*").alias("sessions"), F.round(F.avg("duration_seconds"), 2).alias("avg_duration"), F.round(F.avg("requests"), 4).alias("avg_requests"), F.round(F.avg("unique_endpoints"), 4).alias("avg_endpoints"),
        F.round(F.avg(F.col("converted").cast("double")), 5).alias("conversion_rate"), F.round(F.avg(F.col("is_bot").cast("double")), 5).alias("bot_share"),
    )
    ends = {c: sessions.groupBy(f"{c}_endpoint").agg(F.count("*").alias("sessions")).orderBy(F.desc("sessions"), f"{c}_endpoint").limit(10) for c in ("entry", "exit")}
    return {"page": sessions.orderBy(F.desc("session_start"), "session_id").offset(offset).limit(limit), "summary": summary, **ends}


def session_trail(sessions: DataFrame, events: DataFrame, anomalies: DataFrame, session_id: str) -> dict[str, DataFrame]:
    return {
        "session": sessions.filter(F.col("session_id") == session_id),
        "events": events.filter(F.col("session_id") == session_id).orderBy("event_time", "event_id").limit(500),
        "anomalies": anomalies.filter((F.col("entity_type") == "session") & (F.col("entity") == session_id)).orderBy(F.desc("window_start"), "anomaly_id").limit(20),
    }


def geo_summary(geo_rows: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Countries with their share of traffic and the strongest anomaly."""
    last = lambda c: F.max_by(c, F.struct("window_start", c)).alias(c)
    grouped = geo_rows.groupBy("country").agg(
        F.sum("requests").alias("requests"), F.max("unique_ips").alias("unique_ips"), ratio(F.sum(F.col("error_rate") * F.col("requests")), F.sum("requests")).alias("error_rate"),
        F.avg("p95_response_time").alias("p95_response_time"), F.sum("bytes_sent").alias("bytes_sent"), last("country_name"), last("lat"), last("lon"),
    )
    total = grouped.agg(F.sum("requests").alias("_all"))
    threat = anomalies.filter(F.col("entity_type") == "country").groupBy(F.col("entity").alias("country")).agg(F.max("score").alias("threat_score"), F.count("*").alias("anomalies"))
    out = grouped.join(threat, "country", "left").crossJoin(F.broadcast(total))
    return out.withColumn("share", F.round(ratio(F.col("requests"), F.col("_all")), 5)).drop("_all").fillna(0, ["threat_score", "anomalies"])


def geo_timeseries(geo_rows: DataFrame, countries: list[str] | None = None, seconds: int = 300, top: int = 6) -> DataFrame:
    """Requests by bucket and country, zero-filled in wide form; the busiest countries by default."""
    if not countries:
        countries = [r[0] for r in geo_rows.groupBy("country").agg(F.sum("requests").alias("n")).orderBy(F.desc("n"), "country").limit(top).collect()]
    rows = geo_rows.filter(F.col("country").isin(countries))
    return rows.groupBy(bucket(max(300, seconds)).alias("t")).pivot("country", countries).agg(F.sum("requests")).fillna(0)


#: Slots of the histogram by which the smallest hashes of a table are found.
SAMPLE_SLOTS = 1 << 16


def exact_sample(df: DataFrame, n: int, seed: int = 7, key: str = "event_id") -> DataFrame:
    """Exactly ``n`` rows of ``df`` (all, if there are no more): those of the smallest hashes of ``key``.

    The same rows come out under any partitioning.  A histogram of the hashes, a table of at most ``SAMPLE_SLOTS`` rows, tells
    how many slots hold ``n`` rows; only rows of those slots, ``n`` and some of the last slot, are put in order.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    placed = df.withColumn("_hash", digest).withColumn("_slot", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    slots = placed.groupBy("_slot").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = slots.withColumn("_before", before).filter(F.col("_before") < n).select("_slot")
    return placed.join(F.broadcast(wanted), "_slot", "left_semi").orderBy("_hash", key).limit(n).drop("_hash", "_slot")


def geo_points(events: DataFrame, n: int = 20_000, limit: int = 400, seed: int = 7) -> DataFrame:
    """Cities of a sample of ``n`` events (all, if there are no more), weighted by the largest."""
    sample = exact_sample(events, n, seed)
    grouped = sample.groupBy("country", "city").agg(
        F.count("*").alias("requests"), F.avg(F.col("is_error").cast("double")).alias("error_rate"), F.avg("response_time_ms").alias("avg_response_time"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.bool_or(F.col("attack_label").isNotNull()).alias("hostile"),
    )
    most = grouped.agg(F.max("requests").alias("_most"))
    return grouped.crossJoin(F.broadcast(most)).withColumn("weight", F.col("requests") / F.col("_most")).drop("_most").orderBy(F.desc("requests"), "country", "city").limit(limit)


def ip_table(ip_rows: DataFrame, anomalies: DataFrame, sort: str = "requests", limit: int = 100, suspicious_only: bool = False) -> DataFrame:
    """Sources with their sums and the strongest anomaly of each."""
    last = lambda c: F.max_by(c, F.struct("window_start", c)).alias(c)
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("requests")), F.sum("requests")).alias(c)
    grouped = ip_rows.groupBy("ip").agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.sum("auth_fail_count").alias("auth_fail_count"), F.sum("bytes_sent").alias("bytes_sent"),
        weighted("error_ratio"), weighted("not_found_ratio"), F.max("unique_paths").alias("unique_paths"), F.max("rps").alias("peak_rps"), F.max("burstiness").alias("burstiness"),
        last("country"), last("asn"), last("org"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count("*").alias("windows"),
    )
    threat = anomalies.filter(F.col("entity_type") == "ip").groupBy(F.col("entity").alias("ip")).agg(
        F.max("score").alias("threat_score"), F.count("*").alias("anomalies"), F.array_sort(F.collect_set("type")).alias("types"), F.max_by("severity", F.struct("window_start", "anomaly_id")).alias("severity")
    )
    out = grouped.join(threat, "ip", "inner" if suspicious_only else "left").fillna(0, ["threat_score", "anomalies"])
    return out.orderBy(F.desc(sort), "ip").limit(limit)


def ip_profile(ip_rows: DataFrame, anomalies: DataFrame, events: DataFrame, ip: str, start=None, end=None) -> dict[str, DataFrame]:
    own = ip_rows.filter(F.col("ip") == ip)
    ranged = own.filter(F.col("window_start").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))) if start is not None else own
    series = ranged if start is not None and not ranged.isEmpty() else own.orderBy(F.desc("window_start")).limit(120)
    paths = own.select(F.explode("sample_paths").alias("endpoint")).groupBy("endpoint").agg(F.count("*").alias("windows")).orderBy(F.desc("windows"), "endpoint").limit(15)
    return {
        "series": series.orderBy("window_start"),
        "summary": own.agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.max("rps").alias("peak_rps"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count("*").alias("windows")),
        "paths": paths,
        "anomalies": anomalies.filter((F.col("entity_type") == "ip") & (F.col("entity") == ip)).orderBy(F.desc("window_start"), "anomaly_id").limit(80),
        "logs": events.filter(F.col("ip") == ip).orderBy(F.desc("event_time"), "event_id").limit(60),
    }


def security_summary(anomalies: DataFrame, top: int = 15) -> dict[str, DataFrame]:
    ips = anomalies.filter(F.col("entity_type") == "ip")
    attackers = ips.groupBy("entity").agg(F.max("score").alias("score"), F.count("*").alias("anomalies"), F.array_sort(F.collect_set("type")).alias("types"), F.max("window_start").alias("last_seen"))
    return {
        "attackers": attackers.orderBy(F.desc("score"), "entity").limit(top),
        "attack_counts": anomalies.agg(*[F.count_if(F.col("type") == t).alias(t) for t in ATTACKS]),
        "severe": ips.agg(F.count_if(F.col("severity").isin("high", "critical")).alias("severe_ip_anomalies")),
    }


def anomaly_summary(anomalies: DataFrame, seconds: int = 3600, top: int = 12) -> dict[str, DataFrame]:
    return {
        "by_type": anomalies.groupBy("type").agg(F.count("*").alias("n"), F.max("score").alias("max_score"), F.round(F.avg("score"), 2).alias("avg_score")),
        "by_severity": anomalies.groupBy("severity").agg(F.count("*").alias("n")),
        "timeline": anomalies.groupBy(bucket(seconds).alias("t")).pivot("severity", ["low", "medium", "high", "critical"]).count().fillna(0),
        "entities": anomalies.groupBy("entity_type", "entity").agg(F.count("*").alias("n"), F.max("score").alias("max_score")).orderBy(F.desc("n"), F.desc("max_score"), "entity_type", "entity").limit(top),
    }


def anomaly_detail(anomalies: DataFrame, incidents: DataFrame, families: dict[str, DataFrame], events: DataFrame, anomaly_id: str, kind: str = "global") -> dict[str, DataFrame]:
    """An anomaly with its incident, the last windows of its own metric family, and logs of an address.

    There are no logs of others; an unknown anomaly has neither logs nor windows, these in the columns of the family of ``kind``.
    """
    one = anomalies.filter(F.col("anomaly_id") == anomaly_id).limit(1)
    row = one.select("entity_type", "entity", "window_start").first()
    kind = kind if row is None else row["entity_type"]
    own = F.col("ip") == row["entity"] if row is not None and kind == "ip" else F.lit(False)
    table = families[{"ip": "metrics_ip", "endpoint": "metrics_endpoint", "country": "metrics_geo"}.get(kind, "metrics_global")]
    past = F.lit(False) if row is None else F.col("window_start") <= F.lit(row["window_start"])
    if row is not None and kind in ("ip", "endpoint", "country"):
        past = past & (F.col(kind) == row["entity"])
    return {
        "anomaly": one,
        "incident": incidents.filter(F.array_contains("anomaly_ids", anomaly_id)),
        "windows": table.filter(past).orderBy(F.desc("window_start")).limit(90).orderBy("window_start"),
        "logs": events.filter(own).orderBy(F.desc("event_time"), "event_id").limit(25),
    }


def incident_detail(incidents: DataFrame, anomalies: DataFrame, alerts: DataFrame, global_rows: DataFrame, incident_id: str) -> dict[str, DataFrame]:
    one = incidents.filter(F.col("incident_id") == incident_id).limit(1)
    ids = one.select(F.explode("anomaly_ids").alias("anomaly_id"))
    spanned = F.broadcast(one.select("started_at", "last_seen_at"))
    inside = (F.col("window_start") >= F.col("started_at")) & (F.col("window_start") <= F.col("last_seen_at"))
    return {
        "incident": one,
        "anomalies": anomalies.join(ids, "anomaly_id", "left_semi").orderBy("window_start", "anomaly_id").limit(500),
        "alerts": alerts.join(ids, "anomaly_id", "left_semi").orderBy(F.desc("fired_at"), "alert_id").limit(50),
        "metrics": global_rows.join(spanned, inside).drop("started_at", "last_seen_at").orderBy("window_start"),
    }


def live_snapshot(global_rows: DataFrame, anomalies: DataFrame, incidents: DataFrame, now, since) -> dict[str, DataFrame]:
    at = F.lit(now).cast("timestamp")
    past = global_rows.filter(F.col("window_start") <= at)
    return {
        "latest": past.orderBy(F.desc("window_start")).limit(1),
        "recent": past.filter(F.col("window_start") >= at - F.expr("interval 5 minutes")).orderBy(F.desc("window_start")).limit(10),
        "anomalies": anomalies.filter(F.col("detected_at") > F.lit(since).cast("timestamp")).orderBy(F.desc("detected_at"), "anomaly_id").limit(25),
        "open_incidents": incidents.filter(F.col("status").isin("open", "acknowledged")).agg(F.count("*").alias("n")),
    }


