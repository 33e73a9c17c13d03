"""Forests and profiles against planted cases, chunks against whole series, folds against a plain version."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import analyzers as A
from tidegauge.operators import detectors as D
from tidegauge.operators import incidents as G
from tidegauge.operators import learning as L
from tidegauge.operators import metrics as M
from tidegauge.operators import reports as R
from tidegauge.sources.events import sample_events

T0 = datetime(2026, 8, 18, 6, 0)


def global_rows(spark, n, change=lambda i, r: r, minutes=1):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        r = {
            "window_start": T0 + timedelta(minutes=minutes * i), "window_end": T0 + timedelta(minutes=minutes * (i + 1)), "requests": 7200 + rng.randint(-200, 200), "rps": 120.0, "error_rate": rng.uniform(0.012, 0.016), "server_error_rate": 0.003,
            "p95_response_time": 320.0 + rng.uniform(-20, 20), "p99_response_time": 700.0, "unique_ips": 900 + rng.randint(-5, 5), "unique_sessions": 1400, "bytes_per_request": 22_000.0 + rng.uniform(-50, 50), "ip_gini": 0.35, "path_entropy": 0.86, "bot_ratio": 0.06, "dominant_attack_label": None,
        }
        rows.append(change(i, r))
    schema = "window_start timestamp, window_end timestamp, requests bigint, rps double, error_rate double, server_error_rate double, p95_response_time double, p99_response_time double, unique_ips bigint, unique_sessions bigint, bytes_per_request double, ip_gini double, path_entropy double, bot_ratio double, dominant_attack_label string"
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def test_forest_ranks_a_planted_outlier_first_and_joins_the_jobs(spark):
    odd = lambda i, r: r | ({"error_rate": 0.5, "p95_response_time": 5000.0, "unique_ips": 20, "bytes_per_request": 100.0} if i == 300 else {})
    rows = global_rows(spark, 320, odd)
    features = ["error_rate", "p95_response_time", "unique_ips", "bytes_per_request"]
    forest, meta = L.train_forest(rows, features, trees=40)
    scored = L.detector(forest, meta)(rows).select("window_start", "isolation_forest.score", "isolation_forest.triggered").orderBy(F.desc("score")).collect()
    assert scored[0]["window_start"] == T0 + timedelta(minutes=300) and scored[0]["triggered"]
    assert scored[0]["score"] > scored[1]["score"] and sum(r["triggered"] for r in scored) <= 20
    # the job hands the forest's verdict on: a quiet window that only the forest finds odd
    shout = lambda df: df.withColumn("isolation_forest", D.result("isolation_forest", F.when(F.col("window_start") == F.lit(T0 + timedelta(minutes=100)), 0.9).otherwise(0.0), F.lit(True), F.lit("odd"), {}, F.lit(True)))
    plain = A.analyze_global(global_rows(spark, 120)).filter("type = 'multivariate_anomaly'").collect()
    found = A.analyze_global(global_rows(spark, 120), forest=shout).filter("type = 'multivariate_anomaly'").collect()
    assert {r["window_start"] for r in found} - {r["window_start"] for r in plain} == {T0 + timedelta(minutes=100)}
    assert any("isolation_forest" in r["detectors"] for r in found)
    same = A.rescore({"metrics_global": global_rows(spark, 120)}, metrics_global={"forest": shout}).filter("type = 'multivariate_anomaly'").count()
    assert same == len(found)


def test_profiles_find_known_centres(spark):
    levels = (100, 1000, 10_000)
    rows = global_rows(spark, 72, lambda i, r: r | {"requests": levels[i // 24] + i % 3, "error_rate": 0.01, "p95_response_time": 300.0, "unique_ips": 900}, 60)
    got = L.traffic_profiles(rows, clusters=3).orderBy("avg_requests").collect()
    assert [r["hours"] for r in got] == [24, 24, 24] and [r["name"] for r in got] == ["quiet", "off-peak", "steady"]
    assert [r["avg_requests"] for r in got] == pytest.approx([101, 1001, 10_001])


def test_chunks_see_the_same_history_as_the_whole_series(spark):
    rows = global_rows(spark, 400, minutes=31)
    whole = D.with_history(rows.withColumn("chunk", F.lit(0)), ["requests"], ["chunk"], 30_000)
    parts = D.with_history(D.chunked(rows, 30_000, 40_000), ["requests"], ["chunk"], 30_000).filter("own")
    a, b = ({r["window_start"]: r["h_requests"] for r in x.collect()} for x in (whole, parts))
    assert a == b and len(a) == 400
    seasonal = [D.with_seasonal_history(x, ["requests"], ["chunk"], 300_000) for x in (rows.withColumn("chunk", F.lit(0)), D.chunked(rows, 300_000))]
    a, b = ({r["window_start"]: sorted(r["s_requests"]) for r in x.collect()} for x in (seasonal[0], seasonal[1].filter("own")))
    assert a == b
    assert D.chunked(rows, 30_000).count() <= 2 * 400


def test_incidents_equal_a_plain_fold(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):  # campaigns of many sources: hundreds of anomalies in a window
        at = T0 + timedelta(minutes=rng.choice([0, 0, 1, 2, 3, 40, 41, 90]))
        rows.append((f"a{i:04d}", rng.choice(["ddos_burst", "endpoint_scan"]), "ip", f"10.0.0.{rng.randint(0, 90)}", float(rng.choice([0, 31, 55.5, 72, 90.25])), rng.choice(["low", "medium", "high"]), rng.choice(["rule", "ewma"]), "why", f"h{i}", at, {"requests": 2.0}, None))
    schema = "anomaly_id string, type string, entity_type string, entity string, score double, severity string, detector string, reason string, headline string, window_start timestamp, metrics map<string,double>, ground_truth string"
    found = G.correlate(spark.createDataFrame(rows, schema), 10)
    got = {r["started_at"]: r for r in G.fold_incidents(found).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[9], r[0])):
        start = max((s for s in by if (r[9] - max(x[9] for x in by[s])).total_seconds() <= 600), default=r[9])
        by.setdefault(start, []).append(r)
    assert set(got) == set(by) and len(by) == 3
    for start, own in by.items():
        peak, score = 0.0, own[0][4]
        for r in own:
            peak = max(peak, r[4])
            score = round(0.7 * peak + 0.3 * (r[4] if score == 0 else score) + 1e-12, 2)
        g = got[start]
        assert (g["anomaly_count"], g["peak_score"], g["impact_requests"]) == (len(own), peak, 2 * len(own)) and g["score"] == pytest.approx(score, abs=0.011)
        assert g["anomaly_ids"] == [r[0] for r in own][-500:]
        assert g["entities"] == list(dict.fromkeys(r[3] for r in own))[:50]
        assert g["detectors"] == list(dict.fromkeys(r[6] for r in own)) and g["types"] == list(dict.fromkeys(r[1] for r in own))
        firsts = {}
        for r in own:
            firsts.setdefault(r[9], r)
        assert [(t["at"], t["reason"]) for t in g["timeline"]] == [(at, r[8]) for at, r in firsts.items()][-120:]


def test_every_tracked_code_is_counted(spark):
    codes = [200, 201, 204, 206, 301, 302, 304, 400, 401, 403, 404, 409, 422, 429, 500, 502, 503, 504]
    rows = [(T0, c, "GET", "1.1.1.1", "s", "u", "/x", 1.0, 10, False, False, None, c >= 400 and c < 500, c >= 500, c >= 400, 1.0, None) for c in [*codes, 418]]
    df = spark.createDataFrame(rows, "event_time timestamp, status int, method string, ip string, session_id string, user_id string, endpoint string, response_time_ms double, bytes_sent bigint, is_bot boolean, is_cache_hit boolean, attack_label string, is_client_error boolean, is_server_error boolean, is_error boolean, apdex_weight double, ingest_latency_ms double")
    row = M.global_metrics(df).first()
    assert row["status_counts"] == {str(c): 1 for c in codes} and row["requests"] == 19
    classes = {r["status_class"]: r["requests"] for r in M.status_classes_of(M.global_metrics(df)).collect()}
    assert classes == {"2xx": 4, "3xx": 3, "4xx": 7, "5xx": 4}


def test_samples(spark):
    df = spark.range(20_000).withColumn("event_id", F.col("id").cast("string"))
    a, b = (sample_events(df.repartition(n), 0.1, key="event_id").select("event_id").collect() for n in (3, 7))
    assert sorted(a) == sorted(b) and 1800 < len(a) < 2200
    events = df.select("event_id", F.lit("c").alias("country"), F.lit("x").alias("city"), F.lit(False).alias("is_error"), F.lit(1.0).alias("response_time_ms"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(None).cast("string").alias("attack_label"))
    assert 800 < R.geo_points(events, 1000).first()["requests"] < 1200 and R.geo_points(events, 20_000).first()["requests"] == 20_000
