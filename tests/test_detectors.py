"""Statistics, detectors and detection jobs."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import stats as S
from tidegauge.operators import analyzers as A
from tidegauge.operators import detectors as D

T0 = datetime(2026, 8, 18, 6, 0)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("r")).first()["r"]


def test_robust_stats_match_numpy(spark):
    rng = random.Random(1)
    for h in ([rng.gauss(100, 5) for _ in range(41)], [5.0] * 9, [1.0, 1.0, 1.0, 9.0], []):
        got = one(spark, S.robust_stats(F.col("h")), h=h)
        if not h:
            assert got["n"] == 0
            continue
        m = float(np.median(h))
        sigma = 1.4826 * float(np.median(np.abs(np.array(h) - m)))
        sigma = sigma if sigma >= 1e-9 else float(np.std(h))
        sigma = sigma if sigma >= 1e-9 else max(abs(m) * 0.1, 1.0)
        assert (got["median"], got["sigma"]) == pytest.approx((m, sigma))


def test_soft_score(spark):
    assert one(spark, S.soft_score(F.col("z"), 3.5), z=3.5) == pytest.approx(0.5)
    assert one(spark, S.soft_score(F.col("z"), 3.5), z=7.0) > 0.9
    assert one(spark, S.soft_score(F.col("z"), 3.5), z=float("nan")) == 0


def test_ewma_forecast_and_cold_start(spark):
    r = one(spark, D.ewma(F.col("h"), F.col("v")), h=[500.0] * 40, v=2500.0)
    assert float(r["evidence"]["forecast"]) == pytest.approx(500, abs=1) and r["triggered"]
    assert one(spark, D.ewma(F.col("h"), F.col("v")), h=[500.0] * 5, v=2500.0)["cold"]


def test_trend_ramp_is_quiet_and_spike_is_not(spark):
    rng = random.Random(3)
    ramp = [5000 + 100 * i + rng.gauss(0, 40) for i in range(60)]
    quiet = one(spark, D.trend(F.col("h"), F.col("v")), h=ramp, v=5000 + 100 * 60.0)
    loud = one(spark, D.trend(F.col("h"), F.col("v")), h=ramp, v=33_000.0)
    assert quiet["score"] < 0.2 < 0.9 < loud["score"]
    assert float(loud["evidence"]["slope_per_window"]) == pytest.approx(100, abs=15)
    dirty = one(spark, D.trend(F.col("h"), F.col("v")), h=[1000.0] * 20 + [90_000.0] + [1000.0] * 20, v=1000.0)
    assert abs(float(dirty["evidence"]["slope_per_window"])) < 5 and not dirty["triggered"]


def test_cusum_sees_a_lasting_shift(spark):
    r = one(spark, D.cusum(F.col("h"), F.col("v")), h=[0.01 + 0.0001 * (i % 3) for i in range(30)] + [0.06] * 12, v=0.06)
    assert r["score"] > 0.9 and r["evidence"]["direction"] == "increase"


def test_shape(spark):
    assert one(spark, S.norm_entropy(F.col("x")), x=[5.0] * 20) == pytest.approx(1)
    assert one(spark, S.gini(F.col("x")), x=[5.0] * 20) == pytest.approx(0)
    assert one(spark, S.norm_entropy(F.col("x")), x=[1000.0] + [1.0] * 19) < 0.35
    assert one(spark, S.gini(F.col("x")), x=[1000.0] + [1.0] * 19) > 0.85


def test_fusion_rewards_agreement(spark):
    def fused(scores):
        return spark.range(1).select(S.fuse(F.array(*[S.rule(F.lit(s), F.lit("r")) for s in scores])).alias("f")).first()["f"]

    assert fused([0.8, 0.75, 0.7])["agreement"] == 3
    assert fused([0.8, 0.75, 0.7])["score"] >= fused([0.8])["score"]
    assert fused([0.8, 0.0])["score"] == pytest.approx(fused([0.8])["score"])


def history(spark, last, n=90):
    rng = random.Random(5)
    base = lambda i: dict(window_start=T0 + timedelta(minutes=i), window_end=T0 + timedelta(minutes=i + 1), requests=7200 + rng.randint(-200, 200), rps=120.0, error_rate=rng.uniform(0.012, 0.016), server_error_rate=0.003, errors_4xx=80, errors_5xx=20, p95_response_time=320.0 + rng.uniform(-20, 20), p99_response_time=700.0, unique_ips=900, unique_sessions=1400, bytes_per_request=22000.0, ip_gini=0.35, path_entropy=0.86, bot_ratio=0.06)
    data = [base(i) for i in range(n)] + [base(n) | last]
    return spark.createDataFrame([tuple(r.values()) for r in data], "window_start timestamp, window_end timestamp, requests bigint, rps double, error_rate double, server_error_rate double, errors_4xx bigint, errors_5xx bigint, p95_response_time double, p99_response_time double, unique_ips bigint, unique_sessions bigint, bytes_per_request double, ip_gini double, path_entropy double, bot_ratio double")


@pytest.mark.parametrize(
    ("last", "wanted"),
    [
        ({"requests": 45000, "rps": 750.0}, "traffic_spike"),
        ({"requests": 30000, "ip_gini": 0.94, "path_entropy": 0.12, "unique_ips": 22}, "ddos_burst"),
        ({"error_rate": 0.42, "server_error_rate": 0.33, "errors_5xx": 2400}, "error_spike"),
        ({"p95_response_time": 2400.0}, "latency_anomaly"),
        ({}, None),
    ],
)
def test_global_job(spark, last, wanted):
    end = T0 + timedelta(minutes=90)
    found = A.analyze_global(history(spark, last)).filter(F.col("window_start") == end).collect()
    kinds = {r["type"]: r for r in found}
    if wanted is None:
        assert not kinds
    else:
        assert wanted in kinds
        assert kinds[wanted]["score"] > 60
    if wanted == "traffic_spike":
        assert "ddos_burst" not in kinds and len(kinds[wanted]["contributing"]) >= 2


def ips(spark, extra, n=40):
    base = dict(window_start=T0, window_end=T0 + timedelta(minutes=1), ip="", requests=40, unique_paths=3, unique_user_agents=1, error_ratio=0.02, not_found_ratio=0.01, auth_fail_count=0, avg_response_time=180.0, bytes_per_request=20000.0, path_entropy=0.4, burstiness=1.2, bytes_sent=800000)
    data = [base | {"ip": f"10.0.0.{i}", "requests": 40 + i % 5, "avg_response_time": 180.0 + i % 7} for i in range(n)] + ([base | {"ip": "bad"} | extra] if extra else [])
    return spark.createDataFrame([tuple(r.values()) for r in data], "window_start timestamp, window_end timestamp, ip string, requests bigint, unique_paths bigint, unique_user_agents bigint, error_ratio double, not_found_ratio double, auth_fail_count bigint, avg_response_time double, bytes_per_request double, path_entropy double, burstiness double, bytes_sent bigint")


@pytest.mark.parametrize(("extra", "wanted"), [({"requests": 220, "unique_paths": 180, "not_found_ratio": 0.88, "path_entropy": 0.97}, "endpoint_scan"), ({"requests": 90, "auth_fail_count": 84}, "auth_abuse"), ({"requests": 5, "error_ratio": 1.0}, None), (None, None)])
def test_ip_job(spark, extra, wanted):
    found = A.analyze_ips(ips(spark, extra, 60)).collect()
    assert {r["entity"] for r in found} == ({"bad"} if wanted else set())
    assert wanted is None or wanted in {r["type"] for r in found}


def test_geo_share_and_new_origin(spark):
    rows = []
    for w in range(31):
        volume = 1000 * (1 + w / 6)
        rows += [(T0 + timedelta(minutes=5 * w), T0 + timedelta(minutes=5 * w + 5), f"C{k}", int(volume * (k + 1)), 0.01, 10, 200.0) for k in range(7)]
    cols = "window_start timestamp, window_end timestamp, country string, requests bigint, error_rate double, unique_ips bigint, p95_response_time double"
    late = F.col("window_start") >= rows[-1][0]  # in the first windows every origin is new
    assert A.analyze_geo(spark.createDataFrame(rows, cols)).filter(late).count() == 0
    last = rows[-1][0]
    found = A.analyze_geo(spark.createDataFrame([*rows, (last, last + timedelta(minutes=5), "BG", 10_000, 0.01, 10, 200.0)], cols)).filter(late).collect()
    assert [(r["entity"], r["type"]) for r in found] == [("BG", "geo_anomaly")]


def test_mahalanobis_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    x[:, 2] = 7.0  # a constant feature: the covariance has no inverse
    x[0] = [9.0, -9.0, 7.0]
    df = spark.createDataFrame([(i, "w", *map(float, r)) for i, r in enumerate(x)], "i int, w string, a double, b double, c double")
    got = {r["i"]: float(r["mahalanobis"]["evidence"]["distance"]) for r in D.with_mahalanobis(df, ["a", "b", "c"], ["w"]).collect()}
    inverse = np.linalg.pinv(np.cov(x, rowvar=False) + np.eye(3) * 1e-6)
    for i, r in enumerate(x - np.median(x, axis=0)):
        assert got[i] == pytest.approx(math.sqrt(r @ inverse @ r), abs=2e-3)
