"""The sorted pass over a long series against plain folds, NumPy and the detectors over arrays."""

import random
import re
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_detectors import history
from tidegauge.operators import analyzers as A
from tidegauge.operators import detectors as D
from tidegauge.operators import sliding as W


def frames(rng, n, longest):
    a = np.sort(rng.integers(0, n, n // 2))
    return a, np.maximum.accumulate(np.minimum(n, a + rng.integers(0, longest, len(a))))


@pytest.mark.parametrize("levels", [3, 50, 10_000])
def test_median_mad_and_sigma(levels):
    rng = np.random.default_rng(levels)
    v = np.round(rng.normal(size=600), 2) if levels > 1000 else rng.integers(0, levels, 600).astype(float)
    v[100:200] = 7.0
    a, b = frames(rng, 600, 90)
    for (n, m, mad, sigma), x, y in zip(W.sliding_stats(v, a, b), a, b, strict=True):
        h = v[x:y]
        assert n == len(h)
        if n:
            want = float(np.median(np.abs(h - np.median(h))))
            wide = 1.4826 * want if want >= 1e-9 / 1.4826 else float(np.std(h))
            assert (m, mad, sigma) == pytest.approx((np.median(h), want, wide if wide >= 1e-9 else max(abs(m) * 0.1, 1.0)))


def test_folds():
    rng = np.random.default_rng(4)
    v = rng.normal(100, 20, 900)
    a, b = frames(rng, 900, 400)
    stats = W.sliding_stats(v, a, b)
    smooth, sums, lines = W.sliding_ewma(v, a, b, 0.25), W.sliding_cusum(v, a, b, stats, 0.5), W.sliding_trend(v, a, b, 40)
    for i in range(0, len(a), 7):
        h = v[a[i] : b[i]]
        if not len(h):
            continue
        level, dev, pos, neg = h[0], 0.0, 0.0, 0.0
        for x in h[1:]:
            level, dev = 0.25 * x + 0.75 * level, 0.25 * abs(x - level) + 0.75 * dev
        for x in h:
            z = (x - stats[i, 1]) / stats[i, 3]
            pos, neg = max(0.0, pos + z - 0.5), max(0.0, neg - z - 0.5)
        assert smooth[i] == pytest.approx([level, dev]) and sums[i] == pytest.approx([pos, neg], abs=1e-8)
        w = h[-40:]
        slopes = [(w[q] - w[p]) / (q - p) for p in range(len(w)) for q in range(p + 1, len(w))] or [0.0]
        slope = np.median(slopes)
        assert lines[i, :3] == pytest.approx([len(w), slope, np.median(w - slope * np.arange(len(w)))])


def test_ten_thousand_frames_of_covariances_equal_numpy():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(10_200, 4)) @ np.diag([1, 10, 1000, 0.01]) + np.array([1e6, 0, -5, 3.0])
    x[:, 1] = 7.0  # a constant feature: the covariance has no inverse
    rows = np.arange(200, 10_200)
    a, b = rows - 200 + rng.integers(0, 100, len(rows)), rows
    a = np.maximum.accumulate(a)
    distance, sigmas = W.sliding_mahalanobis(x, rows, a, b)
    for i, r in enumerate(rows.tolist()):
        cov = np.cov(x[a[i] : b[i]], rowvar=False) + np.eye(4) * 1e-6
        delta = x[r] - np.median(x[a[i] : b[i]], axis=0)
        assert distance[i] == pytest.approx(np.sqrt(delta @ np.linalg.pinv(cov) @ delta), rel=1e-5)
        assert sigmas[i] == pytest.approx(np.abs(delta) / np.sqrt(np.diag(cov)), rel=1e-5, abs=1e-9)


def test_time_is_linear_in_the_rows():
    v = np.random.default_rng(6).normal(size=40_000)

    def took(n):
        b = np.arange(n)
        began = time.perf_counter()
        W.sliding_stats(v[:n], np.maximum(b - 4320, 0), b)
        return time.perf_counter() - began

    took(2_000)
    assert took(40_000) < 6 * took(10_000)


def test_equals_the_detectors_over_arrays(spark):
    rng = random.Random(7)
    t0 = datetime(2026, 8, 14, 20, 0)  # runs into a weekend
    rows = [(t0 + timedelta(minutes=7 * i + rng.randint(0, 3)), "ab"[i % 2], rng.choice([None, float("nan"), 5.0] + [rng.gauss(50, 9)] * 20)) for i in range(900)]
    df = spark.createDataFrame([*rows, rows[5], rows[5]], "window_start timestamp, k string, x double").withColumn("other", F.create_map(F.lit("a"), F.lit(1)))
    look, value = 30_000, F.col("x")
    arrays = D.with_seasonal_history(D.with_history(df, ["x"], ["k"], look), ["x"], ["k"], look)
    want = arrays.select("window_start", "k", D.robust_z(F.col("h_x"), value).alias("z"), D.ewma(F.col("h_x"), value).alias("e"), D.cusum(F.col("h_x"), value).alias("c"), D.trend(F.col("h_x"), value).alias("t"), D.seasonal(F.col("s_x"), value).alias("s"))
    p = F.col("p_x")
    season = F.struct(p["s_n"].alias("n"), p["s_median"].alias("median"), p["s_sigma"].alias("sigma"))
    got = W.with_past(df, {"x": tuple(W.PARTS)}, look, by=["k"])
    assert "other" in got.columns
    got = got.select("window_start", "k", D.robust_z_of(p, value).alias("z"), D.ewma_of(p, p["n"], value).alias("e"), D.cusum_of(p, value).alias("c"), D.trend_of(p, p["n"], value).alias("t"), D.seasonal_of(season, value).alias("s"))

    def scores(found):
        return sorted((r["window_start"], r["k"], *[(r[c]["cold"], round(r[c]["score"], 8)) for c in "zects"]) for r in found.filter("x is not null and not isnan(x)" if "x" in found.columns else "true").collect())

    left, right = scores(want), scores(got)
    assert len(left) == 902 and left == right


def test_no_array_of_history_is_shuffled(spark):
    plan = A.analyze_global(history(spark, {}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"collect_list|percentile|\bh_|\bs_(requests|error|p95)", plan)


def test_empty_table(spark):
    assert W.with_past(spark.createDataFrame([], "window_start timestamp, x double"), {"x": ("stats",)}, 60, ["x"]).count() == 0
