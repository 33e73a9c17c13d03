"""Metric families: invariants, ties, nulls, empty input."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import metrics as M
from tidegauge.operators.enrich import enrich
from tidegauge.sources.events import EVENT_SCHEMA, parse_events, prepare_events

T0 = datetime(2026, 8, 18, 6, 0)


def rows(spark, n=240):
    data = [(f"e{i}", T0 + timedelta(seconds=i), (200, 200, 404, 500, 401)[i % 5], ("/a", "/b", "/api/v1/auth/login")[i % 3], f"10.0.0.{i % 7 if i % 2 else 1}", f"s{i % 4}", 100.0 * (i % 30), 10 * i, "error_spike" if i == 3 else None) for i in range(n)]
    df = spark.createDataFrame(data, "event_id string, event_time timestamp, status int, endpoint string, ip string, session_id string, response_time_ms double, bytes_sent bigint, attack_label string")
    return df.withColumn("path", F.col("endpoint"))


@pytest.fixture(scope="module")
def events(spark):
    return enrich(prepare_events(rows(spark))).persist()


def test_prepare_tolerates_missing_columns_and_bad_values(spark):
    df = spark.createDataFrame([("2026-08-18T06:00:00Z", "200", "12.5"), ("nonsense", "200", "1"), ("2026-08-18T06:01:00Z", "oops", "NaN")], "timestamp string, status string, response_time_ms string")
    got = {r["event_time"]: (r["status"], r["response_time_ms"], r["endpoint"]) for r in prepare_events(df).collect()}
    assert list(got.values()) == [(200, 12.5, "/"), (0, 0.0, "/")]


def test_parse_drops_what_it_cannot_use(spark):
    good = '{"event_id":"1","timestamp":"2026-08-18T06:00:00Z","status":200,"endpoint":"/"}'
    bad = ["{not json", good.replace("200", "0"), good.replace('"endpoint":"/"', '"x":1'), good.replace("2026-08-18T06:00:00Z", "soon")]
    raw = spark.createDataFrame([(bytearray(x.encode()), T0, 0, i) for i, x in enumerate([good, *bad])], "value binary, timestamp timestamp, partition int, offset bigint")
    assert [r["event_id"] for r in parse_events(raw).collect()] == ["1"]


def test_invariants(events):
    g = M.global_with_concentration(events, "1 minute").collect()
    assert sum(r["requests"] for r in g) == 240
    for r in g:
        assert r["p50_response_time"] <= r["p95_response_time"] <= r["p99_response_time"]
        assert abs(r["rps"] - r["requests"] / 60) < 0.002
        assert sum(r["status_counts"].values()) == r["requests"]
        assert 0 <= r["error_rate"] <= 1 and 0 <= r["ip_gini"] <= 1 and 0 <= r["path_entropy"] <= 1 + 1e-9
    assert [r["dominant_attack_label"] for r in sorted(g, key=lambda r: r["window_start"])] == ["error_spike", None, None, None]


def test_gini_by_histogram_equals_sorting(events):
    got = {r["window_start"]: r["ip_gini"] for r in M.concentration(events, "1 minute").collect()}
    counts = {}
    for r in events.groupBy(F.window("event_time", "1 minute")["start"].alias("w"), "ip").count().collect():
        counts.setdefault(r["w"], []).append(r["count"])
    for w, xs in counts.items():
        xs.sort()
        n = len(xs)
        assert got[w] == pytest.approx(sum((2 * (i + 1) - n - 1) * x for i, x in enumerate(xs)) / (n * sum(xs)))


def test_burstiness_rules(spark):
    df = spark.createDataFrame([(60, 60.0), (60, 3.0), (2, 0.0)], "n int, span double")
    assert [r[0] for r in df.select(M.burstiness(F.col("n"), F.col("span"), F.lit(60.0))).collect()] == [1.0, 20.0, 1.0]


def test_stream_form_agrees_on_counts(events):
    a = {r["window_start"]: (r["requests"], r["errors_4xx"]) for r in M.global_metrics(events, "1 minute", exact=False).collect()}
    b = {r["window_start"]: (r["requests"], r["errors_4xx"]) for r in M.global_metrics(events, "1 minute", exact=True).collect()}
    assert a == b


def test_sessions_split_at_gaps(spark):
    times = [0, 60, 120, 60 * 60, 60 * 61]
    df = spark.createDataFrame([(f"e{i}", T0 + timedelta(seconds=s), "s", 200, "/x" if i else "/in", "/x") for i, s in enumerate(times)], "event_id string, event_time timestamp, session_id string, status int, endpoint string, path string")
    got = sorted((r["requests"], r["entry_endpoint"], r["duration_seconds"]) for r in M.session_metrics(enrich(prepare_events(df)), "15 minutes").collect())
    assert got == [(2, "/x", 60.0), (3, "/in", 120.0)]


def test_empty_input(spark):
    none = enrich(prepare_events(spark.createDataFrame([], EVENT_SCHEMA)))
    assert all(df.count() == 0 for df in M.all_metrics(none).values())
