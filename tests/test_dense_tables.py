"""Tables so dense that nothing stands out, every window is labelled, and sketches are past their exact range."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import evaluation as V
from tidegauge.operators import learning as L
from tidegauge.operators import metrics as M
from tidegauge.operators import reports as R
from tidegauge.operators.enrich import enrich
from tidegauge.plans import catalog
from tidegauge.streaming import chained as C

T0 = datetime(2026, 3, 2)
ANOMALY = "anomaly_id string, entity_type string, entity string, window_start timestamp"


@pytest.fixture(scope="module")
def detail_of(spark):
    """The detail of an anomaly by its id, over three hours of two addresses."""
    hours = [T0 + timedelta(hours=h) for h in range(3)]
    found = spark.createDataFrame([("a", "ip", "x", hours[1]), ("b", "global", "all-traffic", hours[2])], ANOMALY)
    incidents = spark.createDataFrame([("i", ["a", "b"])], "incident_id string, anomaly_ids array<string>")
    by_ip = spark.createDataFrame([(h, ip, 1) for h in hours for ip in "xy"], "window_start timestamp, ip string, requests int")
    events = spark.createDataFrame([(str(n), h, ip) for n, (h, ip) in enumerate((h, ip) for h in hours for ip in "xy")], "event_id string, event_time timestamp, ip string")
    families = {"metrics_ip": by_ip, "metrics_global": by_ip.groupBy("window_start").agg(F.sum("requests").alias("requests"))}
    return lambda anomaly_id, **more: R.anomaly_detail(found, incidents, families, events, anomaly_id, **more)


def test_an_unknown_anomaly_has_no_logs(detail_of):
    assert [r["event_id"] for r in detail_of("a")["logs"].collect()] == ["4", "2", "0"]
    for anomaly_id in ("b", ""):
        logs = detail_of(anomaly_id)["logs"]
        assert logs.columns == ["event_id", "event_time", "ip"] and logs.count() == 0


def test_an_unknown_anomaly_has_no_windows(detail_of):
    assert [(r["window_start"], r["ip"]) for r in detail_of("a")["windows"].collect()] == [(T0, "x"), (T0 + timedelta(hours=1), "x")]
    assert [r["requests"] for r in detail_of("b")["windows"].collect()] == [2, 2, 2]
    for kind, columns in (("ip", ["window_start", "ip", "requests"]), ("global", ["window_start", "requests"])):
        windows = detail_of("", kind=kind)["windows"]
        assert windows.columns == columns and windows.count() == 0


def numbered_sets(spark, salts, n):
    """Sets of n texts each, known to be misjudged by sketches of the size before."""
    return spark.range(n).select("id", F.explode(F.array(*[F.lit(s) for s in salts])).alias("salt")).select("salt", F.format_string("%d-%d", "salt", "id").alias("key"))


def test_distinct_counts_of_windows_are_within_two_stated_errors(spark):
    sets = numbered_sets(spark, (2099, 1774, 920, 1534), 8_000)
    events = sets.select(F.timestamp_add("MINUTE", "salt", F.lit(T0)).alias("event_time"), F.col("key").alias("ip"), F.col("key").alias("session_id"), F.col("key").alias("user_id"))
    others = {"status": F.lit(200), "method": F.lit("GET"), "path": F.lit("/"), "endpoint": F.lit("/"), "cache_status": F.lit("HIT"), "is_bot": F.lit(False), "bytes_sent": F.lit(1), "response_time_ms": F.lit(1.0), "attack_label": F.lit(None).cast("string")}
    rows = M.global_metrics(enrich(events.withColumns(others))).select("unique_ips", "unique_sessions", "unique_users").collect()
    assert len(rows) == 4 and all(abs(n - 8_000) <= 2 * 0.02 * 8_000 for r in rows for n in r)


def test_dense_windows_of_the_stream_form_equal_the_exact_ones(spark, tmp_path):
    values = [float(n * n % 6007) / 10 for n in range(3_000)]
    rows = [(n, T0 + timedelta(seconds=n % 3600), n % 1_000, "click", v, '{"k": 1}') for n, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["c13_c14_sketches"](spark, str(tmp_path)).collect()
    value = sorted(values)
    want = ("2026-03-02 00:00:00", round(10 * value[1_499], 4), round(10 * value[2_849], 4), 256, 1_000, 1_000, 1)
    assert [tuple(r) for r in got] == [want]


def test_a_percentile_out_of_bounds_is_shown_as_it_is(spark, tmp_path, monkeypatch):
    rows = [(n, T0, n, "click", float(n), '{"k": 1}') for n in range(1_000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    family = M.global_metrics
    monkeypatch.setattr(M, "global_metrics", lambda *a, **k: family(*a, **k).withColumns({"p50_response_time": F.lit(5_100.0), "unique_users": F.lit(900)}))
    got = catalog.QUERIES["c13_c14_sketches"](spark, str(tmp_path)).first()
    assert (got["p50_response_time"], got["p95_response_time"], got["unique_users"], got["unique_sessions"]) == (5_100.0, 9_490.0, 900, 1_000)


def test_addresses_on_streams_count_sessions_exactly(spark):
    # sets of 2,000 sessions whose sketches are off by some
    sets = numbered_sets(spark, (2099, 1774, 920, 1534), 2_000)
    texts = {c: F.lit(None).cast("string") for c in ("country", "asn", "org", "attack_label")}
    flags = {c: F.lit(False) for c in ("is_error", "is_not_found", "is_auth_fail", "is_bot")}
    events = sets.select(F.lit(T0).alias("event_time"), F.col("salt").cast("string").alias("ip"), F.col("key").alias("session_id"), F.concat(F.lit("ua"), "key").alias("user_agent"), F.concat(F.lit("/"), F.substring("key", -1, 1)).alias("endpoint"))
    rows = C.ip_metrics(events.withColumns({**flags, **texts, "bytes_sent": F.lit(1), "response_time_ms": F.lit(2.0)}), "5 minutes").collect()
    assert [(r["requests"], r["bytes_sent"], r["avg_response_time"], r["unique_paths"], r["unique_user_agents"], r["unique_sessions"]) for r in rows] == [(2_000, 2_000, 2.0, 10, 2_000, 2_000)] * 4


def test_a_log_in_many_files_loses_no_events_on_its_way_through_a_stream(spark, tmp_path):
    rows = [(n, T0 + timedelta(hours=n), 5, "click", 1.0, '{"k": 1}') for n in range(480)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    table.repartitionByRange(20, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    conf = {"spark.sql.files.maxPartitionBytes": "1024", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = catalog.QUERIES["c6_ip_live"](spark, str(tmp_path)).select("requests").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [r["requests"] for r in got] == [24] * 20


def test_a_running_detector_that_found_nothing_is_counted_too(spark):
    found = spark.createDataFrame([("a",), ("a",), (None,)], "detector string")
    usage = lambda df, *running: sorted(map(tuple, V.detector_usage(df, running).collect()), key=repr)
    assert usage(found) == [("a", 2), (None, 1)]
    assert usage(found, "a", "b") == [("a", 2), ("b", 0), (None, 1)]
    assert usage(found.limit(0), "rule") == [("rule", 0)]


def test_few_clean_rows_are_split_alone_and_trained_on_with_all(spark):
    rows = spark.createDataFrame([(T0 + timedelta(hours=h), None if h < 3 else "error_spike") for h in range(10)], "window_start timestamp, dominant_attack_label string")
    assert L.split_clean(rows).count() == 3 and L.split_clean(rows.filter("dominant_attack_label is not null")).count() == 0
    assert L.training_rows(rows).count() == 10 and L.training_rows(rows, 3).count() == 3


def test_rates_without_cases(spark):
    def rates(outcomes, *empty):
        row = V.detection_quality(spark.createDataFrame([(o,) for o in outcomes], "outcome string"), *empty).first()
        return [str(row[c]) for c in ("precision", "recall", "f1", "false_positive_rate")]

    nan = float("nan")
    assert rates(["tp", "tp", "fp", "fn", "tn", "tn", "tn"], nan) == rates(["tp", "tp", "fp", "fn", "tn", "tn", "tn"]) == [str(2 / 3)] * 3 + ["0.25"]
    assert rates(["fn", "fn", "tn"], nan) == ["nan", "0.0", "0.0", "0.0"] and rates(["fn", "fn", "tn"]) == ["0.0"] * 4
    assert rates(["near"], nan) == ["nan"] * 4 and rates(["fp"], nan) == ["0.0", "nan", "0.0", "1.0"]


def test_quality_without_detections_divides_like_its_sql(spark, tmp_path):
    rows = [(n, T0, n, "error" if n == 7 else "click", 1.0, '{"k": 1}') for n in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["g8_detection_quality"](spark, str(tmp_path)).first()
    assert [str(v) for v in got] == ["0", "0", "1", "0", "nan", "0.0", "0.0", "nan"]
