"""Chained streams equal the batch rollups, window by window, with late events within and beyond the watermark."""

import os
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from test_streaming import T0, message, write
from tidegauge.operators import metrics as M
from tidegauge.operators.enrich import enrich
from tidegauge.sources.events import parse_events, read_events_stream
from tidegauge.streaming import chained as C
from tidegauge.streaming import topology as ST

SPAN = "5 minutes"
GAP = "3 minutes"


def lines():
    """1,500 events in 40 minutes, in bursts by session, shuffled within a minute; the order is by arrival."""
    pick = random.Random(5)
    out = []
    for i in range(1_500):
        second = int(i * 1.6)
        session = f"s{i % 17}" if (second // 300) % 2 else f"s{i % 5}"
        out.append((second + pick.random() * 50, message(i, second, pick.choice((200, 200, 304, 404, 403, 500)), f"/p{min(int(pick.expovariate(0.2)), 40)}", f"10.0.0.{min(int(pick.expovariate(0.3)), 30)}", session)))
    return [m for _, m in sorted(out)]


def arrive(folder, number, events):
    """A file of its own second: a stream takes files in order of their times."""
    write(folder, f"{number}.json", events)
    os.utime(folder / f"{number}.json", (1_700_000_000 + number,) * 2)


def batch_of(spark, folder):
    raw = spark.read.text(str(folder)).select(F.col("value").cast("binary").alias("value"), F.current_timestamp().alias("timestamp"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"))
    return enrich(parse_events(raw))


@pytest.fixture(scope="module")
def arrived(spark, tmp_path_factory):
    src = tmp_path_factory.mktemp("chained") / "in"
    events = lines()
    for b, at in enumerate(range(0, 1_500, 300)):
        arrive(src, b, events[at : at + 300])
    # two days on: all windows before are closed; then an event too late for any of them
    arrive(src, 7, [message(90_000, 2 * 86_400, ip="last", session="last")])
    return src


def closed(spark, tmp_path, src, family, name, late=False):
    if late:
        arrive(src, 8, [message(90_001, 10, 500, "/late", "late", "late"), message(90_002, 2 * 86_400 + 1, ip="last", session="last")])
    stream = ST.live_events(read_events_stream(spark, "text", {"path": str(src), "maxFilesPerTrigger": "1"}))
    query = family(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


def rows(df, columns):
    return sorted((repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(*columns).collect()))


def test_addresses(spark, tmp_path, arrived):
    shown = ["window_start", "window_end", "ip", "requests", "errors", "not_found", "auth_fail_count", "bytes_sent", "avg_response_time", "max_response_time", "unique_paths", "unique_sessions", "first_seen", "last_seen", "path_entropy", "error_ratio", "burstiness", "rps", "sample_paths"]
    got = closed(spark, tmp_path, arrived, lambda s: C.ip_metrics(s, SPAN), "by_ip")
    want = M.ip_metrics(batch_of(spark, arrived), SPAN)
    assert set(got.columns) == set(want.columns)
    assert rows(got, shown) == rows(want.filter("ip <> 'last'"), shown) and got.count() > 100


def test_concentration(spark, tmp_path, arrived):
    shown = ["window_start", "window_end", "n_ips", "ip_gini", "top_ip", "top_ip_share", "path_entropy"]
    got = closed(spark, tmp_path, arrived, lambda s: C.concentration(s, SPAN), "by_window")
    want = M.concentration(batch_of(spark, arrived), SPAN)
    assert set(got.columns) == set(want.columns)
    assert rows(got, shown) == rows(want.filter("top_ip <> 'last'"), shown) and got.count() == 8


def test_status_classes(spark, tmp_path, arrived):
    shown = ["window_start", "status_class", "requests", "avg_response_time", "codes", "top_endpoints"]
    got = closed(spark, tmp_path, arrived, lambda s: C.status_metrics(s, SPAN), "by_class")
    want = M.status_metrics(batch_of(spark, arrived), SPAN)
    assert set(got.columns) == set(want.columns)
    assert rows(got, shown) == rows(want.filter(F.col("window_start") < F.lit(T0 + timedelta(days=1))), shown) and got.count() == 32


def test_sessions_and_what_comes_too_late(spark, tmp_path, arrived):
    shown = ["session_id", "session_start", "session_end", "requests", "unique_endpoints", "error_count", "bytes_sent", "entry_endpoint", "exit_endpoint", "duration_seconds", "requests_per_minute", "is_bot"]
    got = closed(spark, tmp_path, arrived, lambda s: M.session_metrics(s, GAP), "by_session", late=True)
    want = M.session_metrics(batch_of(spark, arrived), GAP).filter("session_id not in ('last', 'late')")
    assert rows(got, shown) == rows(want, shown) and got.count() > 40
    # an address that only the late event has is in no window either
    again = closed(spark, tmp_path / "again", arrived, lambda s: C.ip_metrics(s, SPAN), "late_ip")
    assert again.filter("ip = 'late'").count() == 0 and again.count() > 100


def test_empty_batch_and_null_routes(spark):
    # the same functions take batches: no rows give no rows, null routes and addresses are groups of their own
    one = spark.createDataFrame([(T0, None, None, 1), (T0, None, None, 2), (T0, "a", "/x", 3)], "t timestamp, ip string, endpoint string, n int")
    base = one.select(F.col("t").alias("event_time"), "ip", "endpoint", F.lit(200).alias("status"), F.lit("2xx").alias("status_class"), F.col("n").cast("double").alias("response_time_ms"))
    flags = {c: F.lit(False) for c in ("is_error", "is_not_found", "is_auth_fail", "is_bot")}
    texts = {c: F.lit(None).cast("string") for c in ("country", "asn", "org", "user_agent", "session_id", "attack_label")}
    events = base.withColumns({**flags, **texts, "bytes_sent": F.lit(1)})
    got = {r["ip"]: r for r in C.ip_metrics(events, SPAN).collect()}
    assert (got[None]["requests"], got[None]["sample_paths"], got[None]["unique_sessions"]) == (2, [None], 0)
    assert (got["a"]["requests"], got["a"]["sample_paths"], got["a"]["unique_paths"]) == (1, ["/x"], 1)
    assert rows(C.concentration(events, SPAN), ["n_ips", "ip_gini", "top_ip", "path_entropy"]) == rows(M.concentration(events, SPAN), ["n_ips", "ip_gini", "top_ip", "path_entropy"])
    for family in (C.ip_metrics, C.concentration, C.status_metrics):
        assert family(events.limit(0), SPAN).count() == 0
