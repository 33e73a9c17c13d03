"""Streams: equal to batch, late and broken input, upserts, detection of closed windows."""

import json
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidegauge.operators import analyzers as A
from tidegauge.operators import filters as B
from tidegauge.operators import metrics as M
from tidegauge.operators import reports as R
from tidegauge.operators.enrich import enrich
from tidegauge.sources.events import parse_events, read_events_stream
from tidegauge.streaming import topology as ST

T0 = datetime(2026, 8, 18, 6, 0)


def message(i, second, status=200, endpoint="/a", ip="1.1.1.1", session="s"):
    return json.dumps({"event_id": f"e{i}", "timestamp": (T0 + timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ"), "status": status, "endpoint": endpoint, "ip": ip, "session_id": session, "path": endpoint, "method": "GET", "response_time_ms": 10.0 * (i % 50), "bytes_sent": i})


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    src = tmp_path / "in"
    lines = [message(i, i * 2, (200, 404, 500)[i % 3], ip=f"1.1.1.{i % 5}") for i in range(200)]
    write(src, "a.json", [*lines[:120], "{broken", message(900, 5, 0)])
    write(src, "b.json", [*lines[120:], message(999, 86_400)])  # the last closes all windows before it
    stream = ST.live_events(read_events_stream(spark, "text", {"path": str(src)}))
    query = M.global_metrics(stream, "1 minute").writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    raw = spark.read.text(str(src)).select(F.col("value").cast("binary").alias("value"), F.current_timestamp().alias("timestamp"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"))
    batch = M.global_metrics(enrich(parse_events(raw)), "1 minute").filter(F.col("window_start") < F.lit(T0 + timedelta(hours=12)))
    shown = ["window_start", "requests", "errors_4xx", "errors_5xx", "bytes_sent", "apdex", "p95_response_time"]
    got = sorted(map(tuple, spark.table("windows").select(*shown).collect()))
    assert got == sorted(map(tuple, batch.select(*shown).collect())) and got


def test_raw_events_once_an_id(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "raw"
    write(src, "a.json", [message(1, 1), message(1, 1), message(2, 2)])
    write(src, "b.json", [message(2, 2), message(3, 3)])
    query = ST.write_raw(ST.live_events(read_events_stream(spark, "text", {"path": str(src)})), str(out), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination(120)
    rows = spark.read.parquet(str(out))
    assert sorted(r["event_id"] for r in rows.collect()) == ["e1", "e2", "e3"]
    assert not set(ST.TECHNICAL) & set(rows.columns)


def test_upsert_is_idempotent_and_keeps_absent_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(T0, "a", 1, 5.0), (T0 + timedelta(days=1), "a", 2, 6.0)], "window_start timestamp, k string, n int, x double")
    ST.upsert(spark, path, first, ["window_start", "k"])
    update = spark.createDataFrame([(T0, "a", 9), (T0, "b", 4)], "window_start timestamp, k string, n int")
    for _ in range(2):
        ST.upsert(spark, path, update, ["window_start", "k"])
    got = sorted((r["window_start"], r["k"], r["n"], r["x"]) for r in spark.read.parquet(path).collect())
    assert got == [(T0, "a", 9, 5.0), (T0, "b", 4, None), (T0 + timedelta(days=1), "a", 2, 6.0)]


def test_closed_windows_are_scored_against_stored_history(spark, tmp_path):
    src = tmp_path / "in"
    lines, n = [], 0
    for minute in range(40):
        for j in range(300 if minute == 39 else 20 + minute % 3):
            lines.append(message(n, 60 * minute + j % 60, ip=f"1.1.1.{j % 9}"))
            n += 1
    write(src, "a.json", lines[:400])
    write(src, "b.json", [*lines[400:], message(10**6, 86_400)])
    stream = ST.live_events(read_events_stream(spark, "text", {"path": str(src), "maxFilesPerTrigger": "1"}))
    history, found = str(tmp_path / "h"), str(tmp_path / "a")
    sink = ST.detection_sink(spark, history, found, lambda rows: A.analyze_global(rows), ["window_start"])
    ST.start_family(M.global_metrics(stream, "1 minute"), "closed", sink, str(tmp_path / "cp"), "append", availableNow=True).awaitTermination(300)
    assert spark.read.parquet(history).count() == 40
    kinds = {(r["type"], r["window_start"]) for r in spark.read.parquet(found).collect()}
    assert ("traffic_spike", T0 + timedelta(minutes=39)) in kinds


def test_sanitize_and_payload(spark):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")]), (2, 2.0, None)], "i int, x double, a array<double>")
    assert [tuple(r) for r in ST.sanitize(df).orderBy("i").collect()] == [(1, None, [1.0, None]), (2, 2.0, None)]


def test_a_client_is_shown_forty_events_a_second(spark, tmp_path):
    src = tmp_path / "in"
    lines = [message(i, i // 2500, (200, 500)[i % 2], ip=None if i % 3 else "1.1.1.1") for i in range(10_000)]
    for at in range(0, 10_000, 2_000):  # seconds are spread over batches
        write(src, f"{at:05d}.json", lines[at : at + 2_000])
    stream = ST.live_events(read_events_stream(spark, "text", {"path": str(src), "maxFilesPerTrigger": "1"})).select("event_id", "event_time", "status", "ip", "path", "response_time_ms")
    shown = B.capped_tail(B.tail_filter(stream, only_errors=True), ["a", "b"], 40)
    shown.writeStream.outputMode("append").format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    rows = spark.table("tail").collect()
    counts = Counter((r["client"], r["event_time"]) for r in rows)
    assert counts == {(c, T0 + timedelta(seconds=s)): 40 for c in "ab" for s in range(4)}
    assert {r["status"] for r in rows} == {500} and len({(r["client"], r["event_id"]) for r in rows}) == 320



def test_exact_sample_is_the_same_under_any_partitioning(spark):
    rows = spark.range(30_000).select(F.format_string("e%d", "id").alias("event_id"))
    some = {r[0] for r in R.exact_sample(rows.repartition(3), 700).collect()}
    assert len(some) == 700 and some == {r[0] for r in R.exact_sample(rows.repartition(13), 700).collect()}
    assert R.exact_sample(rows, 50_000).count() == 30_000 and R.exact_sample(rows.limit(0), 5).count() == 0
    assert abs(sum(int(e[1:]) for e in some) / 700 - 15_000) < 1_500
