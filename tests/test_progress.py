"""The listener's table of a running query: batches, state, rollup, observed counts, batches told twice."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from test_chained import SPAN, arrive, lines
from tidegauge.operators import health as H
from tidegauge.operators import metrics as M
from tidegauge.sources.events import read_events_stream
from tidegauge.streaming import progress as P
from tidegauge.streaming import topology as ST


def test_progress_of_a_running_query(spark, tmp_path):
    src, kept = tmp_path / "in", str(tmp_path / "progress")
    events = lines()
    for b in range(3):
        arrive(src, b, events[500 * b : 500 * b + 500])
    log = P.ProgressLog(spark, kept, every=2, names={"watched"})
    spark.streams.addListener(log)
    try:
        stream = ST.live_events(read_events_stream(spark, "text", {"path": str(src), "maxFilesPerTrigger": "1"}))
        for name, df in (("watched", P.observed(stream, anomalies=F.col("status") >= 500)), ("other", stream)):
            out = M.global_metrics(df, SPAN).writeStream.outputMode("append").format("noop").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True)
            out.start().awaitTermination(240)
        assert log.wait("watched", 60)
    finally:
        spark.streams.removeListener(log)
    progress = P.read_progress(spark, kept)
    table = H.progress_table(progress).collect()
    assert {r["name"] for r in table} == {"watched"} and len(table) >= 3
    assert sum(r["numInputRows"] for r in table) == 1_500 and max(r["state_rows"] for r in table) > 0 and all(r["ts"] for r in table)
    bad = sum('"status": 500' in e for e in events)
    by_query, by_minute = H.batch_rollup(P.batches(progress), datetime.now() + timedelta(hours=15), 24 * 60 * 2)
    assert [(r["query"], r["batches"], r["rows"], r["anomalies"]) for r in by_query.collect()] == [("watched", 3, 1_500, bad)]
    assert sum(r["rows"] for r in by_minute.collect()) == 1_500
    # a batch that is reported again counts once
    spark.read.text(kept).coalesce(1).write.mode("append").text(str(tmp_path / "twice"))
    spark.read.text(kept).coalesce(1).write.mode("append").text(str(tmp_path / "twice"))
    assert H.progress_table(P.read_progress(spark, str(tmp_path / "twice"))).count() == len(table)


def test_no_progress_yet(spark, tmp_path):
    (tmp_path / "none").mkdir()
    progress = P.read_progress(spark, str(tmp_path / "none"))
    assert progress.count() == 0 and P.batches(progress).count() == 0 and H.source_lag(progress).count() == 0
