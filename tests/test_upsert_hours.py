"""Upserts rewrite the hours they touch and leave the files of all others alone."""

from datetime import datetime, timedelta

from tidegauge.streaming import topology as ST

T0 = datetime(2026, 8, 18, 6, 0)
SCHEMA = "window_start timestamp, k string, n int"


def files(path):
    return {p.relative_to(path): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def hours_of(names):
    return {name.parts[:2] for name in names}


def test_only_touched_hours_are_rewritten(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(T0 + timedelta(minutes=m), k, m) for m in range(0, 60 * 26, 20) for k in "ab"]
    ST.upsert(spark, str(path), spark.createDataFrame(rows, SCHEMA), ["window_start", "k"])
    before = files(path)
    assert len(hours_of(before)) == 26
    at = T0 + timedelta(hours=20)  # the next day
    changed = [(at, "a", -1), (at + timedelta(minutes=20), "c", -2), (T0, "b", -3)]
    ST.upsert(spark, str(path), spark.createDataFrame(changed, SCHEMA), ["window_start", "k"])
    after = files(path)
    moved = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert hours_of(moved) == {("date=2026-08-18", "hour=6"), ("date=2026-08-19", "hour=2")}
    want = {(t, k): n for t, k, n in rows} | {(t, k): n for t, k, n in changed}
    got = [(r["window_start"], r["k"], r["n"]) for r in spark.read.parquet(str(path)).collect()]
    assert len(got) == len(want) and {(t, k): n for t, k, n in got} == want


def test_rows_without_a_time_and_empty_updates(spark, tmp_path):
    path = str(tmp_path / "t")
    ST.upsert(spark, path, spark.createDataFrame([(None, "a", 1), (T0, "a", 2)], SCHEMA), ["window_start", "k"])
    ST.upsert(spark, path, spark.createDataFrame([], SCHEMA), ["window_start", "k"])
    ST.upsert(spark, path, spark.createDataFrame([(None, "a", 5), (None, "b", 6)], SCHEMA), ["window_start", "k"])
    got = sorted((str(r["window_start"]), r["k"], r["n"]) for r in spark.read.parquet(path).collect())
    assert got == sorted([("None", "a", 5), ("None", "b", 6), (str(T0), "a", 2)])
