"""Filters, runs, incidents, alerts and evaluation on small tables."""

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from tidegauge.operators import evaluation as V
from tidegauge.operators import filters as B
from tidegauge.operators import incidents as G
from tidegauge.operators import series as X

T0 = datetime(2026, 8, 18, 6, 0)
COLUMNS = "anomaly_id string, type string, entity_type string, entity string, score double, severity string, detector string, detectors array<string>, reason string, headline string, window_start timestamp, window_end timestamp, detected_at timestamp, metrics map<string,double>, status string, ground_truth string"


def anomaly(i, minute, score=60.0, kind="error_spike", entity_type="global", entity="all-traffic", severity="medium"):
    at = T0 + timedelta(minutes=minute)
    return (f"a{i}", kind, entity_type, entity, score, severity, "rule", ["rule"], f"r{i}", f"h{i}", at, at + timedelta(minutes=1), at, {"requests": 10.0, "error_rate": 0.1 * int(i)}, "open", None)


def test_gaps_start_new_incidents_and_scores_fold_in_order(spark):
    rows = [anomaly(1, 0, 40.0), anomaly(2, 5, 80.0, severity="high"), anomaly(3, 15, 50.0), anomaly(4, 26, 30.0), anomaly(5, 3, 90.0, "suspicious_ip", "ip", "x", "critical"), anomaly(6, 4, 90.0, "suspicious_ip", "ip", "y", "critical")]
    found = {(r["family"], r["started_at"]): r for r in G.fold_incidents(G.correlate(spark.createDataFrame(rows, COLUMNS))).collect()}
    first = found["availability", T0]
    score = peak = 40.0
    for i, s in enumerate((40.0, 80.0, 50.0)):
        peak = max(peak, s) if i else s
        score = round(0.7 * peak + 0.3 * (score if i else s), 2)
    assert (first["anomaly_count"], first["peak_score"], first["score"], first["severity"], first["summary"]) == (3, 80.0, score, "high", "r2")
    assert found["availability", T0 + timedelta(minutes=26)]["anomaly_count"] == 1
    campaign = found["security", T0 + timedelta(minutes=3)]
    assert campaign["entity"] == "*" and campaign["entities"] == ["x", "y"]


def test_alert_cooldown_is_greedy(spark):
    rows = [anomaly(i, m, 60.0 + i) for i, m in enumerate((0, 1, 2, 3, 6))]
    rules = G.rules_table(spark, (("r", "low", (), (), None, 120),))
    fired = sorted(r["fired_at"] for r in G.fire_alerts(G.match_rules(spark.createDataFrame(rows, COLUMNS), rules)).collect())
    assert fired == [T0, T0 + timedelta(minutes=3), T0 + timedelta(minutes=6)]


def test_bands_merge_touching_windows(spark):
    rows = [anomaly(1, 0), anomaly(2, 1, 90.0, severity="critical"), anomaly(3, 5), anomaly(4, 1)]
    got = sorted((r["start"], r["windows"], r["severity"]) for r in X.anomaly_bands(spark.createDataFrame(rows, COLUMNS)).collect())
    assert got == [(T0, 2, "critical"), (T0 + timedelta(minutes=5), 1, "medium")]


def test_search_keeps_nulls_under_negation(spark):
    df = spark.createDataFrame([("1", "/Login", 200, None), ("2", "/a", 404, "FR"), ("3", None, 500, "DE")], "event_id string, path string, status int, country string")
    ids = lambda *a: [r["event_id"] for r in B.search_filter(df, *a).orderBy("event_id").collect()]
    assert ids([("country", "!=", "fr")]) == ["1", "3"]
    assert ids([("url", ":", "/log*")]) == ["1"]
    assert ids([("code", ">=", 400, True)]) == ["1"]
    assert ids([], ["LOGIN"]) == ["1"]
    assert ids([("nonsense", ":", "login")]) == ["1"]


def test_quality_counts(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    truth = spark.createDataFrame([(at(10), "error_spike"), (at(11), "error_spike"), (at(20), "error_spike")], "minute timestamp, label string")
    minutes = spark.createDataFrame([(at(m),) for m in range(30)], "window_start timestamp")
    found = spark.createDataFrame([anomaly(1, 11), anomaly(2, 13), anomaly(3, 25), anomaly(4, 21, kind="traffic_spike"), anomaly(5, 2, severity="low")], COLUMNS)
    n = V.detection_quality(V.minute_outcomes(minutes, truth, found)).first()
    assert (n["tp"], n["fn"], n["fp"], n["tn"]) == (2, 1, 1, 24)
    runs = sorted((r["start"], r["caught"], r["latency_minutes"]) for r in V.incident_recall(truth, found).collect())
    assert runs == [(at(10), True, 1.0), (at(20), False, None)]


def test_buckets():
    assert [X.bucket_seconds(s) for s in (0, 3600, 86_400, 30 * 86_400, 92 * 86_400)] == [60, 60, 300, 7200, 21_600]
    assert B.resolve_range(last="6h", now=T0) == (T0 - timedelta(hours=6), T0)


def test_contents_of_ids(spark):
    df = spark.createDataFrame([anomaly(1, 0)], COLUMNS)
    a = G.correlate(df).select("incident_id").first()[0]
    assert a == G.correlate(df.withColumn("score", F.lit(1.0))).select("incident_id").first()[0] and len(a) == 22


def campaign(seed, n=400, kinds=("suspicious_ip", "error_spike", "session_anomaly")):
    """Anomalies of three keys in order of time, with gaps, ties and many at the same minute."""
    rng, minute, rows = random.Random(seed), 0, []
    for i in range(n):
        minute += rng.choice([0, 0, 1, 3, 10, 11, 40] if rng.random() < 0.8 else [0, 700])
        kind = rng.choice(kinds)
        where = {"suspicious_ip": ("ip", f"10.0.0.{rng.randint(0, 90)}"), "error_spike": ("global", "all-traffic"), "session_anomaly": ("session", f"s{i}")}[kind]
        score = round(rng.uniform(30, 100), 2)
        severity = "low" if score < 50 else "medium" if score < 70 else "high" if score < 85 else "critical"
        rows.append(anomaly(f"{i:04d}", minute, score, kind, *where, severity))
    return rows


def plain_incidents(rows):
    """Every anomaly in turn: it goes on with its key's incident or starts one."""
    found, latest = [], {}
    for r in sorted(rows, key=lambda r: (r[10], r[0])):
        key = ("security", "*") if r[2] == "ip" else ("behaviour", "*") if r[2] == "session" else ("availability", r[3])
        x = latest.get(key)
        if x is None or (r[10] - x["last"]).total_seconds() > 600:
            x = latest[key] = {"key": key, "start": r[10], "n": 0, "ids": [], "entities": [], "types": [], "peak": 0.0, "score": r[4], "worst": -1, "shown": []}
            found.append(x)
        rank = ("info", "low", "medium", "high", "critical").index(r[5])
        if rank > x["worst"]:
            x["worst"], x["reason"] = rank, r[8]
        x["peak"] = max(x["peak"], r[4])
        x["score"] = float(Decimal(repr(0.7 * x["peak"] + 0.3 * x["score"])).quantize(Decimal("0.01"), ROUND_HALF_UP))
        x["last"], x["n"], x["ids"] = r[10], x["n"] + 1, [*x["ids"], r[0]][-500:]
        x["entities"] += [r[3]] * (r[3] not in x["entities"])
        x["types"] += [r[1]] * (r[1] not in x["types"])
        x["shown"] += [r[10]] * (r[10] not in x["shown"])
    return sorted((x["key"], x["start"], x["last"], x["n"], x["peak"], round(x["score"], 2), x["worst"], x["reason"], tuple(x["ids"]), tuple(x["entities"][:50]), tuple(x["types"]), tuple(x["shown"][-120:])) for x in found)


def shown(incidents):
    rank = {s: i for i, s in enumerate(("info", "low", "medium", "high", "critical"))}
    return sorted(((r["family"], r["entity"]), r["started_at"], r["last_seen_at"], r["anomaly_count"], r["peak_score"], r["score"], rank[r["severity"]], r["summary"], tuple(r["anomaly_ids"]), tuple(r["entities"]), tuple(r["types"]), tuple(t["at"] for t in r["timeline"])) for r in incidents.collect())


def test_incidents_equal_a_plain_fold(spark):
    for seed in (1, 2):
        rows = campaign(seed)
        assert shown(G.fold_incidents(G.correlate(spark.createDataFrame(rows, COLUMNS)))) == plain_incidents(rows)


def test_a_campaign_without_pause_is_one_incident(spark):
    rows = [anomaly(f"{i:05d}", 3 * i, 30.0 + (7 * i) % 61, "suspicious_ip", "ip", f"10.0.{i % 70}.1") for i in range(1500)]
    found = shown(G.fold_incidents(G.correlate(spark.createDataFrame(rows, COLUMNS))))
    assert len(found) == 1 and found == plain_incidents(rows)


def test_random_micro_batches_give_the_batch_incidents(spark):
    rng, rows = random.Random(8), campaign(8, 150)
    rows.sort(key=lambda r: (r[10], r[0]))
    cuts = sorted(i for i in rng.sample(range(1, len(rows)), 5) if rows[i][10] > rows[i - 1][10])
    state, closed = None, []
    for low, high in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        state = G.advance_incidents(state, spark.createDataFrame(rows[low:high], COLUMNS))
        state = spark.createDataFrame(state.collect(), state.schema)
        over = G.settled(rows[high - 1][10])
        closed += shown(G.state_incidents(state.filter(over)))
        state = state.filter(~over)  # what no later batch reaches leaves the state
        assert state.count() <= 3 and all(len(r["ids"]) <= 500 and len(r["entities"]) <= 50 and len(r["timeline"]) <= 120 for r in state.collect())
    assert sorted(closed + shown(G.state_incidents(state))) == plain_incidents(rows)


def test_half_a_million_times_of_one_rule(spark):
    times = spark.range(500_000).select(F.format_string("a%d", "id").alias("anomaly_id"), F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("id")).alias("window_start"))
    matches = times.select("anomaly_id", F.lit("r").alias("rule_id"), F.lit("x").alias("entity"), F.lit("ip").alias("entity_type"), F.lit("high").alias("severity"), F.lit(60.0).alias("score"), F.lit("t").alias("type"), F.lit("h").alias("headline"), F.lit("w").alias("reason"), "window_start", F.col("window_start").alias("detected_at"), F.lit(120).alias("cooldown_seconds"))
    fired = G.fire_alerts(matches)
    assert fired.count() == -(-500_000 // 3)
    assert "collect_" not in fired._jdf.queryExecution().toString()


def test_cooldowns_hold_across_batches(spark):
    rng = random.Random(4)
    minutes = sorted(rng.sample(range(300), 120))
    rows = [anomaly(f"{i:03d}", m, 60.0 + i % 7, entity=f"e{i % 2}") for i, m in enumerate(minutes)]
    rules = G.rules_table(spark, (("r", "low", (), (), None, 240), ("q", "low", (), (), None, 1000)))
    fire = lambda some, before=None: G.fire_alerts(G.match_rules(spark.createDataFrame(some, COLUMNS), rules), before)
    whole = {(r["rule_id"], r["entity"], r["fired_at"]) for r in fire(rows).collect()}
    first = fire(rows[:50])
    before = spark.createDataFrame(first.collect(), first.schema)
    rest = fire(rows[40:], before).collect()  # ten rows are repeated
    assert {(r["rule_id"], r["entity"], r["fired_at"]) for r in [*before.collect(), *rest]} == whole
    assert not {r["alert_id"] for r in rest} & {r["alert_id"] for r in before.collect()}
