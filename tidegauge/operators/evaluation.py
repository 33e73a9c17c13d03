"""Detection quality against labelled minutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators.filters import severity_at_least

#: Which types count as a catch of each scenario.
SCENARIO_TYPES = {
    "traffic_spike": ("traffic_spike", "multivariate_anomaly"), "ddos_burst": ("ddos_burst", "suspicious_ip", "traffic_spike"), "error_spike": ("error_spike",),
    "latency_degradation": ("latency_anomaly", "slow_endpoint"), "credential_stuffing": ("auth_abuse", "suspicious_ip"), "endpoint_scan": ("endpoint_scan", "suspicious_ip"),
    "data_scraping": ("data_scraping", "suspicious_ip"), "bot_surge": ("bot_surge", "traffic_spike", "suspicious_ip"), "service_outage": ("error_spike", "traffic_drop"), "geo_shift": ("geo_anomaly", "suspicious_ip", "traffic_spike"),
}


def minute(column: str):
    return F.date_trunc("minute", column)


def ground_truth(tables: list[DataFrame]) -> DataFrame:
    """(minute, label): the label of the first table that has one, in the order given."""
    parts = [t.filter(F.col("dominant_attack_label").isNotNull()).select(minute("window_start").alias("minute"), F.lit(i).alias("_i"), F.col("dominant_attack_label").alias("label")) for i, t in enumerate(tables)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("minute").agg(F.min_by("label", F.struct("_i", "label")).alias("label"))


def scenario_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, t) for s, types in SCENARIO_TYPES.items() for t in types], "label string, type string")


def match_truth(truth: DataFrame, detections: DataFrame, tolerance: int = 2) -> DataFrame:
    """(minute, label, detected minute) of detections of a fitting type within the tolerance.

    A labelled minute is spread over its neighbours, so that the join is an equality.
    """
    spread = truth.withColumn("near", F.explode(F.transform(F.sequence(F.lit(-tolerance), F.lit(tolerance)), lambda i: F.timestamp_seconds(F.unix_timestamp("minute") + 60 * i))))
    fits = F.broadcast(scenario_types(truth.sparkSession))
    wanted = spread.join(fits, "label", "left")
    hits = detections.select(minute("window_start").alias("near"), F.col("type").alias("found")).distinct()
    return wanted.join(hits, "near").filter(F.col("type").isNull() | (F.col("type") == F.col("found"))).select("minute", "label", F.col("near").alias("detected")).distinct()


def minute_outcomes(minutes: DataFrame, truth: DataFrame, detections: DataFrame, min_severity: str = "medium", tolerance: int = 2) -> DataFrame:
    """(minute, label, outcome): tp, fn, fp, tn, or near for a hit beside an incident."""
    strong = severity_at_least(detections, min_severity)
    every = minutes.select(minute("window_start").alias("minute")).distinct()
    caught = match_truth(truth, strong, tolerance).select("minute").distinct().withColumn("caught", F.lit(True))
    hit = strong.select(minute("window_start").alias("minute")).distinct().withColumn("hit", F.lit(True))
    around = truth.select(F.explode(F.transform(F.sequence(F.lit(-tolerance), F.lit(tolerance)), lambda i: F.timestamp_seconds(F.unix_timestamp("minute") + 60 * i))).alias("minute")).distinct().withColumn("near", F.lit(True))
    rows = every.join(truth, "minute", "left").join(caught, "minute", "left").join(hit, "minute", "left").join(around, "minute", "left")
    outcome = F.when(F.col("label").isNotNull(), F.when(F.col("caught"), "tp").otherwise("fn")).when(F.col("hit") & F.col("near").isNull(), "fp").when(F.col("hit"), "near").otherwise("tn")
    return rows.select("minute", "label", outcome.alias("outcome"))


def detection_quality(outcomes: DataFrame, empty: float = 0.0) -> DataFrame:
    """One row: confusion, precision, recall, F1 and false-positive rate; a rate without cases is ``empty``, as NaN where 0 / 0 is meant."""
    n = outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(o) for o in ("tp", "fp", "fn", "tn"))
    rate = lambda a, b: F.when(b == 0, F.lit(float(empty))).otherwise(a / b)
    return n.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "false_positive_rate": rate(fp, fp + tn), "f1": rate(2 * tp, 2 * tp + fp + fn)})


def incident_runs(truth: DataFrame) -> DataFrame:
    """Contiguous labelled minutes of each label, as (label, run, minute, start)."""
    order = Window.partitionBy("label").orderBy("minute")
    gap = F.unix_timestamp("minute") - F.unix_timestamp(F.lag("minute").over(order))
    runs = truth.withColumn("_new", F.when(gap.isNull() | (gap > 60), 1).otherwise(0)).withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.withColumn("start", F.min("minute").over(Window.partitionBy("label", "run"))).drop("_new")


def incident_recall(truth: DataFrame, detections: DataFrame, min_severity: str = "medium", tolerance: int = 2) -> DataFrame:
    """One row a run: caught or missed, and the delay of the first detection in minutes."""
    runs = incident_runs(truth)
    hits = match_truth(truth, severity_at_least(detections, min_severity), tolerance)
    rows = runs.join(hits, ["minute", "label"], "left").groupBy("label", "run").agg(F.min("start").alias("start"), F.count_distinct("minute").alias("minutes"), F.min("detected").alias("first"))
    delay = F.greatest((F.unix_timestamp("first") - F.unix_timestamp("start")) / 60, F.lit(0.0))
    return rows.select("label", "run", "start", "minutes", F.col("first").isNotNull().alias("caught"), F.when(F.col("first").isNotNull(), delay).alias("latency_minutes"))


def per_scenario(outcomes: DataFrame, recalls: DataFrame) -> DataFrame:
    """Recall of each scenario by minute and by run."""
    minutes = outcomes.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count_if(F.col("outcome") == "tp").alias("true_positives"), F.count_if(F.col("outcome") == "fn").alias("false_negatives"))
    runs = recalls.groupBy("label").agg(F.count_if("caught").alias("caught"), F.count_if(~F.col("caught")).alias("missed"))
    return minutes.join(runs, "label", "left").withColumn("recall", F.col("true_positives") / F.greatest(F.col("true_positives") + F.col("false_negatives"), F.lit(1)))


def detector_usage(anomalies: DataFrame, running: tuple[str, ...] = ()) -> DataFrame:
    """Anomalies of each detector that found any, and 0 of each ``running`` one that found none."""
    found = anomalies.groupBy("detector").agg(F.count("*").alias("n"))
    if not running:
        return found
    idle = anomalies.sparkSession.createDataFrame([(d, 0) for d in running], "detector string, n bigint")
    return found.unionByName(idle).groupBy("detector").agg(F.sum("n").alias("n"))
