"""Learning from stored metrics: isolation forests, traffic profiles and seasonal baselines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.stats import result
from tidegauge.operators.analyzers import GLOBAL_FEATURES, IP_FEATURES
from tidegauge.operators.detectors import number

MIN_TRAINING_ROWS = 240
PROFILE_NAMES = ("quiet", "off-peak", "steady", "busy", "peak", "surge")
TRACKED = ("requests", "error_rate", "p95_response_time", "unique_ips")


def feature_frame(rows: DataFrame, features: list[str], seconds: float = 60.0) -> DataFrame:
    """Features as finite doubles; absent ones are 0, rates and sizes follow from sums where they are absent."""
    out = rows
    if "rps" in features and "rps" not in out.columns and "requests" in out.columns:
        out = out.withColumn("rps", F.col("requests") / seconds)
    if "bytes_per_request" in features and "bytes_per_request" not in out.columns and "bytes_sent" in out.columns:
        out = out.withColumn("bytes_per_request", F.try_divide(F.col("bytes_sent"), F.col("requests")))

    def clean(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)

    return out.withColumns({f: clean(f) if f in out.columns else F.lit(0.0) for f in features})


def global_features(rows: DataFrame) -> DataFrame:
    return feature_frame(rows, GLOBAL_FEATURES)


def ip_features(rows: DataFrame) -> DataFrame:
    return feature_frame(rows, IP_FEATURES)


def split_clean(rows: DataFrame) -> DataFrame:
    """Unlabelled rows, however few."""
    return rows.filter(F.col("dominant_attack_label").isNull())


def training_rows(rows: DataFrame, least: int = MIN_TRAINING_ROWS) -> DataFrame:
    """Unlabelled rows to train on; all rows if there are too few of them."""
    clean = split_clean(rows)
    return clean if clean.limit(least).count() >= least else rows


def _path_length(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def _grow(x: np.ndarray, columns: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, int, float, int, int, float]]:
    """Nodes of one tree: id, feature (-1: leaf), threshold, left, right, depth with what a leaf's size adds."""
    nodes: list[tuple] = []
    todo = [(x, 0, 0)]
    counter = 1
    while todo:
        part, node, depth = todo.pop()
        spread = [c for c in columns if part[:, c].min() < part[:, c].max()] if len(part) > 1 and depth < limit else []
        if not spread:
            nodes.append((node, -1, 0.0, -1, -1, depth + _path_length(len(part))))
            continue
        c = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, c].min(), part[:, c].max()))
        left, right = counter, counter + 1
        counter += 2
        nodes.append((node, c, cut, left, right, 0.0))
        todo += [(part[part[:, c] < cut], left, depth + 1), (part[part[:, c] >= cut], right, depth + 1)]
    return nodes


FOREST = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def train_forest(rows: DataFrame, features: list[str], contamination: float = 0.02, trees: int = 200, subsample: int = 256, share: float = 0.8, max_rows: int = 120_000, seed: int = 42) -> tuple[DataFrame, dict]:
    """An isolation forest as a table of nodes, with scaling, offset and score statistics.

    Each tree grows in its own task on its own sample; a row goes to the few trees that drew it.
    """
    data = training_rows(feature_frame(rows, features)).select(*features)
    n = data.count()
    if n > max_rows:
        data = data.sample(max_rows / n, seed=seed)
        n = data.count()
    quarters = data.agg(*[F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f) for f in features]).first()
    center = [quarters[f][1] if n else 0.0 for f in features]
    scale = [(quarters[f][2] - quarters[f][0]) or 1.0 if n else 1.0 for f in features]
    scaled = data.select(*[((F.col(f) - c) / s).alias(f) for f, c, s in zip(features, center, scale, strict=True)])
    # every row draws the trees that it goes to before it is copied; a tree keeps about its subsample
    chance = min(1.0, 1.3 * subsample / max(n, 1))
    draw = lambda t: F.pmod(F.xxhash64("_u", t), F.lit(1 << 30)) / (1 << 30)
    drawn = scaled.withColumn("_u", F.rand(seed)).withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < chance)))
    drawn = drawn.withColumn("_r", draw(F.col("tree"))).drop("_u")

    def grow(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed * 100_003 + int(keys[0]))
        x = pdf.sort_values("_r")[features].to_numpy(float)[:subsample]
        picked = rng.choice(len(features), max(1, int(share * len(features))), replace=False)
        nodes = _grow(x, picked, rng, math.ceil(math.log2(max(2, len(x)))))
        return pd.DataFrame([(int(keys[0]), *node) for node in nodes], columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

    forest = drawn.groupBy("tree").applyInPandas(grow, FOREST).persist()
    meta = {"features": features, "center": center, "scale": scale, "subsample": min(subsample, n), "offset": -0.5, "trees": trees}
    raw = score_forest(scaled, forest, meta | {"center": [0.0] * len(features), "scale": [1.0] * len(features)})
    stats = raw.agg(F.percentile("_raw", contamination).alias("offset"), F.avg("_raw").alias("mean"), F.stddev_pop("_raw").alias("std"), F.percentile("_raw", 0.01).alias("p01"), F.percentile("_raw", 0.05).alias("p05")).first()
    offset = stats["offset"] if stats["offset"] is not None else -0.5
    return forest, meta | {"offset": offset, "rows": n, "contamination": contamination, "score_mean": (stats["mean"] or 0.0) - offset, "score_std": stats["std"] or 0.0}


def score_forest(rows: DataFrame, forest: DataFrame, meta: dict) -> DataFrame:
    """Adds ``_raw``: minus 2 to the power of minus mean depth over the mean depth of the subsample."""
    nodes = forest.toPandas()  # trees x (2 x subsample) rows at most
    arrays = []
    for _, t in nodes.sort_values("node").groupby("tree"):
        arrays.append(tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth")))
    shared = rows.sparkSession.sparkContext.broadcast(arrays)
    usual = _path_length(meta["subsample"]) or 1.0
    center, scale = np.array(meta["center"]), np.array(meta["scale"])

    @F.pandas_udf(T.DoubleType())
    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = (np.stack(batch.to_numpy()).astype(float) - center) / scale if len(batch) else np.zeros((0, len(center)))
            depth = np.zeros(len(x))
            for feature, cut, left, right, depths in shared.value:
                at = np.zeros(len(x), np.int64)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    go = x[inner, feature[at[inner]]] < cut[at[inner]]
                    at[inner] = np.where(go, left[at[inner]], right[at[inner]])
                depth += depths[at]
            yield pd.Series(-(2.0 ** (-depth / max(1, len(shared.value)) / usual)))

    return rows.withColumn("_raw", raw(F.array(*[F.col(f).cast("double") for f in meta["features"]])))


def forest_detector(rows: DataFrame, forest: DataFrame, meta: dict) -> DataFrame:
    """Adds the detector struct ``isolation_forest``: logistic of the decision value, triggered from 0.6."""
    scored = score_forest(feature_frame(rows, meta["features"]), forest, meta)
    decision = F.col("_raw") - meta["offset"]
    value = 1 / (1 + F.exp(6 * decision))
    said = F.concat(F.lit("isolated more easily than normal traffic (decision "), number(decision, 3), F.lit(")"))
    return scored.withColumn("isolation_forest", result("isolation_forest", value, value >= 0.6, said, {"decision": F.round(decision, 4)}, F.lit(True))).drop("_raw")


def detector(forest: DataFrame, meta: dict) -> Callable[[DataFrame], DataFrame]:
    """The forest as the detection jobs take it."""
    return lambda rows: forest_detector(rows, forest, meta)


def traffic_profiles(rows: DataFrame, clusters: int = 5, seed: int = 42) -> DataFrame:
    """Clusters of hours, named by their volume."""
    hourly = rows.groupBy(F.date_trunc("hour", "window_start").alias("hour")).agg(
        F.sum("requests").cast("double").alias("requests"), *[F.coalesce(F.avg(s), F.lit(0.0)).alias(n) for s, n in (("error_rate", "error_rate"), ("p95_response_time", "p95"), ("unique_ips", "unique_ips"), ("bot_ratio", "bot_ratio"))]
    )
    features = ["requests", "error_rate", "p95", "unique_ips", "bot_ratio"]
    hours = hourly.count()
    k = int(min(clusters, max(2, hours // 3)))
    vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(hourly)
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(vectors).transform(vectors)
    found = KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="cluster").fit(scaled).transform(scaled)
    profiles = found.groupBy("cluster").agg(
        F.count("*").alias("hours"), *[F.avg(f).alias(f"avg_{f}") for f in features], F.array_sort(F.collect_set(F.hour("hour"))).alias("typical_hours")
    )
    rank = F.row_number().over(Window.orderBy("avg_requests", "cluster"))  # a handful of rows
    names = F.array(*[F.lit(n) for n in PROFILE_NAMES])
    return profiles.withColumn("name", F.element_at(names, F.least(rank, F.lit(len(PROFILE_NAMES)))))


def seasonal_baseline(rows: DataFrame, tracked: tuple[str, ...] = TRACKED, bucket_minutes: int = 15) -> DataFrame:
    """Quantiles by day type, time of day and metric, in long form."""
    day = F.when(F.weekday("window_start") >= 5, "weekend").otherwise("weekday").alias("day_type")
    bucket = F.floor((F.hour("window_start") * 60 + F.minute("window_start")) / bucket_minutes).cast("int").alias("bucket")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in tracked])).alias("p")
    long = rows.select(day, bucket, pairs).select("day_type", "bucket", "p.metric", "p.value")
    q = lambda p, name: F.percentile("value", p).alias(name)
    return long.groupBy("day_type", "bucket", "metric").agg(q(0.5, "median"), q(0.25, "p25"), q(0.75, "p75"), q(0.95, "p95"), F.count("value").alias("samples"))
