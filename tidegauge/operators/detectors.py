"""Detectors: each scores a value against the strict past of its series, as a column expression.

History arrays come from ``with_history``: range frames that end before the scored window, so a task
holds one entity's lookback and never a whole series.  A long series of one entity, as the platform's
own, is cut into chunks with a halo of lookback (``chunked``), which spreads it over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.stats import EPS, finite, let, mean, median, result, robust_stats, soft_score, spread

MIN_POINTS = 12


def with_history(df: DataFrame, columns: list[str], by: list[str], lookback_seconds: int, time: str = "window_start", tie: str | None = None) -> DataFrame:
    """Adds ``h_<column>``: earlier values within the lookback, oldest first."""
    epoch = F.unix_timestamp(time)
    w = Window.partitionBy(*by).orderBy("_epoch").rangeBetween(-lookback_seconds, -1)
    out = df.withColumn("_epoch", epoch)
    order = [F.col("_epoch"), F.col(tie)] if tie else [F.col("_epoch")]
    for c in columns:
        item = F.struct(*order, F.col(c).cast("double").alias("v"))
        out = out.withColumn(f"h_{c}", F.transform(F.array_sort(F.collect_list(item).over(w)), lambda x: x["v"]))
    return out.drop("_epoch")


def chunked(df: DataFrame, lookback_seconds: int, chunk_seconds: int | None = None, time: str = "window_start") -> DataFrame:
    """Rows with ``chunk`` and ``own``: a row also goes to later chunks whose lookback reaches it.

    Partition history windows by ``chunk`` too and keep rows that are ``own``.  With chunks as long
    as the lookback, but a day at least, every row is there twice at most.
    """
    chunk_seconds = chunk_seconds or max(lookback_seconds, 86_400)
    chunk = F.floor(F.unix_timestamp(time) / chunk_seconds)
    last = F.floor((F.unix_timestamp(time) + lookback_seconds) / chunk_seconds)
    spreaded = df.withColumn("_first", chunk).withColumn("chunk", F.explode(F.sequence(chunk, last)))
    return spreaded.withColumn("own", F.col("chunk") == F.col("_first")).drop("_first")


def number(value: Column, digits: int = 2) -> Column:
    return F.format_number(value.cast("double"), digits)


def robust_z(history: Column, value: Column, threshold=3.5, min_points: int = MIN_POINTS, direction: str = "both", label: str = "value") -> Column:
    """Distance from the median in robust sigmas."""
    return let(robust_stats(history), lambda s: robust_z_of(s, value, threshold, min_points, direction, label))


def robust_z_of(s: Column, value: Column, threshold=3.5, min_points: int = MIN_POINTS, direction: str = "both", label: str = "value") -> Column:
    """``robust_z`` of the statistics of a past: struct(n, median, sigma)."""
    z = (value - s["median"]) / F.greatest(s["sigma"], F.lit(EPS))
    held = F.greatest(z, F.lit(0.0)) if direction == "up" else F.greatest(-z, F.lit(0.0)) if direction == "down" else F.abs(z)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    said = F.concat(F.lit(f"{label} "), number(value), F.lit(" vs median "), number(s["median"]), F.lit(" ("), number(held, 1), F.lit(" sigma)"))
    return result("robust_zscore", soft_score(held, t), held >= t, said, {"observed": F.round(value, 4), "baseline_median": F.round(s["median"], 4), "sigma": F.round(s["sigma"], 4), "z_score": F.round(held, 3), "history_points": s["n"]}, s["n"] >= min_points)


def ewma(history: Column, value: Column, alpha: float = 0.25, threshold=3.5, min_points: int = MIN_POINTS, label: str = "value") -> Column:
    """Control chart around an exponentially weighted level."""

    def of(h: Column) -> Column:
        start = F.struct(F.element_at(h, 1).alias("level"), F.lit(0.0).alias("dev"))
        step = lambda a, x: F.struct((alpha * x + (1 - alpha) * a["level"]).alias("level"), (alpha * F.abs(x - a["level"]) + (1 - alpha) * a["dev"]).alias("dev"))

        return let(F.aggregate(F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), start, step), lambda s: ewma_of(s, F.size(h), value, threshold, min_points, label))

    filled = F.when(F.size(finite(history)) > 0, finite(history)).otherwise(F.array(F.lit(0.0)))
    return let(filled, of)


def ewma_of(s: Column, n: Column, value: Column, threshold=3.5, min_points: int = MIN_POINTS, label: str = "value") -> Column:
    """``ewma`` of a smoothed past: struct(level, dev) of ``n`` values."""
    sigma = F.greatest(1.2533 * s["dev"], 0.05 * F.abs(s["level"]), F.lit(EPS))
    z = F.abs(value - s["level"]) / sigma
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    said = F.concat(F.lit(f"{label} "), number(value), F.lit(" vs smoothed forecast "), number(s["level"]), F.lit(" ("), number(z, 1), F.lit(" sigma)"))
    return result("ewma", soft_score(z, t), z >= t, said, {"forecast": F.round(s["level"], 4), "sigma": F.round(sigma, 4), "z_score": F.round(z, 3)}, n >= min_points)


def cusum(history: Column, value: Column, k: float = 0.5, h=5.0, min_points: int = MIN_POINTS, label: str = "value") -> Column:
    """Two-sided cumulative sums of the robustly standardised series and the value."""

    def of(s: Column) -> Column:
        sigma = F.greatest(s["sigma"], F.lit(EPS))
        series = F.concat(finite(history), F.array(value.cast("double")))
        start = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))
        step = lambda a, x: F.struct(F.greatest(F.lit(0.0), a["pos"] + (x - s["median"]) / sigma - k).alias("pos"), F.greatest(F.lit(0.0), a["neg"] - (x - s["median"]) / sigma - k).alias("neg"))

        return let(F.aggregate(series, start, step), lambda c: _cusum_result(c, s["n"], h, min_points, label))

    return let(robust_stats(history), of)


def _cusum_result(c: Column, n: Column, h, min_points: int, label: str) -> Column:
    limit = h if isinstance(h, Column) else F.lit(float(h))
    size = F.greatest(c["pos"], c["neg"])
    way = F.when(c["pos"] >= c["neg"], "increase").otherwise("decrease")
    said = F.concat(F.lit("sustained "), way, F.lit(f" in {label} (statistic "), number(size, 1), F.lit(")"))
    return result("cusum", soft_score(size, limit), size >= limit, said, {"cusum_pos": F.round(c["pos"], 3), "cusum_neg": F.round(c["neg"], 3), "direction": way}, n >= min_points)


def cusum_of(s: Column, value: Column, k: float = 0.5, h=5.0, min_points: int = MIN_POINTS, label: str = "value") -> Column:
    """``cusum`` of a past's sums, struct(n, median, sigma, pos, neg), and of the value."""
    z = (value - s["median"]) / F.greatest(s["sigma"], F.lit(EPS))
    sums = F.struct(F.greatest(F.lit(0.0), s["pos"] + z - k).alias("pos"), F.greatest(F.lit(0.0), s["neg"] - z - k).alias("neg"))
    return let(sums, lambda c: _cusum_result(c, s["n"], h, min_points, label))


def trend(history: Column, value: Column, threshold: float = 3.5, min_points: int = MIN_POINTS, lookback: int = 40, label: str = "value") -> Column:
    """Upward residual from a Theil-Sen line through the last windows, one step ahead."""

    def of(w: Column) -> Column:
        n = F.size(w)
        slopes = F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, n), lambda y, j: (y - x) / (j + 1))))

        def line(slope: Column) -> Column:
            def fitted(intercept: Column) -> Column:
                def scored(res: Column) -> Column:
                    def final(spread_: Column) -> Column:
                        fit = F.struct(n.alias("points"), slope.alias("slope"), intercept.alias("intercept"), spread_.alias("spread"))
                        return let(fit, lambda f: trend_of(f, F.size(finite(history)), value, threshold, min_points, label))

                    mad = let(median(res), lambda m: 1.4826 * median(F.transform(res, lambda r: F.abs(r - m))))
                    wide = let(mad, lambda s: F.when(s >= EPS, s).otherwise(F.greatest(spread(res), F.abs(intercept) * 0.02, F.lit(1.0))))
                    return let(wide, final)

                return let(F.transform(w, lambda x, i: x - (intercept + slope * i)), scored)

            return let(median(F.transform(w, lambda x, i: x - slope * i)), fitted)

        return let(F.coalesce(median(slopes), F.lit(0.0)), line)

    recent = let(finite(history), lambda h: F.slice(h, F.greatest(F.size(h) - lookback + 1, F.lit(1)), lookback))
    return let(F.when(F.size(recent) > 0, recent).otherwise(F.array(F.lit(0.0))), of)


def trend_of(fit: Column, n: Column, value: Column, threshold: float = 3.5, min_points: int = MIN_POINTS, label: str = "value") -> Column:
    """``trend`` of a line through a past of ``n`` values: struct(points, slope, intercept, spread)."""
    ahead = fit["intercept"] + fit["slope"] * fit["points"]
    z = (value - ahead) / F.greatest(fit["spread"], F.lit(EPS))
    said = F.concat(F.lit(f"{label} "), number(value), F.lit(" vs trend forecast "), number(ahead), F.lit(" ("), number(z, 1), F.lit(" sigma)"))
    return result("trend", soft_score(F.greatest(z, F.lit(0.0)), threshold), z >= threshold, said, {"trend_forecast": F.round(ahead, 4), "slope_per_window": F.round(fit["slope"], 4), "residual_sigma": F.round(fit["spread"], 4), "z_score": F.round(z, 3)}, n >= min_points)


def with_seasonal_history(df: DataFrame, columns: list[str], by: list[str], lookback_seconds: int, bucket_minutes: int = 15, time: str = "window_start", min_samples: int = 3) -> DataFrame:
    """Adds ``s_<column>``: values of the same time of day and day type older than an hour; with fewer
    than ``min_samples``, of the neighbouring buckets of any day (which don't wrap around midnight)."""
    keyed = df.withColumns({"_epoch": F.unix_timestamp(time), "_bucket": F.floor((F.hour(time) * 60 + F.minute(time)) / bucket_minutes).cast("int"), "_weekend": F.weekday(time) >= 5})
    same = Window.partitionBy(*by, "_weekend", "_bucket").orderBy("_epoch").rangeBetween(-lookback_seconds, -3601)
    out = keyed
    for c in columns:
        out = out.withColumn(f"_same_{c}", F.collect_list(F.col(c).cast("double")).over(same))
    # every row also lends its value to the two buckets beside its own
    near = Window.partitionBy(*by, "_at").orderBy("_epoch").rangeBetween(-lookback_seconds, -3601)
    lent = out.withColumn("_at", F.explode(F.sequence(F.col("_bucket") - 1, F.col("_bucket") + 1)))
    for c in columns:
        lent = lent.withColumn(f"_near_{c}", F.collect_list(F.col(c).cast("double")).over(near))
    found = lent.filter(F.col("_at") == F.col("_bucket"))
    for c in columns:
        found = found.withColumn(f"s_{c}", F.when(F.size(f"_same_{c}") >= min_samples, F.col(f"_same_{c}")).otherwise(F.col(f"_near_{c}")))
    return found.drop("_epoch", "_bucket", "_weekend", "_at", *[f"_{k}_{c}" for k in ("same", "near") for c in columns])


def seasonal(samples: Column, value: Column, threshold: float = 3.5, min_samples: int = 3, label: str = "value") -> Column:
    """Distance from the median of the same time of day."""
    return let(robust_stats(samples), lambda s: seasonal_of(s, value, threshold, min_samples, label))


def seasonal_of(s: Column, value: Column, threshold: float = 3.5, min_samples: int = 3, label: str = "value") -> Column:
    """``seasonal`` of the statistics of the samples: struct(n, median, sigma)."""
    z = (value - s["median"]) / F.greatest(s["sigma"], F.lit(EPS))
    said = F.concat(F.lit(f"{label} "), number(value), F.lit(" vs usual "), number(s["median"]), F.lit(" at this time ("), number(z, 1), F.lit(" sigma)"))
    return result("seasonal", soft_score(F.abs(z), threshold), F.abs(z) >= threshold, said, {"seasonal_baseline": F.round(s["median"], 4), "sigma": F.round(s["sigma"], 4), "z_score": F.round(z, 3), "samples": s["n"]}, s["n"] >= min_samples)


MAHALANOBIS = T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("sigmas", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(MAHALANOBIS)
def _distance(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Distance of each row's features from its centre under its covariance matrix."""
    for values, centers, matrices in batches:
        distances, sigmas = [], []
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for v, c, m in zip(values, centers, matrices, strict=True):
            flat = np.asarray(m, float)
            if (key := flat.tobytes()) not in known:
                d = len(c)
                cov = np.nan_to_num(flat.reshape(d, d)) + np.eye(d) * 1e-6
                known = {key: (cov, np.linalg.pinv(cov))} if len(known) > 64 else known | {key: (cov, np.linalg.pinv(cov))}
            cov, inverse = known[key]
            delta = np.asarray(v, float) - np.asarray(c, float)
            distances.append(float(np.sqrt(max(delta @ inverse @ delta, 0.0))))
            sigmas.append((np.abs(delta) / np.maximum(np.sqrt(np.diag(cov)), EPS)).tolist())
        yield pd.DataFrame({"distance": distances, "sigmas": sigmas})


def with_mahalanobis(df: DataFrame, features: list[str], by: list[str], min_points: int = 20, threshold: float = 3.5, extra: dict[str, Column] | None = None) -> DataFrame:
    """Adds the detector struct ``mahalanobis``: distance of a row's features from a population.

    The population is the group ``by`` of each row (of earlier rows: ``sliding.with_past`` and ``mahalanobis_of``).
    ``extra``: more aggregates of a group that its rows get.
    Medians and covariances are aggregates; only the inverse of a small matrix is made in Python.
    """
    value = {f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features}
    cols = [f"_x{i}" for i in range(len(features))]
    filled = df.withColumns(dict(zip(cols, value.values(), strict=True)))
    # products about a fixed point: covariance by sums
    stats = [F.count("*").alias("_n"), *[F.percentile(c, 0.5).alias(f"_m{c}") for c in cols]]
    stats += [F.covar_samp(cols[min(i, j)], cols[max(i, j)]).alias(f"_c{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    rows = filled.join(filled.groupBy(*by).agg(*stats, *[c.alias(name) for name, c in (extra or {}).items()]), by)
    matrix = F.array(*[F.coalesce(F.col(f"_c{min(i, j)}_{max(i, j)}"), F.lit(0.0)) for i in range(len(cols)) for j in range(len(cols))])
    center = F.array(*[F.coalesce(F.col(f"_m{c}"), F.lit(0.0)) for c in cols])
    rows = rows.withColumn("_d", _distance(F.array(*cols), center, matrix))
    made = mahalanobis_of(F.struct(F.col("_n").alias("n"), "_d.distance", "_d.sigmas"), features, min_points, threshold)
    return rows.withColumn("mahalanobis", made).drop(*cols, "_n", "_d", *[f"_m{c}" for c in cols], *[f"_c{i}_{j}" for i in range(len(cols)) for j in range(i, len(cols))])


def mahalanobis_of(d: Column, features: list[str], min_points: int = 20, threshold: float = 3.5) -> Column:
    """The detector struct of a distance from a population: struct(n, distance, sigmas)."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.transform(d["sigmas"], lambda x, i: F.struct((-x).alias("s"), F.element_at(names, i + 1).alias("f")))
    top = F.slice(F.array_sort(pairs), 1, 3)
    said = F.concat(F.lit("unusual profile (distance "), number(d["distance"], 1), F.lit("): "), F.concat_ws(", ", F.transform(top, lambda p: F.concat(p["f"], F.lit(" "), number(-p["s"], 1)))))
    return result("mahalanobis", soft_score(d["distance"], threshold, 2.5), d["distance"] >= threshold, said, {"distance": F.round(d["distance"], 3)}, d["n"] >= min_points)


def neutral(detector: str) -> Column:
    return result(detector, F.lit(0.0), F.lit(False), F.lit(""), {}, F.lit(False))


__all__ = ["chunked", "cusum", "cusum_of", "ewma", "ewma_of", "mahalanobis_of", "mean", "neutral", "robust_z", "robust_z_of", "seasonal", "seasonal_of", "trend", "trend_of", "with_history", "with_mahalanobis", "with_seasonal_history"]
