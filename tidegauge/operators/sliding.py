"""Statistics of a long series' strict past, in one sorted pass over each chunk of time.

A row's frame is [t - lookback, t - 1] seconds.  The series is cut into chunks with the lookback before them, only
numbers are shuffled, and each chunk is read in order once: values enter and leave a Fenwick tree over
their ranks, which gives median and MAD in logarithmic time; covariances of a frame are differences of two
prefix sums of moments about the chunk's centre; smoothed levels and trend lines are folded for all rows at
once.  What comes out is a few numbers a row, joined to the row by its time and its values.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.stats import EPS

#: What a column's past can be asked for, and the numbers of each.
PARTS = {
    "stats": ("n", "median", "mad", "sigma"),
    "ewma": ("level", "dev"),
    "cusum": ("pos", "neg"),
    "trend": ("points", "slope", "intercept", "spread"),
    "seasonal": ("s_n", "s_median", "s_sigma"),
}
#: What is left of a value's weight when a smoothed level forgets it.
FORGOTTEN = 1e-20
LAG_SECONDS, MIN_SAMPLES = 3601, 3


class Ranked:
    """The values that are in a frame now, as counts of their ranks in a Fenwick tree."""

    def __init__(self, values: np.ndarray):
        self.levels, self.rank = np.unique(values, return_inverse=True)
        self.levels, self.rank = self.levels.tolist(), (self.rank + 1).tolist()
        self.tree, self.top, self.n = [0] * (len(self.levels) + 1), 1 << max(0, len(self.levels).bit_length() - 1), 0

    def put(self, row: int, by: int = 1) -> None:
        at, tree = self.rank[row], self.tree
        self.n += by
        while at < len(tree):
            tree[at] += by
            at += at & -at

    def kth(self, k: int) -> float:
        """The k-th smallest, from 1."""
        at, step, tree = 0, self.top, self.tree
        while step:
            if at + step < len(tree) and tree[at + step] < k:
                at += step
                k -= tree[at]
            step >>= 1
        return self.levels[at]

    def median(self) -> float:
        half = self.n // 2
        return self.kth(half + 1) if self.n % 2 else (self.kth(half) + self.kth(half + 1)) / 2

    def mad(self, m: float) -> float:
        """Median of the distances from ``m``, the median: those of the lower and of the upper half are sorted already."""
        n, h = self.n, self.n // 2
        left = lambda i: m - self.kth(h - i) if i < h else np.inf
        right = lambda j: self.kth(h + 1 + j) - m if j < n - h else np.inf
        k = (n + 1) // 2
        low, high = max(0, k - (n - h)), min(k, h)
        while low < high:
            i = (low + high) // 2
            if left(i) < right(k - i - 1):
                low = i + 1
            else:
                high = i
        i, j = low, k - low
        here = max(left(i - 1) if i else 0.0, right(j - 1) if j else 0.0)
        return here if n % 2 else (here + min(left(i), right(j))) / 2


def _sigma(mad: float, m: float, values: np.ndarray) -> float:
    if 1.4826 * mad >= EPS:
        return 1.4826 * mad
    wide = float(np.std(values))
    return wide if wide >= EPS else max(abs(m) * 0.1, 1.0)


def sliding_stats(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """n, median, mad and sigma of v[a:b] for frames whose ends don't go back."""
    held, out, first, last = Ranked(v), np.zeros((len(a), 4)), 0, 0
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while last < y:
            held.put(last)
            last += 1
        while first < x:
            held.put(first, -1)
            first += 1
        if held.n:
            m = held.median()
            d = held.mad(m)
            out[i] = held.n, m, d, _sigma(d, m, v[x:y])
    return out


def sliding_median(v: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    held, out, first, last = Ranked(v), np.zeros(len(a)), 0, 0
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while last < y:
            held.put(last)
            last += 1
        while first < x:
            held.put(first, -1)
            first += 1
        out[i] = held.median() if held.n else 0.0
    return out


def sliding_ewma(v: np.ndarray, a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Smoothed level and deviation over v[a:b], from its first value on; all frames step together.

    A frame begins where what was before would weigh less than ``FORGOTTEN``.
    """
    reach = int(np.ceil(np.log(FORGOTTEN) / np.log1p(-alpha))) + 1 if 0 < alpha < 1 else len(v)
    at = np.maximum(a, b - reach)
    level = np.where(b > a, v[np.minimum(at, len(v) - 1)], 0.0) if len(v) else np.zeros(len(a))
    dev = np.zeros(len(a))
    for _ in range(int((b - at).max(initial=0)) - 1):
        at = at + 1
        inside = at < b
        x = v[np.where(inside, at, 0)]
        dev = np.where(inside, alpha * np.abs(x - level) + (1 - alpha) * dev, dev)
        level = np.where(inside, alpha * x + (1 - alpha) * level, level)
    return np.stack([level, dev], axis=1)


def sliding_cusum(v: np.ndarray, a: np.ndarray, b: np.ndarray, stats: np.ndarray, k: float) -> np.ndarray:
    """Upper and lower cumulative sums of v[a:b], standardised by the frame's own median and sigma.

    max(0, s + z - k), folded, is the largest sum of a frame's last values: the end of a prefix sum above its
    least earlier point, both less a line whose slope is the frame's.
    """
    middle = float(v.mean()) if len(v) else 0.0
    sums, at, out = np.concatenate([[0.0], np.cumsum(v - middle)]), np.arange(len(v) + 1, dtype=float), np.zeros((len(a), 2))
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if y > x:
            m, sigma = stats[i, 1] - middle, max(stats[i, 3], EPS)
            part, steps = sums[x : y + 1], at[: y - x + 1]
            up, down = part - (m + k * sigma) * steps, part - (m - k * sigma) * steps
            out[i] = (up[-1] - up.min()) / sigma, (down.max() - down[-1]) / sigma
    return out


def sliding_trend(v: np.ndarray, a: np.ndarray, b: np.ndarray, lookback: int) -> np.ndarray:
    """Points, slope, intercept and residual spread of the Theil-Sen line through the last values of v[a:b]."""
    out, size = np.zeros((len(a), 4)), np.minimum(b - a, lookback)
    out[size == 0] = 1, 0, 0, 1
    for n in np.unique(size[size > 0]).tolist():
        rows, x = np.flatnonzero(size == n), np.arange(n, dtype=float)
        i, j = np.triu_indices(n, 1)
        for some in np.array_split(rows, max(1, len(rows) * len(i) // 1_000_000)):
            w = v[(b[some] - n)[:, None] + np.arange(n)]
            slope = np.median((w[:, j] - w[:, i]) / (x[j] - x[i]), axis=1) if n > 1 else np.zeros(len(some))
            intercept = np.median(w - slope[:, None] * x, axis=1)
            rest = w - (intercept[:, None] + slope[:, None] * x)
            wide = 1.4826 * np.median(np.abs(rest - np.median(rest, axis=1)[:, None]), axis=1)
            wide = np.where(wide >= EPS, wide, np.maximum(np.maximum(rest.std(axis=1), np.abs(intercept) * 0.02), 1.0))
            out[some] = np.stack([np.full(len(some), n), slope, intercept, wide], axis=1)
    return out


def _small_stats(values: list[float]) -> tuple[float, float, float]:
    if not values:
        return 0, 0.0, 0.0
    v = np.sort(np.array(values))
    m = float(np.median(v))
    return len(v), m, _sigma(float(np.median(np.abs(v - m))), m, v)


def seasonal_stats(t: np.ndarray, v: np.ndarray, bucket: np.ndarray, weekend: np.ndarray, good: np.ndarray, own: np.ndarray, lookback: int) -> np.ndarray:
    """n, median and sigma of values of the same time of day and day type; of the neighbouring buckets of any day where those are too few."""
    same, near = defaultdict(lambda: ([], [])), defaultdict(lambda: ([], []))
    for at, x, k, w in zip(t[good].tolist(), v[good].tolist(), bucket[good].tolist(), weekend[good].tolist(), strict=True):
        for group in (same[k, w], near[k]):
            group[0].append(at)
            group[1].append(x)

    def between(group: tuple[list[int], list[float]], at: int) -> list[float]:
        return group[1][bisect_left(group[0], at - lookback) : bisect_right(group[0], at - LAG_SECONDS)]

    out = np.zeros((int(own.sum()), 3))
    for i, (at, k, w) in enumerate(zip(t[own].tolist(), bucket[own].tolist(), weekend[own].tolist(), strict=True)):
        found = between(same[k, w], at) if (k, w) in same else []
        if len(found) < MIN_SAMPLES:
            found = [x for b in (k - 1, k, k + 1) if b in near for x in between(near[b], at)]
        out[i] = _small_stats(found)
    return out


def sliding_mahalanobis(x: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, sigmas) of x[rows] from the medians of x[a:b] under their sample covariance."""
    d, n = x.shape[1], (b - a).astype(float)
    centred = x - x.mean(axis=0) if len(x) else x
    i, j = np.triu_indices(d)
    first = np.concatenate([np.zeros((1, d)), np.cumsum(centred, axis=0)])
    second = np.concatenate([np.zeros((1, len(i))), np.cumsum(centred[:, i] * centred[:, j], axis=0)])
    center = np.stack([sliding_median(x[:, c], a, b) for c in range(d)], axis=1)
    delta, distance, sigmas = x[rows] - center, np.zeros(len(rows)), np.zeros((len(rows), d))
    for some in np.array_split(np.arange(len(rows)), max(1, len(rows) // 2048)):
        s, m = first[b[some]] - first[a[some]], n[some, None]
        flat = (second[b[some]] - second[a[some]] - s[:, i] * s[:, j] / np.maximum(m, 1)) / np.maximum(m - 1, 1)
        cov = np.zeros((len(some), d, d))
        cov[:, i, j] = cov[:, j, i] = np.where(m > 1, flat, 0.0)
        cov[:, range(d), range(d)] = np.maximum(cov[:, range(d), range(d)], 0.0) + 1e-6
        distance[some] = np.sqrt(np.maximum(np.einsum("ri,rij,rj->r", delta[some], np.linalg.pinv(cov, hermitian=True), delta[some]), 0.0))
        sigmas[some] = np.abs(delta[some]) / np.maximum(np.sqrt(cov[:, range(d), range(d)]), EPS)
    return distance, sigmas


def with_past(df: DataFrame, columns: dict[str, tuple[str, ...]], lookback_seconds: int, features: list[str] | None = None, by: list[str] | None = None, alpha: float = 0.25, k: float = 0.5, trend_points: int = 40, bucket_minutes: int = 15, time: str = "window_start") -> DataFrame:
    """``df`` with a struct ``p_<column>`` of the numbers of the asked ``PARTS`` over each row's strict past.

    ``features``: adds ``p_mahalanobis`` as well, of (n, distance, sigmas).  ``by``: columns that tell several series apart.
    Null and non-finite values are no part of a column's past, and zeros among features.
    """
    from tidegauge.operators.detectors import chunked

    by, features, numbers = by or [], features or [], list(columns)
    asked = {c: [x for part in PARTS if part in {*kinds, *(("stats",) if "cusum" in kinds else ())} for x in PARTS[part]] for c, kinds in columns.items()}
    value = {f"_v{i}": F.col(c).cast("double") for i, c in enumerate(numbers)} | {f"_f{i}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for i, c in enumerate(features)}
    epoch = F.unix_timestamp(time)
    rows = df.withColumn("_epoch", epoch).withColumn("_print", F.xxhash64(*value.values()))
    narrow = rows.select(*by, time, "_epoch", "_print", F.floor((F.hour(time) * 60 + F.minute(time)) / bucket_minutes).cast("int").alias("_bucket"), (F.weekday(time) >= 5).alias("_weekend"), *[c.alias(n) for n, c in value.items()])
    keys = [*by, "chunk"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = chunked(narrow, lookback_seconds, time=time).drop(time).repartition(parts, *keys).sortWithinPartitions(*keys, "_epoch")

    def work(held: pd.DataFrame) -> pd.DataFrame:
        t, own = held["_epoch"].to_numpy(), held["own"].to_numpy(bool)
        out = held.loc[own, [*by, "_epoch", "_print"]].reset_index(drop=True)
        for at, c in enumerate(numbers):
            v = held[f"_v{at}"].to_numpy(float)
            good = np.isfinite(v)
            e, f = t[good], v[good]
            a, b = np.searchsorted(e, t[own] - lookback_seconds), np.searchsorted(e, t[own])
            made: dict[str, np.ndarray] = {}
            if "n" in asked[c]:
                made["stats"] = sliding_stats(f, a, b)
            if "level" in asked[c]:
                made["ewma"] = sliding_ewma(f, a, b, alpha)
            if "pos" in asked[c]:
                made["cusum"] = sliding_cusum(f, a, b, made["stats"], k)
            if "points" in asked[c]:
                made["trend"] = sliding_trend(f, a, b, trend_points)
            if "s_n" in asked[c]:
                made["seasonal"] = seasonal_stats(t, v, held["_bucket"].to_numpy(), held["_weekend"].to_numpy(), good, own, lookback_seconds)
            for part, found in made.items():
                for i, name in enumerate(PARTS[part]):
                    out[f"_{at}_{name}"] = found[:, i]
        if features:
            x = held[[f"_f{i}" for i in range(len(features))]].to_numpy(float)
            a, b = np.searchsorted(t, t[own] - lookback_seconds), np.searchsorted(t, t[own])
            distance, sigmas = sliding_mahalanobis(x, np.flatnonzero(own), a, b)
            out["_m_n"], out["_m_distance"], out["_m_sigmas"] = (b - a).astype(float), distance, list(sigmas)
        return out.drop_duplicates([*by, "_epoch", "_print"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of one chunk

        def flushed() -> Iterator[pd.DataFrame]:
            whole = pd.concat(held, ignore_index=True)
            held.clear()
            if whole["own"].any():  # after the last row only its lookback goes on
                yield work(whole)

        for batch in batches:
            key = batch[keys].astype(object)
            new = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())[1:].tolist()
            if held and not (held[-1][keys].iloc[-1].astype(object) == key.iloc[0]).all():
                yield from flushed()
            for low, high in zip([0, *new], [*new, len(batch)], strict=True):
                if low:
                    yield from flushed()
                held.append(batch.iloc[low:high])
        if held:
            yield from flushed()

    named = [(at, c, x) for at, c in enumerate(numbers) for x in asked[c]]
    schema = [*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], "_epoch bigint", "_print bigint", *[f"_{at}_{x} double" for at, _, x in named]]
    if features:
        schema += ["_m_n double", "_m_distance double", "_m_sigmas array<double>"]
    past = placed.mapInPandas(run, ", ".join(schema))
    structs: list[Column] = [F.struct(*[F.col(f"_{at}_{x}").alias(x) for x in asked[c]]).alias(f"p_{c}") for at, c in enumerate(numbers)]
    if features:
        structs.append(F.struct(F.col("_m_n").alias("n"), F.col("_m_distance").alias("distance"), F.col("_m_sigmas").alias("sigmas")).alias("p_mahalanobis"))
    past = past.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_epoch").alias("_e"), F.col("_print").alias("_p"), *structs)
    same = [F.col("_epoch") == F.col("_e"), F.col("_print") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]]
    return rows.join(past, same).drop("_epoch", "_print", "_e", "_p", *[f"_by_{c}" for c in by])
