"""Robust statistics, scores and anomaly assembly as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9
#: Weights of detectors in fusion.
WEIGHTS = {"robust_zscore": 1.0, "ewma": 0.9, "seasonal": 1.2, "cusum": 0.8, "trend": 1.15, "isolation_forest": 1.1, "mahalanobis": 0.7, "entropy": 1.0, "rule": 1.3}
#: Severities from the least, and the score from which each holds.
SEVERITIES = (("info", 0.0), ("low", 30.0), ("medium", 50.0), ("high", 70.0), ("critical", 85.0))
RESULT = "struct<detector:string,score:double,triggered:boolean,reason:string,evidence:map<string,string>,cold:boolean>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def median(values: Column) -> Column:
    """Of an array of doubles; null for an empty one."""
    n = F.size(values)
    middle = lambda s: (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2
    return F.when(n > 0, let(F.array_sort(values), middle))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def spread(values: Column) -> Column:
    """Population standard deviation of an array."""
    return let(mean(values), lambda m: F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(values)))


def finite(values: Column) -> Column:
    return F.filter(values.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def robust_stats(values: Column) -> Column:
    """struct(n, median, mad, sigma): sigma is 1.4826 MAD, else the standard deviation, else a tenth of the level, 1 at least."""

    def of(v: Column) -> Column:
        def scaled(m: Column) -> Column:
            def result(mad: Column) -> Column:
                wide = F.when(1.4826 * mad >= EPS, 1.4826 * mad)
                sigma = F.coalesce(wide, let(spread(v), lambda s: F.when(s >= EPS, s)), F.greatest(F.abs(m) * 0.1, F.lit(1.0)))
                return F.struct(F.size(v).alias("n"), m.alias("median"), mad.alias("mad"), sigma.alias("sigma"))

            return let(median(F.transform(v, lambda x: F.abs(x - m))), result)

        none = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("median"), F.lit(0.0).alias("mad"), F.lit(0.0).alias("sigma"))
        return F.when(F.size(v) > 0, let(median(v), scaled)).otherwise(none)

    return let(finite(values), of)


def soft_score(z: Column, threshold, sharpness: float = 3.0) -> Column:
    """Logistic, 0.5 at the threshold; not a number or infinite: 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    raw = 1 / (1 + F.exp(-F.greatest(F.least((z - t) / (t / sharpness), F.lit(60.0)), F.lit(-60.0))))
    return F.when(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf")), 0.0).otherwise(raw)


def ratio_score(observed: Column, expected: Column, multiplier) -> Column:
    return soft_score(observed / F.greatest(expected, F.lit(EPS)), multiplier, 4.0)


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of the positive counts of an array."""
    positive = F.filter(counts.cast("array<double>"), lambda c: c > 0)
    return let(positive, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, c: a + c), lambda n: F.aggregate(p, F.lit(0.0), lambda a, c: a - (c / n) * F.log2(c / n))))


def norm_entropy(counts: Column) -> Column:
    n = F.size(F.filter(counts.cast("array<double>"), lambda c: c > 0))
    return F.when(n < 2, 0.0).otherwise(entropy(counts) / F.log2(n.cast("double")))


def gini(values: Column) -> Column:
    """Gini coefficient of an array of non-negative values; 0 without any."""

    def of(s: Column) -> Column:
        n = F.size(s)
        weighted = F.aggregate(F.zip_with(s, F.sequence(F.lit(1), n), lambda x, i: (2 * i - n - 1) * x), F.lit(0.0), lambda a, x: a + x)
        total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, weighted / (n * total)).otherwise(0.0)

    return F.when(F.size(values) > 0, let(F.array_sort(values.cast("array<double>")), of)).otherwise(0.0)


def result(detector: str, score: Column, triggered: Column, reason: Column, evidence: dict[str, Column], warm: Column) -> Column:
    """A detector's struct; neutral where it isn't warm."""
    shown = F.create_map(*[x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]) if evidence else F.create_map().cast("map<string,string>")
    made = F.struct(F.lit(detector).alias("detector"), score.alias("score"), triggered.alias("triggered"), reason.alias("reason"), shown.alias("evidence"), F.lit(False).alias("cold"))
    none = F.struct(F.lit(detector).alias("detector"), F.lit(0.0).alias("score"), F.lit(False).alias("triggered"), F.lit("not enough history").alias("reason"), F.create_map(F.lit("status"), F.lit("cold_start")).alias("evidence"), F.lit(True).alias("cold"))
    return F.when(warm, made.cast(RESULT)).otherwise(none.cast(RESULT))


def rule(score: Column, reason: Column, evidence: dict[str, Column] | None = None) -> Column:
    """A domain rule as a detector."""
    held = F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))
    return result("rule", held, held >= 0.5, reason, evidence or {}, F.lit(True))


def fuse(results: Column) -> Column:
    """struct(score 0-100, confidence, agreement, detectors) of an array of detector structs.

    Weighted noisy-or of those that aren't cold: agreeing detectors reinforce each other, a silent
    one doesn't dilute a confident one.
    """
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])

    def of(active: Column) -> Column:
        rest = F.aggregate(active, F.lit(1.0), lambda a, r: a * (1 - F.least(F.greatest(r["score"] * F.least(F.coalesce(weight[r["detector"]], F.lit(1.0)), F.lit(1.5)), F.lit(0.0)), F.lit(0.999))))
        agreement = F.size(F.filter(active, lambda r: r["score"] >= 0.5))
        confidence = F.least(F.lit(1.0), F.size(active) / 4) * (0.6 + 0.4 * F.least(agreement, F.lit(3)) / 3)
        return F.struct(
            F.round(100 * (1 - rest), 2).alias("score"),
            F.round(F.when(F.size(active) > 0, confidence).otherwise(0.0), 3).alias("confidence"),
            agreement.alias("agreement"),
            F.transform(F.filter(active, lambda r: r["score"] >= 0.3), lambda r: r["detector"]).alias("detectors"),
        )

    return let(F.filter(results, lambda r: ~r["cold"]), of)


def severity(score: Column) -> Column:
    out = F.lit(SEVERITIES[0][0])
    for name, least in SEVERITIES[1:]:
        out = F.when(score >= least, name).otherwise(out)
    return out


def severity_rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (s, _) in enumerate(SEVERITIES):
        out = F.when(name == s, i).otherwise(out)
    return out


def by_score(results: Column) -> Column:
    """Detector structs, the highest score first; ties keep their order."""
    keyed = F.transform(results, lambda r, i: F.struct((-r["score"]).alias("k"), i.alias("i"), F.struct(r["detector"], r["score"], r["triggered"], r["reason"]).alias("r")))
    # maps don't sort: the order is made on the other fields
    return F.transform(F.array_sort(F.transform(keyed, lambda x: F.struct(x["k"], x["i"]))), lambda x: F.element_at(results, x["i"] + 1))


def reason_text(headline: Column, results: Column, limit: int = 3) -> Column:
    """The headline and the reasons of the strongest detectors."""
    strong = F.slice(by_score(F.filter(results, lambda r: (r["score"] >= 0.25) & ~r["cold"])), 1, limit)
    detail = F.concat_ws("; ", F.transform(strong, lambda r: r["reason"]))
    return F.when(detail == "", headline).otherwise(F.concat(headline, F.lit(". "), detail))


def iso(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssxxx")


def content_id(prefix: str, parts: list[Column], length: int) -> Column:
    """The same content gets the same id, so that processing it again doesn't add a row."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, length))


def anomaly_id(kind: Column, entity_type: Column, entity: Column, window_start: Column) -> Column:
    return content_id("anm_", [kind, entity_type, entity, iso(window_start)], 20)


def anomaly(df: DataFrame, kind, entity_type: str, entity: Column, results: list[Column], headline: Column, metrics: list[str], keep: Column | None = None, floor: float = 30.0, service: str | None = None) -> Column:
    """The anomaly struct of a row of ``df`` whose fused detectors reach the floor (and ``keep``), else null.

    Detectors are scored only where ``keep`` holds."""
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    numbers = F.create_map(*[x for m in metrics for x in (F.lit(m), F.round(F.col(m).cast("double"), 4))]) if metrics else F.create_map().cast("map<string,double>")
    label = F.col("dominant_attack_label") if "dominant_attack_label" in df.columns else F.lit(None).cast("string")

    def made(held: Column) -> Column:
        def of(fused: Column) -> Column:
            fields = F.struct(
                anomaly_id(kind, F.lit(entity_type), entity, F.col("window_start")).alias("anomaly_id"),
                kind.alias("type"),
                F.lit(entity_type).alias("entity_type"),
                entity.alias("entity"),
                (F.col(service) if service else F.lit(None).cast("string")).alias("service"),
                fused["score"].alias("score"),
                fused["confidence"].alias("confidence"),
                severity(fused["score"]).alias("severity"),
                F.element_at(by_score(held), 1)["detector"].alias("detector"),
                fused["detectors"].alias("detectors"),
                fused["agreement"].alias("agreement"),
                reason_text(headline, held).alias("reason"),
                headline.alias("headline"),
                F.col("window_start").alias("window_start"),
                F.col("window_end").alias("window_end"),
                F.col("window_end").alias("detected_at"),
                numbers.alias("metrics"),
                F.filter(held, lambda r: ~r["cold"]).alias("contributing"),
                F.lit("open").alias("status"),
                label.alias("ground_truth"),
            )
            return F.when(fused["score"] >= floor, fields)

        return let(fuse(held), of)

    found = let(F.array(*results), made)
    return F.when(keep, found) if keep is not None else found


def emit(df: DataFrame, *found: str) -> DataFrame:
    """The anomalies in columns ``found`` of the rows of ``df``, one row each."""
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("_found")).select("_found.*")


def make_anomalies(df: DataFrame, kind, entity_type: str, entity: Column, results: list[Column], headline: Column, metrics: list[str], keep: Column | None = None, floor: float = 30.0, service: str | None = None) -> DataFrame:
    """Rows of ``df`` whose fused detectors reach the floor (and ``keep``), as anomalies."""
    return emit(df.withColumn("_a", anomaly(df, kind, entity_type, entity, results, headline, metrics, keep, floor, service)), "_a")


def dedupe(anomalies: DataFrame) -> DataFrame:
    """The best-scored row of each anomaly id."""
    rank = F.row_number().over(Window.partitionBy("anomaly_id").orderBy(F.desc("score"), "reason"))
    return anomalies.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
