"""Incidents from anomalies, and alerts from rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.stats import content_id, iso, severity_rank

#: The family of each type, and the rules that ship with the product.
FAMILIES = {
    "ddos_burst": "security", "suspicious_ip": "security", "endpoint_scan": "security", "auth_abuse": "security", "data_scraping": "security", "bot_surge": "security", "geo_anomaly": "security",
    "error_spike": "availability", "traffic_drop": "availability", "latency_anomaly": "performance", "slow_endpoint": "performance",
    "traffic_spike": "traffic", "multivariate_anomaly": "traffic", "session_anomaly": "behaviour",
}
DEFAULT_RULES = (
    # id, least severity, types, entity types, least score, cooldown in seconds
    ("rule-critical-any", "critical", (), (), None, 120),
    ("rule-error-spike", "high", ("error_spike",), (), None, 180),
    ("rule-ddos", "high", ("ddos_burst", "suspicious_ip"), (), None, 60),
    ("rule-latency", "medium", ("latency_anomaly", "slow_endpoint"), (), None, 300),
    ("rule-auth-abuse", "medium", ("auth_abuse", "endpoint_scan"), (), None, 120),
)
RULE_SCHEMA = "rule_id string, severity_at_least string, types array<string>, entity_types array<string>, min_score double, cooldown_seconds int"


def family(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[kind], F.lit("other"))


#: Times of a key are put in order in stretches of this length, which are joined at their edges.
STRETCH_SECONDS = 6 * 3600
GROUP = ["family", "entity_type", "group"]


def with_group(anomalies: DataFrame) -> DataFrame:
    """Adds family and group (``*`` for campaigns of sources and for sessions): incidents are of one of each."""
    kind = family(F.col("type"))
    group = F.when((kind == "security") & (F.col("entity_type") == "ip") | (F.col("entity_type") == "session"), "*").otherwise(F.col("entity"))
    return anomalies.withColumn("family", kind).withColumn("group", group)


def _stretch(time: Column) -> Column:
    return F.floor(F.unix_timestamp(time) / STRETCH_SECONDS)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def correlate(anomalies: DataFrame, join_minutes: int = 10) -> DataFrame:
    """Adds family, group and incident_id.

    Anomalies of a key whose gap to the latest before them is longer start a new incident.  Incidents are made of a
    key's distinct times, put in order in stretches of six hours: a key is spread over tasks however many times it
    has.  What a stretch has to know of those before it, their last time and the last start, is a row a stretch.
    """
    keyed = with_group(anomalies)
    times = keyed.select(*GROUP, "window_start").distinct().withColumn("_part", _stretch(F.col("window_start")))
    parts, along = [*GROUP, "_part"], Window.partitionBy(*GROUP).orderBy("_part")
    ends = times.groupBy(*parts).agg(F.max("window_start").alias("_end")).withColumn("_before", F.lag("_end").over(along)).drop("_end")
    order = Window.partitionBy(*parts).orderBy("window_start")
    known = _joined(times, ends, parts)
    last = F.coalesce(F.lag("window_start").over(order), "_before")
    new = F.when(last.isNull() | (F.unix_timestamp("window_start") - F.unix_timestamp(last) > 60 * join_minutes), F.col("window_start"))
    known = known.withColumn("_new", new)
    opened = known.groupBy(*parts).agg(F.max("_new").alias("_new")).withColumn("_open", F.max("_new").over(along.rowsBetween(Window.unboundedPreceding, -1))).drop("_new")
    within = F.max("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    starts = _joined(known.withColumn("_within", within), opened, parts).select(*GROUP, "window_start", F.coalesce("_within", "_open").alias("incident_start"))
    found = _joined(keyed, starts, [*GROUP, "window_start"])
    return found.withColumn("incident_id", _incident_id())


def _incident_id() -> Column:
    return content_id("inc_", [F.col("family"), F.col("entity_type"), F.col("group"), iso(F.col("incident_start"))], 18)


#: Steps after which the score of an incident doesn't move at an unchanged peak: each leaves three tenths of the distance.
SETTLED = 40
ANOMALY_IDS, ENTITIES, TIMELINE = 500, 50, 120
KEYS = ["incident_id", *GROUP]
STEPS = "array<struct<peak:double,times:int>>"


def _risen(steps: Column) -> Column:
    """Steps (peak, how often it or a lower score followed) with those that don't rise counted to the one before."""

    def rise(a: Column, x: Column) -> Column:
        last = F.try_element_at(a, F.lit(-1))
        more = F.struct(last["peak"].alias("peak"), F.least(last["times"] + x["times"], F.lit(SETTLED)).alias("times"))
        return F.when((F.size(a) > 0) & (x["peak"] <= last["peak"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(more))).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(steps, F.array().cast(STEPS), rise)


def _tail(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def summaries(anomalies: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each of ``keys`` and window: what ``merged`` puts together, lists already of bounded length."""
    m = lambda name: F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(0.0))
    item = F.struct("anomaly_id", "score", "type", "severity", "entity", "headline", "detector")
    found = anomalies.groupBy(*keys, "window_start").agg(
        F.count("*").alias("n"), F.max("score").alias("peak"), F.array_sort(F.collect_list(item)).alias("_all"),
        F.min_by(F.struct("severity", "type", "reason"), F.struct(-severity_rank(F.col("severity")), "anomaly_id")).alias("worst"),
        F.sum(m("requests")).alias("requests"), F.max(m("error_rate")).alias("error_rate"), F.max(m("p95_response_time")).alias("p95"), F.max(m("rps")).alias("rps"),
        F.min_by("ground_truth", F.when(F.col("ground_truth").isNotNull(), F.col("anomaly_id"))).alias("ground_truth"),
    )
    one, each = F.element_at("_all", 1), lambda c: F.transform("_all", lambda x: x[c])
    shown = F.struct(F.col("window_start").alias("at"), one["type"].alias("type"), one["severity"].alias("severity"), one["score"].alias("score"), one["entity"].alias("entity"), one["headline"].alias("reason"))
    steps = F.transform("_all", lambda x: F.struct(x["score"].cast("double").alias("peak"), F.lit(1).alias("times")))
    return found.select(
        *keys, F.col("window_start").alias("at"), F.col("window_start").alias("last_at"), "n", "peak", F.struct(F.col("worst"), F.col("window_start").alias("at")).alias("worst"),
        "requests", "error_rate", "p95", "rps", F.when(F.col("ground_truth").isNotNull(), F.struct(F.col("window_start").alias("at"), F.col("ground_truth").alias("label"))).alias("truth"),
        _risen(steps).alias("steps"), _tail(each("anomaly_id"), ANOMALY_IDS).alias("ids"), F.array_distinct(each("detector")).alias("detectors"), F.array_distinct(each("type")).alias("types"),
        F.slice(F.array_distinct(each("entity")), 1, ENTITIES).alias("entities"), F.array(shown).alias("timeline"),
    )


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of each of ``keys``, whose times don't interleave, as one.

    Merging is associative, and a summary stays small: ids, entities and timeline are bounded, steps are those scores
    that rose above all before them.
    """
    lists = ["steps", "ids", "detectors", "types", "entities", "timeline"]
    found = parts.groupBy(*keys).agg(
        F.min("at").alias("at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n"), F.max("peak").alias("peak"),
        F.max_by("worst", F.struct(severity_rank(F.col("worst.worst.severity")), -F.unix_timestamp("worst.at"))).alias("worst"),
        F.sum("requests").alias("requests"), F.max("error_rate").alias("error_rate"), F.max("p95").alias("p95"), F.max("rps").alias("rps"), F.min("truth").alias("truth"),
        F.array_sort(F.collect_list(F.struct("at", *lists))).alias("_parts"),
    )

    def flat_of(c: str) -> Column:
        return F.flatten(F.transform("_parts", lambda x: x[c]))

    flat = {c: flat_of(c) for c in lists}
    made = {"steps": _risen(flat["steps"]), "ids": _tail(flat["ids"], ANOMALY_IDS), "detectors": F.array_distinct(flat["detectors"]), "types": F.array_distinct(flat["types"]), "entities": F.slice(F.array_distinct(flat["entities"]), 1, ENTITIES), "timeline": _tail(flat["timeline"], TIMELINE)}
    return found.select(*[c for c in parts.columns if c in keys or (c in found.columns and c not in lists)], *[made[c].alias(c) for c in lists])


def described(found: DataFrame) -> DataFrame:
    """Incidents as users see them, of merged summaries with incident_id."""

    def step(a: Column, score: Column) -> Column:
        peak = F.greatest(a["peak"], score)
        return F.struct(peak.alias("peak"), F.round(0.7 * peak + 0.3 * F.when(a["score"] == 0, score).otherwise(a["score"]), 2).alias("score"))

    # a score of its step's peak first, then scores that don't raise it
    folded = F.aggregate(
        "steps", F.struct(F.lit(0.0).alias("peak"), F.element_at("steps", 1)["peak"].alias("score")),
        lambda a, s: F.aggregate(F.sequence(F.lit(1), s["times"]), a, lambda b, _: step(b, s["peak"])), lambda a: a["score"],
    )
    worst = F.col("worst.worst")
    return found.select(
        "incident_id", "family", "entity_type", F.col("group").alias("entity"), F.col("n").alias("anomaly_count"), F.col("at").alias("started_at"), F.col("last_at").alias("last_seen_at"), F.col("peak").alias("peak_score"), folded.alias("score"),
        worst["severity"].alias("severity"), worst["type"].alias("type"), worst["reason"].alias("summary"),
        F.when(F.col("entity_type") == "global", F.concat(worst["type"], F.lit(" across the platform"))).when(F.col("group") == "*", F.concat(worst["type"], F.lit(" from multiple sources"))).otherwise(F.concat(worst["type"], F.lit(" on "), "group")).alias("title"),
        F.col("ids").alias("anomaly_ids"), "detectors", "types", "entities", "timeline",
        F.col("requests").cast("bigint").alias("impact_requests"), F.col("error_rate").alias("peak_error_rate"), F.col("p95").alias("peak_p95_ms"), F.col("rps").alias("peak_rps"),
        F.round((F.unix_timestamp("last_at") - F.unix_timestamp("at")) / 60 + 1, 1).alias("duration_minutes"),
        F.lit("open").alias("status"), F.col("truth.label").alias("ground_truth"),
    )


def fold_incidents(correlated: DataFrame) -> DataFrame:
    """One row an incident: counts, peak, the score folded in order of (window_start, anomaly_id), the worst severity and
    its text, and lists of bounded length.

    Anomalies become one summary for each window, those of a stretch of six hours one, and those of an incident
    one: no task holds more than a stretch's windows, or a row for each stretch.
    """
    windows = summaries(correlated, KEYS).withColumn("_part", _stretch(F.col("at")))
    return described(merged(merged(windows, [*KEYS, "_part"]).drop("_part"), KEYS))


def advance_incidents(state: DataFrame | None, anomalies: DataFrame, join_minutes: int = 10) -> DataFrame:
    """The state of all incidents after a batch of anomalies: ``state`` goes on where a batch's windows follow within the gap.

    ``state`` is what this returned for the batches before (None at first), anomalies come in order of their windows.
    A state row is a summary of bounded size; ``settled`` tells those that no later batch can reach.
    """
    parts = summaries(with_group(anomalies), GROUP)
    parts = parts if state is None else state.drop("incident_start").unionByName(parts)
    order = Window.partitionBy(*GROUP).orderBy("at", "last_at")
    end = F.max("last_at").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(end.isNull() | (F.unix_timestamp("at") - F.unix_timestamp(end) > 60 * join_minutes), F.col("at"))
    begun = parts.withColumn("_new", new).withColumn("incident_start", F.max("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return merged(begun, [*GROUP, "incident_start"])


def settled(watermark, join_minutes: int = 10) -> Column:
    """Whether a state row's incident is over once all windows up to ``watermark`` are in."""
    return F.unix_timestamp("last_at") < F.unix_timestamp(F.lit(watermark).cast("timestamp")) - 60 * join_minutes


def state_incidents(state: DataFrame) -> DataFrame:
    """The incidents of a state."""
    return described(state.withColumn("incident_id", _incident_id()))


def auto_resolve(incidents: DataFrame, now, silence_minutes: int = 15) -> DataFrame:
    quiet = (F.col("status") == "open") & (F.col("last_seen_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {silence_minutes} minutes"))
    return incidents.withColumn("status", F.when(quiet, "resolved").otherwise(F.col("status")))


def rules_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([(i, s, list(t), list(e), m, c) for i, s, t, e, m, c in rules], RULE_SCHEMA)


def match_rules(anomalies: DataFrame, rules: DataFrame) -> DataFrame:
    """Every (anomaly, rule) that fits; empty conditions fit all.  Rules are few: users edit them by hand."""
    fits = F.coalesce(severity_rank(F.col("severity")) >= severity_rank(F.col("severity_at_least")), F.lit(True))
    fits &= (F.size("types") == 0) | F.array_contains("types", F.col("type"))
    fits &= (F.size("entity_types") == 0) | F.array_contains("entity_types", F.col("entity_type"))
    fits &= F.col("min_score").isNull() | (F.col("score") >= F.col("min_score"))
    return anomalies.drop("types", "entity_types").join(F.broadcast(rules), fits)


def fire_alerts(matches: DataFrame, fired: DataFrame | None = None) -> DataFrame:
    """Alerts of matches: one an id, and none within the cooldown of one that fired for the same rule and entity.

    The strongest match of an id stays.  The cooldown runs on ``detected_at``, so batches can be repeated; ``fired``
    are alerts of earlier batches, whose ids don't fire again and whose cooldowns still hold.  The distinct times of a (rule, entity) are read in
    order with the last that fired in hand: from each the next that may fire is found by bisection, and no more than a
    batch of them is held.
    """
    subject = F.coalesce(F.col("incident_id"), F.col("entity")) if "incident_id" in matches.columns else F.col("entity")
    named = matches.withColumn("alert_id", content_id("alt_", [F.col("rule_id"), subject, iso(F.col("window_start"))], 18))
    rank = F.row_number().over(Window.partitionBy("alert_id").orderBy(F.desc("score"), "anomaly_id"))
    single = named.withColumn("_rank", rank).filter("_rank = 1").drop("_rank").withColumn("_at", F.unix_timestamp("detected_at"))
    keys, before = ["rule_id", "entity"], None
    if fired is not None:
        single = single.join(fired.select("alert_id"), "alert_id", "left_anti")
        before = fired.groupBy(*keys).agg(F.max(F.unix_timestamp("fired_at")).alias("_last"))
    times = single.select(*keys, "cooldown_seconds", "_at").distinct()
    times = times.withColumn("_last", F.lit(None).cast("bigint")) if before is None else times.join(before, keys, "left")

    def loud(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            kept, starts = [], np.flatnonzero((batch[keys] != batch[keys].shift()).any(axis=1).to_numpy())
            for low, high in zip(starts, [*starts[1:], len(batch)], strict=True):
                here, at = tuple(batch[keys].iloc[low]), batch["_at"].to_numpy()[low:high]
                if here != key:
                    key, last = here, batch["_last"].iloc[low]
                    last = None if pd.isna(last) else last
                i, wait = 0, batch["cooldown_seconds"].iloc[low]
                while (i := i if last is None else int(np.searchsorted(at, last + wait, side="right"))) < len(at):
                    kept.append(low + i)
                    last = at[i]
            yield batch.iloc[kept][[*keys, "_at"]]

    found = times.repartition(*keys).sortWithinPartitions(*keys, "_at").mapInPandas(loud, "rule_id string, entity string, _at bigint")
    first = F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(F.desc("score"), "alert_id"))
    out = single.join(found, [*keys, "_at"]).withColumn("_n", first).filter("_n = 1")
    return out.select("alert_id", "rule_id", "severity", "score", "type", "entity", "entity_type", "anomaly_id", F.col("detected_at").alias("fired_at"), F.col("headline").alias("title"), F.col("reason").alias("message"), F.lit("firing").alias("status"))
