"""Predicates over logs, metrics, anomalies, incidents and alerts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegauge.functions.stats import severity_rank

#: Fields that a search may name, by what it may call them.
FIELDS = {f: f for f in ["status", "method", "path", "endpoint", "ip", "service", "country", "city", "session_id", "user_id", "user_agent", "host", "region", "referrer", "asn", "org", "device", "browser", "os", "cache_status", "is_bot", "response_time_ms", "bytes_sent", "protocol", "tls_version", "request_id", "event_id"]}
ALIASES = {"rt": "response_time_ms", "latency": "response_time_ms", "response_time": "response_time_ms", "bytes": "bytes_sent", "size": "bytes_sent", "code": "status", "url": "path", "route": "endpoint", "ua": "user_agent", "agent": "user_agent", "session": "session_id", "user": "user_id", "bot": "is_bot", "cache": "cache_status", "verb": "method"}
NUMERIC = frozenset(["status", "response_time_ms", "bytes_sent"])
TEXT_FIELDS = ("path", "user_agent", "ip", "endpoint", "session_id")
UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
LONGEST_RANGE = timedelta(days=92)


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def free_text(df: DataFrame, term: str) -> Column:
    """The term somewhere in the searched fields, in either case."""
    return either([F.coalesce(F.lower(F.col(f).cast("string")).contains(term.lower()), F.lit(False)) for f in TEXT_FIELDS if f in df.columns])


def _condition(df: DataFrame, field: str, op: str, value) -> Column:
    name = ALIASES.get(field, FIELDS.get(field))
    if name is None or name not in df.columns:
        return free_text(df, f"{field}{op}{value}" if op != ":" else str(value))
    column = F.col(name)
    if name == "is_bot":
        wanted = str(value).lower() in ("true", "1", "yes")
        return column.eqNullSafe(F.lit(wanted)) if op in (":", "=") else ~column.eqNullSafe(F.lit(wanted))
    if op in (">", ">=", "<", "<="):
        number = F.lit(float(value))
        return {">": column > number, ">=": column >= number, "<": column < number, "<=": column <= number}[op]
    if name in NUMERIC and re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", str(value)):
        same = column.cast("double").eqNullSafe(F.lit(float(value)))
    elif "*" in str(value) or "?" in str(value):
        glob = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in str(value))
        same = column.cast("string").rlike(f"(?is)^{glob}$")
    else:
        same = F.lower(column.cast("string")).eqNullSafe(F.lit(str(value).lower()))
    same = F.coalesce(same, F.lit(False))
    return ~same if op == "!=" else same


def search_filter(df: DataFrame, predicates: list[tuple] = (), terms: list[str] = ()) -> DataFrame:
    """Rows that meet every (field, op, value, negated) and hold one of the terms.

    A negated predicate, and ``!=``, also hold where the field is null.  Unknown fields are text.
    """
    tests = []
    for field, op, value, *negated in predicates:
        test = F.coalesce(_condition(df, field, op, value), F.lit(False))
        tests.append(~test if negated and negated[0] else test)
    if terms:
        tests.append(either([free_text(df, t) for t in terms]))
    return df.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def explore_filter(df: DataFrame, status: str | None = None, methods=(), services=(), countries=(), endpoint=None, ip=None, session=None, min_latency=None, only_errors: bool = False) -> DataFrame:
    """Facet filters; ``status`` lists codes and classes (``404,5xx``), any of which holds."""
    if status:
        tests = []
        for part in [p.strip().lower() for p in status.split(",") if p.strip()]:
            if re.fullmatch(r"[1-5]xx", part):
                tests.append((F.col("status") >= int(part[0]) * 100) & (F.col("status") < int(part[0]) * 100 + 100))
            elif part.isdigit():
                tests.append(F.col("status") == int(part))
        df = df.filter(either(tests))
    for column, values in (("method", [m.upper() for m in methods]), ("service", list(services)), ("country", [c.upper() for c in countries])):
        df = df.filter(F.col(column).isin(values)) if values else df
    for column, value in (("endpoint", endpoint), ("ip", ip), ("session_id", session)):
        df = df.filter(F.col(column) == value) if value else df
    df = df.filter(F.col("response_time_ms") >= min_latency) if min_latency is not None else df
    return df.filter(F.col("status") >= 400) if only_errors else df


def resolve_range(start=None, end=None, last: str | None = None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """A relative (``15m``, ``6h``, ``7d``, ``2w``) or absolute range."""
    if last:
        m = re.fullmatch(r"([0-9]+)([smhdw])", last)
        if not m:
            raise ValueError(f"not a range: {last}")
        end = end or now or datetime.utcnow()
        start = end - timedelta(**{UNITS[m[2]]: int(m[1])})
    if start is None or end is None or end <= start:
        raise ValueError("the end must come after the start")
    if end - start > LONGEST_RANGE:
        raise ValueError("ranges hold 92 days at most")
    return start, end


def in_range(df: DataFrame, start, end, column: str = "window_start") -> DataFrame:
    """Closed at both ends; a ``date`` partition column prunes files."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    df = df.filter(F.col(column).between(low, high))
    return df.filter(F.col("date").between(low.cast("date"), high.cast("date"))) if "date" in df.columns else df


def severity_at_least(df: DataFrame, least: str, column: str = "severity") -> DataFrame:
    return df.filter(severity_rank(F.col(column)) >= severity_rank(F.lit(least)))


def tail_filter(stream: DataFrame, only_errors: bool = False, min_status: int | None = None, endpoint: str | None = None, ip: str | None = None, service: str | None = None, text: str | None = None) -> DataFrame:
    """Filter of live events; works on streams."""
    stream = stream.filter(F.col("status") >= 400) if only_errors else stream
    stream = stream.filter(F.col("status") >= min_status) if min_status is not None else stream
    stream = stream.filter(F.col("endpoint").contains(endpoint)) if endpoint else stream
    stream = stream.filter(F.col("ip") == ip) if ip else stream
    stream = stream.filter(F.col("service") == service) if service else stream
    if text:
        stream = stream.filter(F.lower(F.concat_ws(" ", "path", "user_agent", "ip")).contains(text.lower()))
    return stream


def capped_tail(stream: DataFrame, clients: list[str], per_second: int = 40, time: str = "event_time") -> DataFrame:
    """The events that each of ``clients`` is shown: at most ``per_second`` of every second of ``time``: those of its
    earliest batches, any of a batch that holds more.

    ``stream`` has a watermark on ``time``.  State is one count for each client and open second, however fast events
    come; it goes when the watermark passes the second.
    """
    names = F.explode(F.array(*[F.lit(c) for c in clients]))
    keyed = stream.withColumn("client", names).withColumn("_second", F.unix_timestamp(time))
    columns = [c for c in keyed.columns if c != "_second"]

    def cap(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.getOption[0] if state.exists else 0
        for batch in batches:
            kept = batch[columns].iloc[: max(0, per_second - seen)]
            seen += len(kept)
            if len(kept):
                yield kept
        state.update((seen,))
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * 1000, state.getCurrentWatermarkMs() + 1))

    schema = keyed.select(*columns).schema
    return keyed.groupBy("client", "_second").applyInPandasWithState(cap, schema, "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def anomaly_feed(anomalies: DataFrame, start=None, end=None, severity: str | None = None, types=(), entity: str | None = None, status: str | None = None, min_score: float | None = None, detector: str | None = None, sort: str = "window_start", descending: bool = True, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page of anomalies, and how many there are in all (one row)."""
    df = in_range(anomalies, start, end) if start is not None else anomalies
    df = severity_at_least(df, severity) if severity else df
    df = df.filter(F.col("type").isin(list(types))) if types else df
    df = df.filter(F.col("entity") == entity) if entity else df
    df = df.filter(F.col("status") == status) if status else df
    df = df.filter(F.col("score") >= min_score) if min_score is not None else df
    df = df.filter((F.col("detector") == detector) | F.array_contains("detectors", detector)) if detector else df
    key = severity_rank(F.col("severity")) if sort == "severity" else F.col(sort)
    page = df.orderBy(key.desc() if descending else key.asc(), "anomaly_id").offset(offset).limit(limit)
    return page, df.agg(F.count("*").alias("total"))


def incident_list(incidents: DataFrame, start, end, status: str | None = None, severity: str | None = None, family: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Incidents of a range or still open, with the last 12 timeline entries; and the number of each status."""
    live = F.col("status").isin("open", "acknowledged")
    df = incidents.filter(F.col("last_seen_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) | live)
    df = df.filter(F.col("status") == status) if status else df
    df = df.filter(F.col("severity") == severity) if severity else df
    df = df.filter(F.col("family") == family) if family else df
    size = F.size("timeline")
    shown = df.withColumn("timeline", F.slice("timeline", F.greatest(size - 11, F.lit(1)), 12)).orderBy(F.desc("last_seen_at"), "incident_id")
    return shown, incidents.groupBy("status").agg(F.count("*").alias("incidents"))


def alert_list(alerts: DataFrame, start=None, end=None, severity: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    df = in_range(alerts, start, end, "fired_at") if start is not None else alerts
    df = df.filter(F.col("severity") == severity) if severity else df
    df = df.filter(F.col("status") == status) if status else df
    return df.orderBy(F.desc("fired_at"), "alert_id").limit(limit)
