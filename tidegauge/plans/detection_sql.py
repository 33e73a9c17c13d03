"""DuckDB SQL of detectors and detection jobs, composed from steps that each add columns.

Every detector becomes two columns, its score and whether it is cold; a job joins them by weight as
``functions.stats.fuse`` does.  Thresholds are read from the operators, formulas are written anew.
"""

from __future__ import annotations

from tidegauge.functions.stats import EPS, WEIGHTS
from tidegauge.operators.analyzers import COLD_CUSUM_PENALTY, COLD_START_PENALTY, GLOBAL_FEATURES, IP_FEATURES, SERVER_ERROR_DELTA, SERVER_ERROR_FLOOR, SESSION_FEATURES, THRESHOLDS

DAY = 86_400


def soft(z: str, threshold, sharpness: float = 3.0) -> str:
    return f"(case when ({z}) is null or not isfinite(cast({z} as double)) then 0.0 else 1 / (1 + exp(-greatest(least((cast({z} as double) - ({threshold})) / (({threshold}) / {sharpness}), 60), -60))) end)"


class Steps:
    """CTEs over a table, each with more columns than the one before."""

    def __init__(self, source: str):
        self._ctes = [f"t0 as ({source})"]

    def add(self, **columns: str) -> Steps:
        n = len(self._ctes)
        self._ctes.append(f"t{n} as (select *, {', '.join(f'{sql} as {name}' for name, sql in columns.items())} from t{n - 1})")
        return self

    def then(self, sql: str) -> Steps:
        """A whole select from {t}."""
        n = len(self._ctes)
        self._ctes.append(f"t{n} as ({sql.format(t=f't{n - 1}')})")
        return self

    def history(self, values: dict[str, str], where: str, order: str = "epoch(b.window_start)") -> Steps:
        """Lists of the rows b of the same table that stand before a row a."""
        lists = ", ".join(f"list(cast(b.{c} as double) order by {order}) filter (b._id is not null) as {name}" for name, c in values.items())
        shown = ", ".join(f"coalesce({name}, []::double[]) as {name}" for name in values)
        self.then("select *, row_number() over () as _id from {t}")
        self.then(f"select a.*, {shown} from {{t}} a left join (select a._id as _key, {lists} from {{t}} a join {{t}} b on {where} group by 1) h on h._key = a._id")
        return self.then("select * exclude (_id) from {t}")

    def stats(self, p: str, h: str) -> Steps:
        """{p}_n, _med and _sig of a list."""
        self.add(**{f"{p}_n": f"len({h})", f"{p}_med": f"coalesce(list_aggregate({h}, 'median'), 0.0)"})
        self.add(**{f"{p}_mad": f"1.4826 * list_aggregate(list_transform({h}, lambda x: abs(x - {p}_med)), 'median')", f"{p}_sd": f"list_aggregate({h}, 'stddev_pop')"})
        return self.add(**{f"{p}_sig": f"greatest(case when {p}_n = 0 then 0 when {p}_mad >= {EPS} then {p}_mad when {p}_sd >= {EPS} then {p}_sd else greatest(abs({p}_med) * 0.1, 1.0) end, {EPS})"})

    def scored(self, name: str, score: str, cold: str) -> Steps:
        return self.add(**{f"{name}_c": f"({cold})", f"{name}_s": f"(case when {cold} then 0.0 else {score} end)"})

    def robust_z(self, name: str, p: str, value: str, threshold="3.5", points: int = 12, way: str = "up") -> Steps:
        z = f"(({value}) - {p}_med) / {p}_sig"
        held = {"up": f"greatest({z}, 0)", "down": f"greatest(-({z}), 0)", "both": f"abs({z})"}[way]
        return self.scored(name, soft(held, threshold), f"{p}_n < {points}")

    def ewma(self, name: str, h: str, value: str, threshold="3.5", alpha: float = 0.25, points: int = 12) -> Steps:
        held = f"list_transform({h}, lambda x: {{'level': x, 'dev': 0.0::double}})"
        fold = f"lambda a, x: {{'level': {alpha} * x.level + {1 - alpha} * a.level, 'dev': {alpha} * abs(x.level - a.level) + {1 - alpha} * a.dev}}"
        self.add(**{f"{name}_e": f"case when len({h}) > 0 then list_reduce({held}, {fold}) else {{'level': 0.0::double, 'dev': 0.0::double}} end"})
        return self.scored(name, soft(f"(abs(({value}) - {name}_e.level) / greatest(1.2533 * {name}_e.dev, 0.05 * abs({name}_e.level), {EPS}))", threshold), f"len({h}) < {points}")

    def cusum(self, name: str, p: str, h: str, value: str, limit="5.0", k: float = 0.5, points: int = 12) -> Steps:
        start = "{'p': 0.0::double, 'q': 0.0::double}"
        items = f"list_transform(list_append({h}, cast({value} as double)), lambda x: {{'p': (x - {p}_med) / {p}_sig, 'q': 0.0::double}})"
        self.add(**{f"{name}_q": f"list_reduce(list_prepend({start}, {items}), lambda a, x: {{'p': greatest(0.0, a.p + x.p - {k}), 'q': greatest(0.0, a.q - x.p - {k})}})"})
        return self.scored(name, soft(f"greatest({name}_q.p, {name}_q.q)", limit), f"{p}_n < {points}")

    def trend(self, name: str, h: str, value: str, points: int = 12, lookback: int = 40) -> Steps:
        w, n = f"{name}_w", f"len({name}_w)"
        self.add(**{w: f"case when len({h}) > 0 then {h}[-{lookback}:] else [0.0::double] end"})
        self.add(**{f"{name}_slope": f"coalesce(list_aggregate(flatten(list_transform(range(1, {n} + 1), lambda i: list_transform(range(i + 1, {n} + 1), lambda j: ({w}[j] - {w}[i]) / (j - i)))), 'median'), 0.0)"})
        self.add(**{f"{name}_base": f"list_aggregate(list_transform(range(1, {n} + 1), lambda i: {w}[i] - {name}_slope * (i - 1)), 'median')"})
        self.add(**{f"{name}_res": f"list_transform(range(1, {n} + 1), lambda i: {w}[i] - ({name}_base + {name}_slope * (i - 1)))"})
        self.add(**{f"{name}_mid": f"list_aggregate({name}_res, 'median')", f"{name}_sd": f"list_aggregate({name}_res, 'stddev_pop')"})
        self.add(**{f"{name}_mad": f"1.4826 * list_aggregate(list_transform({name}_res, lambda r: abs(r - {name}_mid)), 'median')"})
        spread = f"greatest(case when {name}_mad >= {EPS} then {name}_mad else greatest({name}_sd, abs({name}_base) * 0.02, 1.0) end, {EPS})"
        return self.scored(name, soft(f"greatest((({value}) - ({name}_base + {name}_slope * {n})) / {spread}, 0.0)", "3.5"), f"len({h}) < {points}")

    def seasonal(self, name: str, column: str, lookback: int, bucket_minutes: int = 15, threshold="3.5") -> Steps:
        self.add(_bucket=f"(hour(window_start) * 60 + minute(window_start)) // {bucket_minutes}", _weekend="isodow(window_start) >= 6")
        before = f"epoch(b.window_start) between epoch(a.window_start) - {lookback} and epoch(a.window_start) - 3601"
        self.history({f"{name}_same": column}, f"a._bucket = b._bucket and a._weekend = b._weekend and {before}")
        self.history({f"{name}_near": column}, f"abs(a._bucket - b._bucket) <= 1 and {before}")
        self.add(**{f"{name}_h": f"case when len({name}_same) >= 3 then {name}_same else {name}_near end"})
        self.stats(f"{name}_p", f"{name}_h").then("select * exclude (_bucket, _weekend) from {t}")
        return self.scored(name, soft(f"abs(({column} - {name}_p_med) / {name}_p_sig)", threshold), f"{name}_p_n < 3")

    def mahalanobis(self, name: str, features: list[str], over: str, points: int, threshold: float = 3.5) -> Steps:
        """Distance from medians under the covariance of a window, by elimination."""
        d = len(features)
        value = [f"coalesce(case when isnan(cast({f} as double)) then 0 else cast({f} as double) end, 0)" for f in features]
        self.add(**{f"x{i}": v for i, v in enumerate(value)})
        pairs = {f"c{i}_{j}": f"coalesce(covar_samp(x{i}, x{j}) over ({over}), 0)" + (" + 1e-6" if i == j else "") for i in range(d) for j in range(i, d)}
        self.add(_n=f"count(*) over ({over})", **{f"m{i}": f"coalesce(quantile_cont(x{i}, 0.5) over ({over}), 0)" for i in range(d)}, **pairs)
        self.add(**{f"y{i}": f"x{i} - m{i}" for i in range(d)})
        kept, rest = "* exclude ({})", []
        for k in range(d):  # one feature after another is taken out of the others
            below = range(k + 1, d)
            new = {f"c{i}_{j}": f"c{i}_{j} - c{k}_{i} * c{k}_{j} / c{k}_{k}" for i in below for j in range(i, d)} | {f"y{i}": f"y{i} - c{k}_{i} * y{k} / c{k}_{k}" for i in below}
            rest.append(f"q{k}")
            gone = ", ".join([*new, f"y{k}", *[f"c{k}_{j}" for j in range(k, d)]])
            made = "".join(f", {sql} as {c}" for c, sql in new.items())
            self.then(f"select {kept.format(gone)}, y{k} * y{k} / c{k}_{k} as q{k}{made} from {{t}}")
        distance = f"sqrt(greatest({' + '.join(rest)}, 0))"
        self.scored(name, soft(distance, threshold, 2.5), f"_n < {points}")
        gone = ", ".join([*rest, "_n", *[f"x{i}" for i in range(d)], *[f"m{i}" for i in range(d)]])
        return self.then(f"select * exclude ({gone}) from {{t}}")

    def rule(self, name: str, score: str) -> Steps:
        return self.scored(name, f"greatest(least({score}, 1.0), 0.0)", "false")

    def fused(self, results: list[tuple[str, str]], prefix: str = "") -> Steps:
        """{prefix}score, agreement, confidence and detector of (column, detector) in their order."""
        rest = " * ".join(f"(case when {c}_c then 1.0 else 1 - least(greatest({c}_s * least({WEIGHTS[d]}, 1.5), 0), 0.999) end)" for c, d in results)
        agreement = " + ".join(f"(case when not {c}_c and {c}_s >= 0.5 then 1 else 0 end)" for c, _ in results)
        active = " + ".join(f"(case when {c}_c then 0 else 1 end)" for c, _ in results)
        most = f"greatest({', '.join(f'{c}_s' for c, _ in results)})"
        first = "case " + " ".join(f"when {c}_s = {most} then '{d}'" for c, d in results) + " end"
        return self.add(**{f"{prefix}score": f"round(100 * (1 - {rest}), 2)", f"{prefix}agreement": agreement, f"{prefix}detector": first, f"{prefix}confidence": f"round(least(1.0, ({active}) / 4) * (0.6 + 0.4 * least({agreement}, 3) / 3), 3)"})

    def end(self, select: str) -> str:
        return f"with {', '.join(self._ctes)} {select.format(t=f't{len(self._ctes) - 1}')}"


SEVERITY = "case when {0} >= 85 then 'critical' when {0} >= 70 then 'high' when {0} >= 50 then 'medium' when {0} >= 30 then 'low' else 'info' end"


def _anomaly(kind: str, entity_type: str, entity: str, prefix: str = "") -> str:
    """The columns of an anomaly."""
    score = f"{prefix}score"
    said = f"({kind}) || '|{entity_type}|' || ({entity}) || '|' || strftime(window_start, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
    return f"'anm_' || substr(sha1({said}), 1, 20) as anomaly_id, {kind} as type, '{entity_type}' as entity_type, {entity} as entity, {score} as score, {SEVERITY.format(score)} as severity, {prefix}detector as detector, {prefix}agreement as agreement, window_start"


def _material_latency(p95: str, usual: str) -> str:
    return f"(case when {usual} <= 0 then {p95} >= 400 else ({p95} >= 400 and {p95} >= {usual} * 1.6) or ({p95} >= 250 and {p95} >= {usual} * 3) end)"


def _cube(*scores: str) -> str:
    return "cbrt(" + " * ".join(f"greatest({s}, 1e-6)" for s in scores) + ")"


def analyze_global(source: str, lookback: int = 3 * DAY) -> str:
    """source: metric rows with concentration."""
    z, points, alpha = THRESHOLDS["zscore_threshold"], THRESHOLDS["min_history_points"], THRESHOLDS["ewma_alpha"]
    s = Steps(source)
    s.history({"hr": "requests", "he": "error_rate", "hs": "server_error_rate", "hp": "p95_response_time"}, f"epoch(b.window_start) between epoch(a.window_start) - {lookback} and epoch(a.window_start) - 1")
    for p, h in (("r", "hr"), ("e", "he"), ("v", "hs"), ("p", "hp")):
        s.stats(p, h)
    s.seasonal("sr", "requests", lookback).seasonal("se", "error_rate", lookback).seasonal("sp", "p95_response_time", lookback)
    s.mahalanobis("ma", GLOBAL_FEATURES, f"order by epoch(window_start) range between {lookback} preceding and 1 preceding", 2 * points, z)
    s.add(zt=f"case when sr_c then {z * COLD_START_PENALTY} else {z} end", ct=f"case when sr_c then {5 * COLD_CUSUM_PENALTY} else 5.0 end")
    s.robust_z("up", "r", "requests", "zt", points).robust_z("down", "r", "requests", "zt", points, "down").ewma("ew", "hr", "requests", "zt", alpha, points).cusum("cu", "r", "hr", "requests", "ct", 0.5, points).trend("tr", "hr", "requests", points)
    s.fused([("up", "robust_zscore"), ("ew", "ewma"), ("sr", "seasonal"), ("cu", "cusum"), ("tr", "trend")], "spike_")
    s.fused([("down", "robust_zscore"), ("sr", "seasonal"), ("tr", "trend")], "drop_")
    s.add(usual_r="case when r_n > 0 then r_med else requests end", usual_p="case when p_n > 0 then p_med else p95_response_time end")
    s.add(burst=_cube(soft("requests / greatest(usual_r, 1.0)", 2.2, 4), soft("ip_gini", 0.72, 6), soft("1 - path_entropy", 0.55, 5)))
    s.rule("bu", "burst").fused([("bu", "rule"), ("up", "robust_zscore"), ("ew", "ewma")], "ddos_")
    s.robust_z("eu", "e", "error_rate", z, points).cusum("ec", "e", "he", "error_rate", 4.0, 0.5, points).rule("eb", soft("error_rate", THRESHOLDS["error_rate_threshold"], 2.5))
    s.fused([("eu", "robust_zscore"), ("ec", "cusum"), ("se", "seasonal"), ("eb", "rule")], "err_")
    s.robust_z("pu", "p", "p95_response_time", z, points).ewma("pe", "hp", "p95_response_time", z, alpha, points).rule("pb", soft("p95_response_time / greatest(usual_p, 1.0)", THRESHOLDS["latency_p95_multiplier"], 4))
    s.fused([("pu", "robust_zscore"), ("pe", "ewma"), ("sp", "seasonal"), ("pb", "rule")], "lat_")
    s.add(fo_c="true", fo_s="0.0").fused([("ma", "mahalanobis"), ("fo", "isolation_forest")], "odd_")
    s.add(
        is_spike="spike_score >= 30 and requests > 0 and (not sr_c or tr_s >= 0.5)", is_drop="spike_score < 30 and drop_score >= 30", is_ddos="ddos_score >= 30 and requests > 0 and r_n > 0 and burst >= 0.35",
        is_err=f"err_score >= 30 and server_error_rate >= greatest(v_med + {SERVER_ERROR_DELTA}, {SERVER_ERROR_FLOOR})", is_lat=f"lat_score >= 30 and {_material_latency('p95_response_time', 'usual_p')}",
    )
    s.add(is_odd="odd_score >= 30 and ma_s >= 0.55 and r_n > 0 and not (is_spike or is_drop or is_ddos or is_err or is_lat)")
    kinds = (("spike", "traffic_spike"), ("drop", "traffic_drop"), ("ddos", "ddos_burst"), ("err", "error_spike"), ("lat", "latency_anomaly"), ("odd", "multivariate_anomaly"))
    parts = [f"select {_anomaly(f"'{kind}'", 'global', "'all-traffic'", p + '_')} from {{t}} where is_{p}" for p, kind in kinds]
    return s.end(" union all ".join(parts))


def _deduped(parts: list[str]) -> str:
    return f"select * exclude (_rank) from (select *, row_number() over (partition by anomaly_id order by score desc) as _rank from ({' union all '.join(parts)})) where _rank = 1"


def analyze_endpoints(source: str, lookback: int, min_requests: int, rate_min: int) -> str:
    z, points, alpha = THRESHOLDS["zscore_threshold"], THRESHOLDS["min_history_points"], THRESHOLDS["ewma_alpha"]
    s = Steps(source).add(share="requests / greatest(sum(requests) over (partition by window_start), 1)")
    s.history({"hp": "p95_response_time", "hs": "server_error_rate", "hx": "share"}, f"a.endpoint = b.endpoint and epoch(b.window_start) between epoch(a.window_start) - {lookback} and epoch(a.window_start) - 1", "(epoch(b.window_start), b.method)")
    s.then(f"select * from {{t}} where requests >= {min_requests}")
    for p, h in (("p", "hp"), ("v", "hs"), ("x", "hx")):
        s.stats(p, h)
    s.add(usual_p="case when p_n > 0 then p_med else p95_response_time end", usual_x="case when x_n > 0 then x_med else share end")
    s.robust_z("pu", "p", "p95_response_time", z, points).ewma("pe", "hp", "p95_response_time", z, alpha, points).rule("pb", soft("p95_response_time / greatest(usual_p, 1.0)", THRESHOLDS["latency_p95_multiplier"], 4))
    s.fused([("pu", "robust_zscore"), ("pe", "ewma"), ("pb", "rule")], "late_")
    s.robust_z("vu", "v", "server_error_rate", z, points).cusum("vc", "v", "hs", "server_error_rate", 4.0, 0.5, points).rule("vb", soft("server_error_rate", max(THRESHOLDS["error_rate_threshold"] / 2, 0.02), 2.5))
    s.fused([("vu", "robust_zscore"), ("vc", "cusum"), ("vb", "rule")], "err_")
    s.robust_z("xu", "x", "share", z + 0.5, points).fused([("xu", "robust_zscore")], "odd_")
    keep = {
        "late": ("slow_endpoint", _material_latency("p95_response_time", "usual_p")),
        "err": ("error_spike", f"requests >= {rate_min} and server_error_rate >= {SERVER_ERROR_FLOOR} and server_error_rate >= v_med + {SERVER_ERROR_DELTA}"),
        "odd": ("traffic_spike", f"requests >= {rate_min} and share >= greatest(usual_x * 1.5, usual_x + 0.03)"),
    }
    return s.end(_deduped([f"select {_anomaly(f"'{kind}'", 'endpoint', 'endpoint', p + '_')} from {{t}} where {p}_score >= 30 and {when}" for p, (kind, when) in keep.items()]))


def analyze_ips(source: str, thresholds: dict, top_n: int = 400, scrape_requests: int = 60, min_volume: float = 30.0) -> str:
    """source: ip rows with window_end."""
    t = THRESHOLDS | thresholds
    limit = t["ip_rps_threshold"]
    s = Steps(source).then(f"select * exclude (_r) from (select *, row_number() over (partition by window_start order by requests desc, ip) as _r from {{t}}) where _r <= {top_n}")
    s.mahalanobis("ma", IP_FEATURES, "partition by window_start", 20, t["zscore_threshold"])
    s.add(middle="quantile_cont(requests, 0.5) over (partition by window_start)", own_rps="requests / greatest(epoch(window_end) - epoch(window_start), 1)", fo_c="true", fo_s="0.0").then("select * from {t} where requests >= 5")
    s.add(
        flood=soft("own_rps", limit), scanning=_cube(soft("unique_paths", t["scan_unique_paths"]), soft("not_found_ratio", 0.35), soft("path_entropy", 0.6, 4)),
        failing=soft("auth_fail_count", t["auth_fail_threshold"], 2.5), bulk=f"least(0.95, {soft('requests', 120.0)} * 0.7 + 0.3)",
    )
    models = [("fo", "isolation_forest"), ("ma", "mahalanobis")]
    s.rule("fl", "flood").rule("sc", "scanning").rule("au", "failing").rule("bk", "bulk")
    s.fused([("fl", "rule"), *models], "flood_").fused([("sc", "rule"), *models], "scan_").fused([("au", "rule"), models[0]], "auth_").fused([("bk", "rule"), *models], "bulk_").fused(models, "odd_")
    s.add(
        is_flood="flood >= 0.4 and flood_score >= 30", is_scan="scanning >= 0.35 and scan_score >= 30", is_auth=f"auth_fail_count >= {max(t['auth_fail_threshold'] / 2, 3)} and auth_score >= 30",
        is_bulk=f"requests >= {scrape_requests} and path_entropy <= 0.35 and unique_paths <= 6 and bulk_score >= 30",
    )
    s.add(is_odd=f"not (is_flood or is_scan or is_auth or is_bulk) and requests >= greatest({min_volume}, 3 * middle) and ma_s >= 0.85 and odd_score >= 30")
    kinds = (("flood", f"case when own_rps >= {2 * limit} then 'ddos_burst' else 'suspicious_ip' end"), ("scan", "'endpoint_scan'"), ("auth", "'auth_abuse'"), ("bulk", "'data_scraping'"), ("odd", "'suspicious_ip'"))
    return s.end(" union all ".join(f"select {_anomaly(kind, 'ip', 'ip', p + '_')} from {{t}} where is_{p}" for p, kind in kinds))


def analyze_geo(source: str, lookback: int, min_requests: int) -> str:
    s = Steps(source).add(share="requests / greatest(sum(requests) over (partition by window_start), 1)")
    s.history({"hx": "share"}, f"a.country = b.country and epoch(b.window_start) between epoch(a.window_start) - {lookback} and epoch(a.window_start) - 1")
    s.then(f"select * from {{t}} where requests >= {min_requests}").stats("x", "hx").robust_z("xu", "x", "share", THRESHOLDS["zscore_threshold"] + 0.5, 8)
    new = f"(x_n < 3 and requests >= {3 * min_requests})"
    s.scored("ne", "0.7", f"not {new}").fused([("xu", "robust_zscore"), ("ne", "rule")], "geo_")
    return s.end(f"select {_anomaly("'geo_anomaly'", 'country', 'country', 'geo_')} from {{t}} where geo_score >= 30 and share >= greatest(x_med * 1.5, x_med + 0.01)")


def analyze_sessions(source: str, min_requests: int) -> str:
    """source: sessions with ``_slot``."""
    s = Steps(source).add(window_start="session_start").mahalanobis("ma", SESSION_FEATURES, "partition by _slot", 20)
    s.then(f"select * from {{t}} where requests >= {min_requests}").rule("pa", soft("requests_per_minute", 90.0)).fused([("pa", "rule"), ("ma", "mahalanobis")], "odd_")
    return s.end(f"select {_anomaly("'session_anomaly'", 'session', 'session_id', 'odd_')} from {{t}} where odd_score >= 30")


def rescored(jobs: list[str]) -> str:
    return _deduped([f"select * from ({job})" for job in jobs])
