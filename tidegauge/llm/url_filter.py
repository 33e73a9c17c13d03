"""URL filters: rules, and trust propagated over the link graph of hosts, in DataFrame functions only.

A rule names a host, with all its subdomains, and the beginning of a path; the longest fitting rule
decides.  Where none fits, the host's standing does.  Pages that rules allow seed trust on their
hosts, blocked pages seed distrust; personalised PageRank carries trust along links (good hosts link
to good ones) and distrust against them (who links to bad hosts is bad).  A host is blocked if its
share of distrust is above a threshold.  Walks go on until, over ``ROUND`` steps, no host is newly
reached and no host's share of distrust moves by more than ``TOLERANCE``; after ``STEPS`` steps at
the latest, when less than a millionth of the weight still moves.

Edges between hosts are summed from all links of all pages before anything else moves; links within
a host don't count.  A walk that ends at a host without links starts again at the seeds, which is
what dividing by the total does.  Hosts are joined by name: one with a large part of all pages has
its pages split over tasks by the adaptive skew join, and is one row in the walks.  Repeated rows
count as often as they are there, null page ids are kept, other columns are left out; urls and
pages of any length are read whole, an empty table gives no rows.  Null urls, and those without ``://``, have an empty host and path
and no links; pages of hosts that no walk reaches are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import checkpoint

#: (rule, verdict); a rule is a host and the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING, STEPS, THRESHOLD = 0.85, 90, 0.5
ROUND, TOLERANCE = 10, 1e-3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i:href|src)\s*=\s*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/"'?#\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, or null."""
    tests = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = rule.partition("/")
        tests.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + start), F.lit(rule)))
    return F.coalesce(*tests, F.lit(None).cast("string")) if tests else F.lit(None).cast("string")


def rule_verdict(rule: Column, rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, summed over pages of host and html."""
    links = pages.filter("host <> '' and html is not null").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst")).filter("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("links"))


def _share() -> Column:
    return F.coalesce(F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust")), F.lit(0.0))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of every host that a walk reaches; each of the two adds to 1.

    seeds: host, trust, distrust, any non-negative weights.
    """
    total = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))  # one row
    start = seeds.crossJoin(F.broadcast(total)).select("host", F.coalesce(F.try_divide(F.col("trust"), F.col("t")), F.lit(0.0)).alias("trust"), F.coalesce(F.try_divide(F.col("distrust"), F.col("d")), F.lit(0.0)).alias("distrust"))
    out_links = edges.groupBy("src").agg(F.sum("links").alias("of"))
    in_links = edges.groupBy("dst").agg(F.sum("links").alias("of"))
    # one table of steps for both walks: trust from src to dst, distrust from dst to src
    forth = edges.join(out_links, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("links") / F.col("of")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(in_links, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("links") / F.col("of")).alias("d"))
    moves = checkpoint(forth.union(back))
    if moves.isEmpty():
        return start
    start = checkpoint(start)
    mass = before = start
    for step in range(1, steps + 1):
        carried = mass.join(moves, "host").select(F.col("to").alias("host"), (F.col("trust") * F.col("t") * damping).alias("trust"), (F.col("distrust") * F.col("d") * damping).alias("distrust"))
        seeded = start.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
        mass = seeded.union(carried).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if step % ROUND == 0:
            mass = checkpoint(mass)
            moved = mass.join(before.select("host", _share().alias("_was")), "host", "left").agg(F.max(F.abs(_share() - F.coalesce("_was", F.lit(2.0))))).first()[0]
            if moved is None or moved <= tolerance:
                break
            before = mass
    total = mass.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
    return mass.crossJoin(F.broadcast(total)).select("host", F.coalesce(F.try_divide(F.col("trust"), F.col("t")), F.lit(0.0)).alias("trust"), F.coalesce(F.try_divide(F.col("distrust"), F.col("d")), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's trust and distrust of each page."""
    host, path = host_and_path(F.col("url").cast("string"))
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    ruled = named.select("page_id", "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule")).withColumn("_said", rule_verdict(F.col("rule"), rules))
    seeds = ruled.filter("host <> ''").groupBy("host").agg(F.count_if(F.col("_said") == "allow").cast("double").alias("trust"), F.count_if(F.col("_said") == "block").cast("double").alias("distrust")).filter("trust + distrust > 0")
    standing = propagate(seeds, host_edges(named.select("host", "html")))
    out = ruled.join(standing, "host", "left").select("page_id", "host", "path", "rule", "_said", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    share = F.round(_share(), 9)
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(share > threshold, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")
