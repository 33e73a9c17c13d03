"""Secret scans: fixed patterns and a randomness test battery, in DataFrame functions only.

Patterns give the base spans.  The battery looks at other runs of at least ``LEAST_RUN`` code
characters.  From its characters a run's encoding is inferred (hexadecimal, decimal, base 32,
letters, base 36, 62, 64), and it is tested whether the run departs from uniform draws of that
alphabet no more than chance would.  They are equivalence tests: the null hypothesis is a departure
as large as that of ordinary words, so a small p-value is evidence of randomness.

* chi-squared: the symbols' counts against uniform, where words' letters repeat more;
* runs: of the kinds of characters (upper case, lower case, digits, signs), which change in words,
  paths and identifiers less often than ``WORD_CHANGES`` of what random draws do; an alphabet of one
  kind has no such test; and of the alphabet's lower and upper half;
* serial correlation: of neighbouring symbol numbers.

The first two bring evidence and are summed by Stouffer's rule.  Words in a row pass the runs of the
halves and the correlation as well as random draws do, so these bring none: the p-value is 1 if one
of them departs by more than its margin, or if the kinds of characters are dealt as in one of a
thousand random runs at most.  (The largest of all p-values finds few secrets of 32 characters.)

Among the runs of a document the Benjamini-Hochberg rule bounds the share of false discoveries.
Runs with a p-value over ``DISCARD`` are plainly ordinary; they are left out and the others' values
divided by ``DISCARD``, which keeps the bound as ordinary runs' values lean to 1, so that a verdict
doesn't depend on how many ordinary runs stand beside it.  p-values are weighted by length over mean
length, so that longer runs, whose tests say more, get more of it.  Accepted runs that no base span
covers are added as spans of kind "random".

Positions are code points, ends exclusive.  Null text counts as empty and has no spans.  Work grows
with a text's length, and with the square of the number of its spans.  Other columns stay; one that
is called ``spans`` is replaced.  Rows are judged one by one: repeated rows and null ids have their
own spans, an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in their order, the pattern of each and the least length of the group that counts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]{12,})"
HEX = r"()([0-9a-f]{32,})"
BASE = (("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32))
LEAST_RUN = 16
LONG_RUN = rf"()((?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}})"
FALSE_DISCOVERIES = 0.02
#: Share of random draws' changes of kind that ordinary runs may have.
WORD_CHANGES = 0.68
#: Runs with larger p-values don't count among those that are tested together.
DISCARD = 0.5
#: Kinds of characters, and the chi-squared values that one random run in a thousand exceeds, by number of kinds.
UPPER, LOWER, DIGITS, SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_-"
CLASSES = (UPPER, LOWER, DIGITS, SIGNS)
CLASS_LIMITS = (1e9, 10.83, 13.82, 16.27)
#: Alphabets of the inferred encodings, in the order in which they are tried.
ENCODINGS = (
    (r"^[0-9]+$", DIGITS),
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+=*$", UPPER + "234567"),
    (r"^[a-z]+$", LOWER),
    (r"^[a-z0-9]+$", LOWER + DIGITS),
    (r"^[A-Z0-9]+$", UPPER + DIGITS),
    (r"^[A-Za-z]+$", UPPER + LOWER),
    (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    (r"^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    (r"", UPPER + LOWER + DIGITS + "-_"),
)

_SPAN = "array<struct<start:int,kind_no:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: an element of a one-element array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _located(text: Column, pattern: str, kind_no: int, least: int) -> Column:
    """Spans of a pattern's leftmost matches whose second group has the least length.

    What lies between matches comes from splitting by the same pattern, so positions are sums of lengths.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), 2))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.coalesce(F.length(x["1"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["2"]) >= least, F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))
    spans = F.aggregate(parts, start, add, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _normal(z: Column) -> Column:
    """Standard normal distribution function, to about 1e-4."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _encoding(alphabet: str) -> Column:
    """What the tests have to know of an alphabet."""
    shares = [sum(c in kind for c in alphabet) / len(alphabet) for kind in CLASSES]
    kinds = sum(share > 0 for share in shares)
    return F.struct(
        F.lit(alphabet).alias("symbols"), F.lit(float(len(alphabet))).alias("size"), *[F.lit(share).alias(f"share{i}") for i, share in enumerate(shares)],
        F.lit(CLASS_LIMITS[kinds - 1]).alias("limit"), F.lit(1 - sum(share * share for share in shares)).alias("changing"),
    )


def randomness(run: Column) -> Column:
    """p-value of the battery: the chance that a run that departs from uniform as words do looks so even."""

    def battery(s: Column) -> Column:
        x, size, n, body = s["x"], s["encoding"]["size"], F.size(s["x"]).cast("double"), s["body"]
        neighbours = lambda of: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), of)
        # symbol counts against uniform; words' letters have a match probability of about 0.06
        number = lambda c: (n - F.length(F.replace(body, c, F.lit("")))).cast("double")
        squares = F.aggregate(F.split(s["encoding"]["symbols"], ""), F.lit(0.0), lambda acc, c: acc + number(c) * number(c))
        free, away = size - 1, n * F.greatest(F.lit(0.5), 0.06 * size - 1)
        z_counts = (size / n * squares - n - free - away) / F.sqrt(2 * (free + 2 * away))
        # kinds of characters: runs of them, and their shares
        kinds = F.translate(body, "".join(CLASSES), "".join(str(i) * len(c) for i, c in enumerate(CLASSES)))
        changes = sum(F.regexp_count(kinds, F.lit(f"{i}+")) for i in range(len(CLASSES))) - 1
        usual = WORD_CHANGES * s["encoding"]["changing"]
        z_kinds = (usual - changes / (n - 1)) * F.sqrt((n - 1) / (usual * (1 - usual)))
        uneven = F.lit(0.0)
        for i in range(len(CLASSES)):
            expected = n * s["encoding"][f"share{i}"]
            uneven += F.when(expected > 0, F.pow(F.regexp_count(kinds, F.lit(str(i))) - expected, F.lit(2.0)) / expected).otherwise(0.0)
        # runs of the alphabet's halves
        upper = lambda v: v * 2 > size
        above = F.size(F.filter(x, upper)).cast("double")
        below = n - above
        expected = 1 + 2 * above * below / n
        spread = F.sqrt(F.greatest(2 * above * below * (2 * above * below - n) / (n * n * (n - 1)), F.lit(1e-9)))
        runs = 1 + F.size(F.filter(neighbours(lambda a, b: upper(a) != upper(b)), lambda changed: changed))
        p_halves = F.when((above == 0) | (below == 0), 1.0).otherwise(_normal((F.abs(runs - expected) - 0.5 * expected) / spread))
        # neighbours' correlation
        plus = lambda a, b: a + b
        mean = F.aggregate(x, F.lit(0.0), plus) / n
        p_serial = _let(mean, lambda m: _let(
            F.aggregate(F.transform(x, lambda v: (v - m) * (v - m)), F.lit(0.0), plus),
            lambda total: F.when(total == 0, 1.0).otherwise(_normal((F.abs(F.aggregate(neighbours(lambda a, b: (a - m) * (b - m)), F.lit(0.0), plus) / F.greatest(total, F.lit(1e-9))) - 0.5) * F.sqrt(n))),
        ))
        z = F.when(s["encoding"]["changing"] > 0, (z_counts + z_kinds) / math.sqrt(2)).otherwise(z_counts)
        return F.when((p_halves > 0.5) | (p_serial > 0.5) | (uneven > s["encoding"]["limit"]), 1.0).otherwise(_normal(z))

    def numbered(s: Column) -> Column:
        x = F.transform(F.split(s["body"], ""), lambda c: F.instr(s["encoding"]["symbols"], c))
        return F.struct(x.alias("x"), s["body"].alias("body"), s["encoding"].alias("encoding"))

    def known(r: Column) -> Column:
        encoding = F.coalesce(*[F.when(r.rlike(p), _encoding(a)) for p, a in ENCODINGS])
        return F.struct(F.regexp_replace(r, "=+$", "").alias("body"), encoding.alias("encoding"))

    return _let(_let(run, known), lambda s: F.when(F.length(s["body"]) < 3, 1.0).otherwise(_let(numbered(s), battery)))


def _accepted(text: Column, base: Column) -> Column:
    """Spans of long runs that the battery takes for random and no base span covers."""
    free = F.filter(_located(text, LONG_RUN, KINDS.index("random"), LEAST_RUN), lambda s: ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    tested = F.transform(
        free,
        lambda s: F.struct(randomness(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("p"), (s["end"] - s["start"]).cast("double").alias("n"), s.alias("span")),
    )

    def discover(t: Column) -> Column:
        mean = F.aggregate(t, F.lit(0.0), lambda acc, x: acc + x["n"]) / F.size(t)
        weighted = _let(mean, lambda m: F.array_sort(F.transform(t, lambda x: F.struct((x["p"] / DISCARD * m / x["n"]).alias("q"), x["span"].alias("span")))))

        def below(w: Column) -> Column:
            passing = F.filter(F.transform(w, lambda x, i: F.when(x["q"] <= (i + 1) * F.lit(FALSE_DISCOVERIES) / F.size(w), x["q"])), lambda q: q.isNotNull())
            return _let(F.coalesce(F.array_max(passing), F.lit(-1.0)), lambda most: F.transform(F.filter(w, lambda x: x["q"] <= most), lambda x: x["span"]))

        return _let(weighted, below)

    none = F.array().cast(_SPAN)
    return F.when(text.rlike(LONG_RUN), _let(F.filter(tested, lambda x: x["p"] <= DISCARD), lambda t: F.when(F.size(t) > 0, discover(t)).otherwise(none))).otherwise(none)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind_no, end), sorted; kinds are numbered as in ``KINDS``."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = F.concat(*[_located(whole, pattern, KINDS.index(kind), least) for kind, pattern, least in BASE])
    return docs.withColumn("spans", _let(base, lambda b: F.array_sort(F.concat(b, _accepted(whole, b)))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def number(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind_no"] == KINDS.index(kind)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans are one.

    A column ``spans`` is lost; null text stays null."""
    whole = F.col(text)

    def join(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] < F.coalesce(last["end"], F.lit(-1))), longer).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))))

    def rebuilt(merged: Column) -> Column:
        """What lies between spans, joined by the mark."""
        before = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at(merged, i)["end"])
        parts = F.transform(merged, lambda s, i: F.substring(whole, before(i) + 1, s["start"] - before(i)))
        rest = F.substring(whole, F.element_at(merged, -1)["end"] + 1, F.length(whole))
        return F.array_join(F.concat(parts, F.array(rest)), mark)

    merged = F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), join)
    return scan(docs, text).withColumn(text, F.when(F.size("spans") > 0, _let(merged, rebuilt)).otherwise(whole)).drop("spans")
