"""Document fingerprints by I-Match with randomised lexicons.

Terms are the blank-separated words of the lower-cased text.  The lexicon keeps terms whose inverse
document frequency lies in a band: words of nearly every document say nothing, words of a single
one are slips or noise.  Document frequencies are counted over the distinct texts of the whole corpus,
so that copies of one text don't make its words common, in a table of ``2**BITS`` hashed terms, so
that what is gathered and broadcast is bounded by a parameter.  Terms that share a slot are counted
together: with far more than ``2**BITS`` distinct terms, terms of a single text stay in the lexicon.

A fingerprint hashes the sorted distinct terms of a text that fall into each of ``SUBSETS`` random
subsets of the lexicon: a polynomial of the terms in their order, of which 16 bits are kept.  A
subset keeps a term with a probability of ``2**-level``.  Levels are even; every fingerprint holds
the two neighbouring ones at which a few of its terms fall into each subset, so that texts up to
four times as long as each other share one.  Two texts' likeness is read from the share of subsets
on which they agree: texts that differ in d terms agree on a subset with probability
``(1 - 2**-level)**d``, which gives d (of two levels, by the inverse of its variance), and with the
two counts of terms the Jaccard similarity of their terms.  Without a shared level it is 0.

A text with less than ``LEAST_SHARE`` of its distinct terms in the band, as in a large group of near
copies, would be told by its odd words alone; it is fingerprinted by all its distinct terms, in the
same subsets.  Between a text on either side of that share the likeness comes out too low.

Other columns than ``doc_id`` and ``text`` are left out of the comparison; ``add_fingerprint`` keeps
them and replaces one of its output's name.  Rows that repeat an id are documents like any other,
ties by text; a table of one row is followed by itself, an empty table gives no rows.  A text is
held whole by one task.

Null text counts as empty.  A text without any term is fingerprinted by the hash of all its
characters and is like equal texts only.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import fields, h64

BITS = 20
SUBSETS = 32
#: The band: terms of at least so many documents, and of at most this share of them.
LEAST_DOCS, MOST_SHARE = 2, 0.2
#: Texts with less of their distinct terms in the band are fingerprinted by all of them.
LEAST_SHARE = 1 / 3
#: Slots of text hashes, by which copies are looked for: what is gathered is at most a number for each.
TEXT_SLOTS = 1 << 22
#: About so many terms of a text fall into a subset, at the lower of its two levels at most four times as many.
TERMS_A_SUBSET = 1.5
SEGMENTS = 64
#: Words whose hashes are remembered: those of a document and its neighbours, few enough to stay in a core's cache.
_MEMO_SIZE = 16_000
#: ASCII blanks of str.split that bytes.split doesn't know.
_BLANKS = bytes.maketrans(b"\x1c\x1d\x1e\x1f", b"    ")
_WIDE_BLANKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_memo: dict[bytes, int] = {}


def terms(text: str) -> np.ndarray:
    """Hashes (``h64``) of the distinct terms."""
    if len(_memo) > _MEMO_SIZE:
        _memo.clear()
    low = text.lower()
    if not low.isascii() and _WIDE_BLANKS.search(low):
        low = " ".join(low.split())
    words = set(low.encode("utf-8", "surrogatepass").translate(_BLANKS).split())
    new = words.difference(_memo)
    _memo.update(zip(new, map(xxhash.xxh3_64_intdigest, new), strict=True))
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def distinct_texts(docs: DataFrame, text: str = "text", slots: int = TEXT_SLOTS) -> DataFrame:
    """Each text once.

    A text whose hash falls alone into its slot has no copy and stays where it is; only the others are moved.
    """
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).withColumn("_slot", F.pmod(F.xxhash64(text), F.lit(slots)).cast("int"))
    taken = np.zeros(slots, bool)
    taken[rows.groupBy("_slot").count().filter("count > 1").select("_slot").toArrow()["_slot"].to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(taken))

    @F.pandas_udf(T.BooleanType())
    def alone(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            k = s.to_numpy()
            yield pd.Series((shared.value[k >> 3] >> (7 - (k & 7)) & 1) == 0)

    return rows.filter(alone("_slot")).select(text).unionByName(rows.filter(~alone("_slot")).select(text).distinct())


def document_frequency(docs: DataFrame, text: str = "text", bits: int = BITS) -> tuple[np.ndarray, int]:
    """Number of documents by hashed term, and of all documents.

    Each task adds up its documents in one array; arrays are summed by segment.
    """
    size = (1 << bits) // SEGMENTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, n = np.zeros(1 << bits, np.int32), 0
        for batch in batches:
            for t in batch["_text"]:
                table[np.unique(terms(t) >> np.uint64(64 - bits)).astype(np.int64)] += 1
            n += len(batch)
        if n:
            yield pd.DataFrame({"segment": range(SEGMENTS), "counts": [table[i * size : (i + 1) * size].tobytes() for i in range(SEGMENTS)], "n": n})

    def add(keys: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(size, np.int64), 0
        for part in parts:
            for c, k in zip(part["counts"], part["n"], strict=True):
                total += np.frombuffer(c, np.int32)
                n += k
        yield pd.DataFrame({"segment": [keys[0]], "counts": [total.tobytes()], "n": [n]})

    whole = lambda keys, pdf: next(add(keys, iter([pdf])))
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).mapInPandas(count, "segment int, counts binary, n bigint")
    found = rows.groupBy("segment").applyInPandas(whole, "segment int, counts binary, n bigint").collect()
    table = np.zeros(1 << bits, np.int64)
    for r in found:
        table[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["counts"], np.int64)
    return table, found[0]["n"] if found else 0


def band(frequency: np.ndarray, n: int, least: int = LEAST_DOCS, most: float = MOST_SHARE) -> np.ndarray:
    """Which hashed terms are in the lexicon: log(n / frequency) is from -log(most) to log(n / least)."""
    return (frequency >= least) & (frequency <= most * n)


_SEEDS = np.array([h64(str(i).encode(), 77) | 1 for i in range(64)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, _BASE))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _subset_bits(t: np.ndarray, level: int, above: int = 0) -> np.ndarray:
    """For each term a word whose bit k says whether subset k keeps it: bits are on with chance 2**-level.

    With ``above``, only the draws after the first so many, to be joined to the bits of that level."""
    kept, high = np.full(len(t), ~np.uint64(0)), t ^ (t >> np.uint64(29))
    for i in range(above, level):
        x = high * _SEEDS[i]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(31)
        kept &= x
    return kept


def lower_level(terms_held: int) -> int:
    """The denser of a fingerprint's two levels."""
    return 2 * max(0, math.floor(math.log2(terms_held / TERMS_A_SUBSET) / 2))


def _subset_hashes(found: np.ndarray, kept: np.ndarray, subsets: int) -> list[str]:
    """Four hexadecimal digits for each subset of the sorted terms, dashes for an empty one; a text for each column of ``kept``."""
    columns = kept.shape[1]
    on = np.unpackbits(kept.astype("<u8").view(np.uint8), axis=1, bitorder="little").reshape(len(found), columns, 64)[:, :, :subsets].reshape(len(found), -1)
    subset, term = np.divmod(np.flatnonzero(np.ascontiguousarray(on.T).view(bool)), max(1, len(found)))  # by subset, its terms in their order
    counts = np.bincount(subset, minlength=columns * subsets)
    starts, some = np.cumsum(counts) - counts, counts > 0
    sums = np.zeros(columns * subsets, np.uint64)
    if len(term):
        # the sum of each mixed hash times a power of the base by its place
        most = int(counts.max())
        powers = _POWERS if most < len(_POWERS) else np.cumprod(np.full(most + 1, _BASE))
        sums[some] = np.add.reduceat(_mix(found)[term] * powers[np.arange(1, len(term) + 1) - starts[subset]], starts[some])
    digits = (_mix(sums) & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()
    if not some.all():
        digits = "".join([digits[4 * k : 4 * k + 4] if x else "----" for k, x in enumerate(some.tolist())])
    return [digits[4 * subsets * i : 4 * subsets * (i + 1)] for i in range(columns)]


def fingerprint(text: str, lexicon: np.ndarray, bits: int = BITS, subsets: int = SUBSETS) -> str:
    """``count:level:hashes:hashes``, four hexadecimal digits a subset; ``text:hash`` without terms."""
    found = terms(text)
    banded = found[lexicon[(found >> np.uint64(64 - bits)).astype(np.int64)]]
    found = np.sort(found if len(banded) < LEAST_SHARE * len(found) else banded)
    if not len(found):
        return "text:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:32]
    level = lower_level(len(found))
    kept = _subset_bits(found, level) & np.uint64((1 << subsets) - 1)
    chosen = np.flatnonzero(kept)  # at higher levels most terms are in no subset
    held, kept = found[chosen], kept[chosen]
    out = _subset_hashes(held, np.stack([kept, kept & _subset_bits(held, level + 2, level)], axis=1), subsets)
    return f"{len(found)}:{level}:{out[0]}:{out[1]}"


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints' terms."""
    if a == b:
        return 1.0
    if a.startswith("text:") or b.startswith("text:"):
        return 0.0
    (m, i, *x), (n, j, *y) = a.split(":"), b.split(":")
    m, n, i, j = int(m), int(n), int(i), int(j)
    whole = weight = 0.0
    for level in {i, i + 2} & {j, j + 2}:
        p, q = x[(level - i) // 2], y[(level - j) // 2]
        pairs = [(p[k : k + 4], q[k : k + 4]) for k in range(0, len(p), 4)]
        agreed = sum(s == t for s, t in pairs) / len(pairs)
        if level and agreed:
            rate = 2.0**-level
            sure = agreed * rate * rate / (1 - agreed + 1 / len(pairs))  # the inverse of the variance, but for a factor
            whole += sure * math.log(agreed) / math.log1p(-rate)
            weight += sure
    if not weight:
        return 0.0
    d = max(whole / weight, abs(m - n))
    return min(1.0, max(0.0, (m + n - d) / (m + n + d)))


def lexicon_of(docs: DataFrame, text: str = "text", bits: int = BITS) -> np.ndarray:
    return band(*document_frequency(distinct_texts(docs, text), text, bits))


def add_fingerprint(docs: DataFrame, lexicon: np.ndarray, text: str = "text", out: str = "fingerprint", bits: int = BITS) -> DataFrame:
    """``docs`` with the fingerprint of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(lexicon))

    @F.pandas_udf(T.StringType())
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = np.unpackbits(shared.value, count=1 << bits).astype(bool)
        for texts in batches:
            yield texts.map(lambda t: fingerprint(t, known, bits))

    return docs.withColumn(out, made(F.coalesce(F.col(text).cast("string"), F.lit(""))))


# -- the edit experiment: every text against its edited form and the next document ------------------

EDITED = fields("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
_FIRST = -(1 << 63)


def compare_edited(docs: DataFrame, lexicon: np.ndarray, bits: int = BITS) -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last quarter is replaced by the
    beginning of the next document; and the likeness to both.

    Documents are ordered by doc_id (null: first), ties by text.  The order is made by ranges of
    ids, split where a sample of ids says; every range also gets the first id's rows of the range
    after it (the last: of the first), so that each has the documents that follow its own.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_FIRST)).alias("_k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # one number for each range: split points, then the first id of each range
    cuts = sorted(set(rows.agg(F.percentile_approx("_k", [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []))
    place = F.lit(0)
    if cuts:
        place = F.coalesce(F.array_position(F.transform(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("_k")), F.lit(True)), F.lit(0)).cast("int")
        place = F.when(place == 0, len(cuts)).otherwise(place - 1)
    rows = rows.withColumn("_range", place)
    firsts = sorted((r["_range"], r["first"]) for r in rows.select("_k", "_range").groupBy("_range").agg(F.min("_k").alias("first")).collect())
    if not firsts:
        firsts = [(0, _FIRST)]
    also = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    halo = F.create_map(*[F.lit(x) for pair in also.items() for x in pair])[F.col("_k")]
    spread = rows.withColumn("_to", F.when(halo.isNull(), F.array("_range")).otherwise(F.array("_range", halo)))
    spread = spread.select("doc_id", "_k", "text", F.posexplode("_to").alias("_halo", "_to"))
    ordered = spread.repartition(parts, "_to").sortWithinPartitions("_to", "_halo", "_k", "text")
    shared = spark.sparkContext.broadcast(np.packbits(lexicon))
    schema = T.StructType([*fields("doc_id string"), *EDITED])  # as text: pandas turns whole numbers beside nulls into doubles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(shared.value, count=1 << bits).astype(bool)
        held: tuple | None = None  # the document whose next one is awaited: range, id, text, fingerprint

        def finish(doc_id, text: str, own: str, next_text: str, next_own: str) -> tuple:
            quarter = len(text) // 4
            edited = text[: len(text) - quarter] + next_text[:quarter] if quarter else text
            changed = fingerprint(edited, known, bits) if edited != text else own
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_own)

        for batch in batches:
            out = []
            for doc_id, to, is_halo, text in zip(batch["doc_id"].tolist(), batch["_to"].tolist(), batch["_halo"].tolist(), batch["text"].tolist(), strict=True):
                if is_halo and (held is None or held[0] != to):
                    continue  # the awaited document has met its next one
                own = fingerprint(text, known, bits)
                if held is not None and held[0] == to:
                    out.append(finish(*held[1:], text, own))
                held = None if is_halo else (to, doc_id, text, own)
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    return ordered.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
