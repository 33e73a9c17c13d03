"""Benchmark decontamination by winnowed fingerprints.

Words are lower-cased (A-Z) runs of ASCII letters and digits and of anything beyond ASCII.  A window
is ``SPAN`` consecutive words of a benchmark item; an item of fewer words is one window of its own
length.  Words of a document that lie inside any occurrence of a window are hit.

1. Winnowing: of every ``SPAN - GRAM + 1`` neighbouring hashes of ``GRAM`` words the smallest is kept as a
   fingerprint, in documents as in items.  A span of ``SPAN`` words that both share has the same smallest
   hash on both sides, so none is missed.  An item shorter than ``SPAN`` has its whole length as its gram, and
   winnowing's window is then one hash, so that every gram of that length is kept.
2. One pass over the texts holds the fingerprints of documents against a map of the items' fingerprints.  Each
   hit is extended to the windows around it that have this fingerprint; a second map, of windows,
   keeps most of what the items don't have.  Maps have ``MAP_BITS_EACH`` bits a key up to ``MAP_BITS``; a fuller map only
   lets more through.  Texts are not shuffled.
3. What is left joins the items' windows on (fingerprint, window), both of 64 bits over hashes of words;
   neither side's pairs are multiplied: windows that occur in the same items carry one number of that set of items, and
   documents of the same sets share one digest.

Null and empty texts have no words.  Repeated rows of a document come out each; rows that repeat an
item_id are one item of several texts; an item without id hits words but is not counted or listed.  A text of any length is one
row of one task; columns other than the ids and texts are left out, whatever they are called; an
empty benchmark hits nothing, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import checkpoint

SPAN, GRAM = 10, 5
#: Bits of a map for each key, and of a map at most (16 MB).
MAP_BITS_EACH, MAP_BITS = 64, 1 << 27
#: A hot window or set of items is spread over so many keys.
SALTS = 16
#: Rows whose words are held in one array.
TEXTS = 128

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P[2]
    x = (x ^ (x >> np.uint64(29))) * _P[3]
    return x ^ (x >> np.uint64(32))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def hashed(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one text behind the other, and the number of words of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.fromiter((h for t in texts for h in map(xxhash.xxh3_64_intdigest, t)), np.uint64, int(size.sum())), size


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on, as far as there are so many."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _P[0]
        out ^= out >> np.uint64(32)
    return _mix(out)


def least(g: np.ndarray, n: int) -> np.ndarray:
    """The smallest of ``n`` neighbouring hashes: the fingerprint of a window."""
    out = g[: max(0, len(g) - n + 1)].copy()
    for i in range(1, n):
        np.minimum(out, g[i : len(g) - n + 1 + i], out=out)
    return out


def windows(h: np.ndarray, size: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the windows of ``span`` words that lie in one text, fingerprint of each)."""
    gram = GRAM if span == SPAN else span
    end = np.repeat(np.cumsum(size), size)
    starts = np.flatnonzero(np.arange(len(h)) + span <= end)
    return starts, least(grams(h, gram), span - gram + 1)[starts]


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys * _P[1]) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _item_windows(items: DataFrame) -> DataFrame:
    """(item_id, span, finger, window) of every distinct window of each item."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [words(t) for t in batch["text"]]
            for at, one in enumerate(found):
                h, size = hashed([one])
                span = min(SPAN, len(one))
                if span:
                    starts, finger = windows(h, size, span)
                    out = pd.DataFrame({"span": np.int32(span), "finger": finger.view(np.int64), "window": grams(h, span)[starts].view(np.int64)}).drop_duplicates()
                    yield out.assign(item_id=batch["item_id"].iloc[at])[["item_id", "span", "finger", "window"]]

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return rows.mapInPandas(cut, "item_id string, span int, finger bigint, window bigint").distinct()


def _map_of(keys: DataFrame, n: int) -> np.ndarray:
    """A bitmap in which each of the ``n`` long keys of the only column sets a bit; merged by page before the driver has it."""
    bits = max(1 << 16, min(MAP_BITS, 1 << (n * MAP_BITS_EACH).bit_length()))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = _slot(batch.iloc[:, 0].to_numpy().view(np.uint64), bits)
            yield pd.DataFrame({"at": slot >> 6, "bit": (np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64)})

    merged = keys.mapInPandas(mark, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[merged["at"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return out


def _marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = _slot(keys, len(marks) << 6)
    return (marks[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def _hits(docs: DataFrame, marks: dict[int, tuple]) -> DataFrame:
    """``doc_id``, ``n_words`` and ``hits`` of each row of docs: (start, span, finger, window) of the
    windows that pass the maps of their length."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), TEXTS):
                part = batch.iloc[low : low + TEXTS]
                h, size = hashed([words(t) for t in part["text"]])
                first = np.cumsum(size) - size
                hits: list[list[dict]] = [[] for _ in range(len(part))]
                for span, (fingers, extended) in marks.items():
                    starts, finger = windows(h, size, span)
                    # neighbouring windows mostly share their fingerprint: each run of equal ones is looked up once
                    new = np.ones(len(finger), bool)
                    new[1:] = finger[1:] != finger[:-1]
                    known = _marked(fingers.value, finger[new])[np.cumsum(new) - 1]
                    starts, finger = starts[known], finger[known]
                    if not len(starts):
                        continue
                    window = grams(h[(starts[:, None] + np.arange(span)).ravel()], span)[::span]
                    kept = _marked(extended.value, window)
                    row = np.searchsorted(first, starts[kept], side="right") - 1
                    for r, s, f, w in zip(row.tolist(), (starts[kept] - first[row]).tolist(), finger[kept].view(np.int64).tolist(), window[kept].view(np.int64).tolist(), strict=True):
                        hits[r].append({"start": s, "span": span, "finger": f, "window": w})
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_words": size, "hits": hits})

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(scan, f"doc_id {kind}, n_words bigint, hits array<struct<start: bigint, span: int, finger: bigint, window: bigint>>")


def hit_spans(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: the rows of ``docs`` as (row, doc_id, n_words); spans of words that an item holds as (row,
    start, span, set_id); and (set_id, item_id), the items in which the words of such a span occur."""
    spark = docs.sparkSession
    cut = checkpoint(_item_windows(items))
    # the set of items that a window occurs in, by number and two sums of hashes; items are not gathered
    same = [F.count("item_id"), F.bit_xor(F.xxhash64("item_id")), F.bit_xor(F.xxhash64(F.lit(1), "item_id"))]
    places = checkpoint(cut.groupBy("span", "finger", "window").agg(F.xxhash64(*[F.coalesce(x, F.lit(0)) for x in same]).alias("set_id")))
    marks = {}
    for span, n in places.groupBy("span").count().orderBy("span").collect():  # at most SPAN rows
        these = places.filter(F.col("span") == span)
        marks[span] = tuple(spark.sparkContext.broadcast(_map_of(these.select(key).distinct(), n)) for key in ("finger", "window"))
    every = checkpoint(_hits(docs, marks).withColumn("row", F.monotonically_increasing_id()))

    key = ["span", "finger", "window"]
    found = every.select("row", F.explode("hits").alias("h")).select("row", "h.*").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    spread = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    spans = found.join(spread, [*key, "salt"]).select("row", "start", "span", "set_id")
    # the items of a set are those of any of its windows
    one = places.groupBy("set_id").agg(F.min(F.struct(*key)).alias("w")).select("set_id", "w.*")
    sets = cut.join(one, key).filter("item_id is not null").select("set_id", "item_id")
    return every.select("row", "doc_id", "n_words"), spans, sets


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of ``docs``."""
    every, spans, sets = hit_spans(docs, items)
    spans = checkpoint(spans)
    end = F.col("start") + F.col("span")
    before = F.max(end).over(Window.partitionBy("row").orderBy("start", "span").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(end - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    hit = spans.select("row", "set_id", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("set_id")).alias("sets"))
    hit = checkpoint(hit.withColumn("class_id", F.sha2(F.concat_ws(",", F.col("sets").cast("array<string>")), 256)))

    classes = hit.groupBy("class_id").agg(F.first("sets").alias("sets")).select("class_id", F.explode("sets").alias("set_id"))
    listed = F.array_sort(F.collect_set("item_id"))
    digests = classes.join(sets, "set_id").groupBy("class_id").agg(listed.alias("items")).select("class_id", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    spread = digests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    hit = hit.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(spread, ["class_id", "salt"], "left")
    out = every.join(hit.select("row", "n_hit", "n_items", "items_sha256"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
