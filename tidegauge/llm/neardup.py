"""MinHash near-duplicate detection with odd sketches.

Words are lower-cased (A-Z) runs without ASCII blanks; a document's set holds its distinct shingles
of five words (all its words as one, if it has fewer; nothing, without words).  Documents are
linked if the Jaccard similarity of their sets is at least 0.75; components of links are found.

1. One pass over the texts makes, for each document, the set's size, a 128-bit fingerprint of the
   set, MinHash samples of which 128 are folded into 32 band keys of four (a pair at 0.75 shares no
   key with probability 5e-6), and an odd sketch: a bitmap of 2048 bits in which each sample flips
   one.  The sketch of a set of more than ``WHOLE`` shingles folds 256 MinHash samples; a smaller
   set is its own sample, so nothing is lost to sampling.  Sets of equal fingerprint are one class;
   only its smallest document goes on, so copies cost a row each and no pairs.
2. Candidates come from documents that share a band key, never as all pairs of a bucket.  A bucket
   is dealt into groups of bounded size, each with the bucket's smallest document.  In a group the
   first document leads: the odd sketches of the others are held against its own by the population
   count of their XOR, those that look alike are paired with it and leave, and the first of the rest
   leads next, ``LEADERS`` times at most.  Pairs of an estimate below the floor go (a linked pair
   falls below it with a probability of about 1e-7), all others are confirmed on their full sets.
   Two sketches of different kinds aren't compared; such pairs are confirmed.  Links are contracted
   to components.
3. Only buckets that still hold several components can hide a link that matters.  The others
   than a bucket's largest component are dealt into tiles of bounded size,
   which meet each other and the main component's parts, never those parts each other: the work is
   (members outside the main component) x (members).  Sketches of different components are compared
   there, every pair that looks alike and hasn't been tried is confirmed.  Where a meeting finds
   more than ``PAIRS_A_ROW`` pairs a row, each row reports its likeliest partners only, since one link
   makes the other pairs of two components needless, and a last round reports all that remain.

Null text counts as empty.  Documents without words have no set and are linked with nothing.  Rows
that repeat a doc_id stand for one document, that of the smallest text; each row comes out with its
own set size.  Rows with a null doc_id take no part in linking and come out with a null component.
Columns other than ``doc_id`` and ``text`` are left out, whatever they are called; a text of any
length is one row of one task; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import checkpoint, fields

WORDS = 5
BANDS, ROWS, SAMPLES, SKETCH_BITS = 32, 4, 256, 2048
#: Sets of at most so many shingles are folded into their sketch whole.
WHOLE = 1024
#: Estimated similarity below which a candidate is not confirmed on full sets, of whole and of sampled sets.
FLOOR, SAMPLED_FLOOR = 0.72, 0.6
#: Bits of the map of documents whose texts are read again; beyond as many documents it only filters less.
MAP_BITS = 1 << 24
TILE = 256
#: Leaders of a group; what has met none that looks alike waits for the round after.
LEADERS = 12
PAIRS_A_ROW = 4
#: Tables of ids hold a few bytes a row: they take one partition where whole texts take so many.
THINNER = 8

_rng = np.random.Generator(np.random.PCG64(20240229))
_A = (_rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, SAMPLES, np.uint32)[:, None]
_C = _rng.integers(0, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a UTF-8 text."""
    found = text.lower().split()  # of bytes: A-Z only, ASCII blanks only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    with np.errstate(over="ignore"):
        run = np.full(n, len(found) if len(found) < words else words, np.uint64)
        for i in range(min(words, len(h))):
            run = _mix(run * _P[i] + h[i : i + n])
    return np.unique(run)


def minhash(found: np.ndarray, samples: int) -> np.ndarray:
    """The first samples of a set that isn't empty."""
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)[None, :]
    best = np.full(samples, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 512):
        best = np.minimum(best, (x[:, at : at + 512] * _A[:samples] + _B[:samples]).min(axis=1))
    return best


def odd_sketch(samples: np.ndarray) -> bytes:
    """Bitmap in which each 64-bit sample flips the bit that it hashes to."""
    bit = (samples * _P[2]) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def sketch_of(found: np.ndarray, samples: np.ndarray | None) -> bytes:
    """The odd sketch of a set: of itself, or of its numbered MinHash samples if it is large."""
    with np.errstate(over="ignore"):
        return odd_sketch(found if samples is None else _mix(samples.astype(np.uint64) * _C))


def could_link(differing: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sketches whose XOR has ``differing`` bits, of sets of sizes m and n, leave a link possible."""
    differ = -SKETCH_BITS / 2 * np.log1p(-np.minimum(2 * differing / SKETCH_BITS, 1 - 1e-9))
    small, large = np.maximum(m, n) <= WHOLE, np.minimum(m, n) > WHOLE
    whole = (m + n - differ) / (m + n + differ) >= FLOOR
    sampled = 1 - differ / (2 * SAMPLES) >= SAMPLED_FLOOR
    return np.where(small, whole, np.where(large, sampled, True))


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a row of samples."""
    with np.errstate(over="ignore"):
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _P[0], (len(samples), 1))
        rows = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
        for i in range(ROWS):
            key = _mix(key * _P[1] + rows[:, :, i])
    return key.view(np.int64)


SIGNATURE = fields("n_shingles bigint, set_id binary, bands array<bigint>, sketch binary")


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with set size, fingerprint of the set, band keys and odd sketch
    (null without words)."""

    @F.pandas_udf(T.StructType(SIGNATURE))
    def sign(texts: pd.Series) -> pd.DataFrame:
        sizes, ids, bands, sketch = (np.zeros(len(texts), np.int64), *([None] * len(texts) for _ in range(3)))
        rows = texts.tolist()
        for at in range(0, len(rows), 512):
            sets = [shingles(t) for t in rows[at : at + 512]]
            sizes[at : at + len(sets)] = [len(s) for s in sets]
            has = [i for i, s in enumerate(sets) if len(s)]
            if has:
                samples = [minhash(sets[i], SAMPLES if len(sets[i]) > WHOLE else BANDS * ROWS) for i in has]
                for i, b, x in zip(has, band_keys(np.stack([x[: BANDS * ROWS] for x in samples])), samples, strict=True):
                    ids[at + i], bands[at + i] = xxhash.xxh3_128_digest(sets[i].tobytes()), b
                    sketch[at + i] = sketch_of(sets[i], x if len(sets[i]) > WHOLE else None)
        return pd.DataFrame({"n_shingles": sizes, "set_id": ids, "bands": bands, "sketch": sketch})

    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, sign(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("_s")).select(*keep, "_s.*")


def mapped(docs: DataFrame, wanted: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose key may be in ``wanted``, and those whose key isn't: of a map of fixed
    size that marks the keys' hashes.

    It keeps the other texts out of the shuffle of the exact join that follows.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(MAP_BITS))
    marks = wanted.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    table = np.zeros((MAP_BITS // 32768 + 1, 4096), np.uint8)
    for bucket, bits in marks.collect():
        table[bucket] = np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table.ravel())

    @F.pandas_udf(T.BooleanType())
    def marked(bucket: pd.Series, position: pd.Series) -> pd.Series:
        at = position.to_numpy()
        return pd.Series((shared.value[bucket.to_numpy() * 4096 + at // 8] >> (at % 8)) & 1 == 1)

    asked = marked(F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot))
    return docs.filter(asked), docs.filter(~asked)


def thin(df: DataFrame) -> DataFrame:
    """``df``, a table of ids, in fewer partitions, so that the next shuffle has fewer and larger parts.

    What stands before it up to the last shuffle runs in as few tasks, so it follows cheap steps only."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // THINNER))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = 75) -> DataFrame:
    """Those rows (a, b) of ``pairs`` whose full sets' Jaccard similarity is at least percent / 100."""
    wanted = checkpoint(thin(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))

    @F.pandas_udf(T.BinaryType())
    def whole_set(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t).tobytes())

    sets = mapped(docs, wanted)[0].join(wanted, "doc_id", "left_semi").select("doc_id", whole_set(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("found"))
    sets = checkpoint(sets)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("found").alias("y")), "b")

    @F.pandas_udf(T.BooleanType())
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            m, n = len(p) // 8, len(q) // 8
            union = np.sort(np.frombuffer(p + q, np.uint64))
            common = int((union[1:] == union[:-1]).sum())
            out.append(100 * common >= percent * (m + n - common))
        return pd.Series(out, dtype=bool)

    return both.filter(alike("x", "y")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component_id) of all documents in ``links`` (a, b); the id is the smallest reachable.

    Large-star and small-star rounds: each document hands the smallest one it knows to the others,
    until nothing changes.  A component of any size takes a logarithmic number of rounds, and no
    document's neighbours are gathered: only minima are.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        ways = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("w")).select("w.*") if large else edges
        least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        out = ways.join(least, "u")
        if large:  # larger neighbours are handed the smallest of all; it is smaller than they are
            return thin(out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        return thin(out.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("w")).select("w.*").filter("u <> v").distinct())

    edges = checkpoint(thin(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()))
    while True:
        # done when every document points at one other, and that one at none
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("points")), F.struct(F.col("v").alias("id"), F.lit(0).alias("points")))).alias("e")).select("e.*")
        if ends.groupBy("id").agg(F.sum("points").alias("points"), F.min("points").alias("least")).filter("points > 1 or points > least").isEmpty():
            break
        edges = checkpoint(star(star(edges, True), False))
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id")).union(edges.select("v", "v").distinct())


def _meetings(rows: DataFrame, keys: list[str], work) -> DataFrame:
    """(a, b) that ``work`` finds in the rows of each key; a key's rows stand together, in order of doc_id.

    ``work`` gets whole keys at a time: the rows and where a new key begins.
    """
    # tasks by count of rows, not bytes: the work is in comparing
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(parts, *keys).sortWithinPartitions(*keys, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # the last key may go on in the next batch
            new = np.ones(len(rows), bool)
            key = rows[keys].to_numpy()
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            last = int(np.flatnonzero(new)[-1])
            held = rows.iloc[last:]
            if last:
                yield work(rows.iloc[:last], new[:last])
        if held is not None and len(held):
            yield work(held, np.arange(len(held)) == 0)

    return met.mapInPandas(run, "a bigint, b bigint").distinct()


def _bits(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)


def _fits(size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of 0.75 to 1: others can't be linked."""
    return np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * 75


def _led(rows: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
    """Pairs (leader, member) that look alike; all groups take their next leader at once."""
    ids, size, bits = rows["doc_id"].to_numpy(), rows["n_shingles"].to_numpy(), _bits(rows)
    group, left = np.cumsum(new), np.arange(len(rows))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(LEADERS):
        first = np.ones(len(left), bool)
        first[1:] = group[left[1:]] != group[left[:-1]]
        lead, rest = left[np.flatnonzero(first)[np.cumsum(first) - 1]][~first], left[~first]
        if not len(rest):
            break
        good = _fits(size, lead, rest)
        good[good] = could_link(np.bitwise_count(bits[lead[good]] ^ bits[rest[good]]).sum(axis=1), size[lead[good]], size[rest[good]])
        found.append((ids[lead[good]], ids[rest[good]]))
        left = rest[~good]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return pd.DataFrame({"a": a, "b": b}, dtype="int64")


def _leader_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of leaders and members of a bucket's groups whose sketches look alike.

    members: band, doc_id, head and n (of the bucket), n_shingles, sketch.
    """
    groups = F.ceil(F.col("n") / TILE).cast("int")
    own = F.array(F.pmod(F.xxhash64("doc_id"), groups).cast("int"))
    group = F.when(F.col("doc_id") == F.col("head"), F.sequence(F.lit(0), groups - 1)).otherwise(own)
    return _meetings(members.select("band", F.explode(group).alias("part"), "doc_id", "n_shingles", "sketch"), ["band", "part"], _led)


def _cross_pairs(members: DataFrame, brief: bool) -> DataFrame:
    """Pairs (a, b) of members of a bucket in different components whose sketches look alike; with
    ``brief``, a pair of nulls too if some meeting has reported a part of its pairs only.

    members: band, doc_id, component, main (component), tiles (of members outside it) and parts (of
    those in it), n_shingles, sketch.  Main parts are numbered after the tiles.
    """
    slot = F.xxhash64("doc_id")
    inside = F.col("component") == F.col("main")
    tile = F.when(inside, F.col("tiles") + F.pmod(slot, F.col("parts"))).otherwise(F.pmod(slot, F.col("tiles"))).cast("int")
    last = F.when(inside, F.col("tiles")).otherwise(F.col("tiles") + F.col("parts")).cast("int") - 1
    meet = F.transform(F.sequence(F.lit(0), last), lambda t: F.struct(F.least(t, F.col("tile")).alias("p"), F.greatest(t, F.col("tile")).alias("q")))
    dealt = members.withColumn("tile", tile).withColumn("meet", F.explode(meet)).select("band", "meet.p", "meet.q", "tile", "doc_id", "component", "n_shingles", "sketch")
    return _meetings(dealt, ["band", "p", "q"], lambda rows, new: _alike_in_meetings(rows, new, brief))


def _alike_in_meetings(rows: pd.DataFrame, new: np.ndarray, brief: bool) -> pd.DataFrame:
    """Pairs of rows of one meeting (``new``: where each begins) that look alike."""
    ids, part, size, tile = (rows[c].to_numpy() for c in ("doc_id", "component", "n_shingles", "tile"))
    within, bits = (rows["p"] == rows["q"]).to_numpy(), _bits(rows)
    starts = np.flatnonzero(new)
    ends = np.repeat(np.append(starts[1:], len(rows)), np.diff(np.append(starts, len(rows))))
    left = np.arange(len(rows))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for ahead in range(1, len(rows)):
        left = left[left + ahead < ends[left]]
        if not len(left):
            break
        right = left + ahead
        fits = (part[left] != part[right]) & (within[left] | (tile[left] != tile[right])) & _fits(size, left, right)
        i, j = left[fits], right[fits]
        differing = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1)
        good = could_link(differing, size[i], size[j])
        found.append((i[good], j[good], (differing / (size[i] + size[j]))[good]))
    if not found:
        return pd.DataFrame({"a": [], "b": []}, dtype="Int64")
    i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    if brief and len(i) > PAIRS_A_ROW * len(rows):
        order = np.lexsort((apart, i))
        nth = np.arange(len(i)) - np.searchsorted(i[order], i[order])
        order = order[nth < PAIRS_A_ROW]
        return pd.DataFrame({"a": [None, *ids[i[order]].tolist()], "b": [None, *ids[j[order]].tolist()]}, dtype="Int64")
    return pd.DataFrame({"a": ids[i], "b": ids[j]}, dtype="Int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest of its component) of each document."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = checkpoint(signatures(docs))
    known, signed = docs.filter(F.col("doc_id").isNotNull()), every
    if not thin(every.filter("doc_id is not null").select("doc_id")).groupBy("doc_id").count().filter("count > 1").isEmpty():
        known = known.groupBy("doc_id").agg(F.min("text").alias("text"))
        signed = checkpoint(signatures(known))

    # a class for each different set; its band keys and sketch follow from the set
    sets = signed.filter("set_id is not null and doc_id is not null")
    classes = checkpoint(sets.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.any_value(F.struct("n_shingles", "bands", "sketch")).alias("s")).select("set_id", "doc_id", "s.*"))
    banded = classes.select("doc_id", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    members = checkpoint(banded.join(buckets, "band").join(classes.select("doc_id", "n_shingles", "sketch"), "doc_id"))

    tried = checkpoint(thin(_leader_pairs(members)))
    found = checkpoint(thin(components(confirm(tried, known))))
    for brief in (True, False):
        placed = members.join(found, "doc_id", "left").withColumn("component", F.coalesce("component_id", "doc_id")).drop("component_id")
        counts = placed.groupBy("band", "component").agg(F.count("*").alias("n_in"))
        split = counts.groupBy("band").agg(F.max_by("component", F.struct("n_in", "component")).alias("main"), F.max("n_in").alias("inside"), F.sum("n_in").alias("all"), F.count("*").alias("several")).filter("several > 1")
        placed = placed.join(split, "band").withColumns({"tiles": F.ceil((F.col("all") - F.col("inside")) / TILE), "parts": F.ceil(F.col("inside") / TILE)})
        fresh = checkpoint(thin(_cross_pairs(placed, brief).join(tried, ["a", "b"], "left_anti")))
        whole = not brief or fresh.filter("a is null").isEmpty()
        fresh = fresh.filter("a is not null")
        if not fresh.isEmpty():
            new = checkpoint(confirm(fresh, known))
            if not new.isEmpty():  # the components so far and the new links between them
                found = checkpoint(thin(components(found.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").union(new))))
            tried = tried.union(fresh)
        if whole:
            break

    named = classes.select("set_id", F.col("doc_id").alias("class_id")).join(found.withColumnRenamed("doc_id", "class_id"), "class_id", "left").select("set_id", F.coalesce("component_id", "class_id").alias("component_id"))
    out = every.select("doc_id", "n_shingles", "set_id")
    if signed is not every:  # rows that repeat a doc_id belong where their document does
        named = signed.select("doc_id", "set_id").join(named, "set_id", "left").select("doc_id", "component_id")
        out = out.join(named, "doc_id", "left")
    else:
        out = out.withColumn("set_id", F.when(F.col("doc_id").isNotNull(), F.col("set_id"))).join(named, "set_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
