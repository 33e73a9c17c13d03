"""Spelling variants: words of a corpus, the words one edit away, and the form that each stands for.

1. ``word_counts``: runs of letters (A-Z, a-z, U+00C0 to U+00FF) of whole texts, A-Z lower-cased.  One
   run in 97, chosen by the CRC-32 of ``<doc_id>:<run>``, loses a letter.  Results of at least five
   letters that occur at least three times are the vocabulary.  A task counts in a dictionary of
   bounded size and hands partial counts on.
2. ``near_words``: Bloom-guided neighbourhoods.  The vocabulary becomes blocked Bloom filters, one
   shard for each length; a word's edits (every deletion, against the shard one letter shorter, and
   every replacement by a later letter, against its own) are made as hashes only, by arithmetic on
   the word's polynomial hash, and probed.  An insertion is the other word's deletion, an earlier
   letter the other word's replacement.  Only positives become strings and are shuffled to an exact
   join with the vocabulary, which removes the false ones.  Filters are broadcast ``PASS_BLOCKS`` blocks of 64
   bytes at a time; a larger vocabulary takes more passes, each over the words whose edits can fall there.
3. ``variants``: a word's form is its near word of largest count (ties: the smallest in code-point order)
   if that count is at least twice its own; ``root`` follows forms to the last by pointer doubling.
   Counts at least double on the way, so a chain is short and has no cycle.

Null texts have no words; a null doc_id counts as empty in ``<doc_id>``; repeated rows count again; a
text of any length is one row of one task; columns other than ``doc_id`` and ``text`` are left out,
whatever they are called; an empty table gives no rows.  No word's near words are gathered.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import checkpoint

LETTERS, OCCURRENCES, MISSPELT_EVERY, FORM_TIMES = 5, 3, 97, 2
#: Words that a task counts before it hands partial counts on.
HELD_WORDS = 200_000
#: Bits of filter for each word, and blocks of 512 bits that are broadcast at a time (32 MB).
BITS, PASS_BLOCKS = 32, 1 << 19
#: Probes that are held at a time.
PROBES = 1 << 18
LANES = 8

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))
_rng = np.random.Generator(np.random.PCG64(97))
_VALUE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_P = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least ``LETTERS`` letters with at least ``OCCURRENCES`` occurrences."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: defaultdict[bytes, int] = defaultdict(int)

        def counted() -> pd.DataFrame:
            out = pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                seed = zlib.crc32(f"{key}:".encode())
                # code points beyond U+00FF become '?', so that a byte is a code point
                for run, n in Counter(text.encode("latin-1", "replace").translate(_FOLD).split()).items():
                    if len(run) >= LETTERS:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                        if h % MISSPELT_EVERY == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < LETTERS:
                                continue
                        held[run] += n
                if len(held) > HELD_WORDS:
                    yield counted()
        if held:
            yield counted()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text").cast("string").alias("text")).filter("text is not null")
    # partial counts are in the dictionaries; a stated number of parts keeps as many tasks for the probes
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInPandas(count, "word string, n bigint").repartition(parts, "word")
    return dealt.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OCCURRENCES)


def _powers(length: int) -> np.ndarray:
    return np.array([pow(_BASE, i, 1 << 64) for i in range(length)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P[0]
    return x ^ (x >> np.uint64(29))


class Shards:
    """Where words lie in the filters: the blocks of a length follow those of the length before it."""

    def __init__(self, words: dict[int, int]):
        self.first, self.blocks, at = {}, {}, 0
        for length in sorted(words):
            self.first[length], self.blocks[length] = at, max(1, -(-words[length] * BITS // 512))
            at += self.blocks[length]
        self.total = at

    def block(self, length: int, mixed: np.ndarray) -> np.ndarray:
        """Numbers of the blocks of words of a length, by their mixed hashes."""
        return ((mixed >> np.uint64(32)) * np.uint64(self.blocks[length]) >> np.uint64(32)).astype(np.int64) + self.first[length]

    def meets(self, length: int, low: int, high: int) -> bool:
        return length in self.first and self.first[length] < high and self.first[length] + self.blocks[length] > low


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, letters as a matrix) for each length."""
    coded = [w.encode("latin-1") for w in words]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        yield at, np.frombuffer(b"".join(coded[i] for i in at.tolist()), np.uint8).reshape(len(at), length)


def _bits(mixed: np.ndarray, lane: int) -> np.ndarray:
    """The bit that a word sets in a lane of its block."""
    return np.uint64(1) << ((mixed * _P[1]) >> np.uint64(6 * lane + 10) & np.uint64(63))


def _filters(vocabulary: DataFrame, shards: Shards, low: int, high: int) -> np.ndarray:
    """Blocks ``low`` to ``high``, of 8 lanes of 64 bits, with one bit of every lane set for each word.

    Tasks fill those lanes that their words fall in; their bits are merged by lane before the driver
    has them, at most 64 bytes a block.
    """

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, letters in _by_length(batch["word"].tolist()):
                length = letters.shape[1]
                if not shards.meets(length, low, high):
                    continue
                mixed = _mix((_VALUE[letters] * _powers(length)).sum(axis=1, dtype=np.uint64))
                block = shards.block(length, mixed)
                inside = (block >= low) & (block < high)
                mixed, block = mixed[inside], block[inside]
                if len(block):
                    out = {"block": block - low} | {f"l{i}": _bits(mixed, i).view(np.int64) for i in range(LANES)}
                    yield pd.DataFrame(out)

    lanes = [f"l{i}" for i in range(LANES)]
    found = vocabulary.mapInPandas(fill, "block bigint, " + ", ".join(f"{x} bigint" for x in lanes))
    merged = found.groupBy("block").agg(*[F.bit_or(x).alias(x) for x in lanes]).toArrow()
    out = np.zeros((high - low, LANES), np.uint64)
    out[merged["block"].to_numpy()] = np.stack([merged[x].to_numpy() for x in lanes], axis=1).view(np.uint64)
    return out


def _probe(blocks: np.ndarray, shards: Shards, low: int, high: int, length: int, hashes: np.ndarray) -> np.ndarray:
    """Positions of those hashes of words of ``length`` that the filter's blocks ``low`` to ``high`` hold."""
    mixed = _mix(hashes)
    block = shards.block(length, mixed) - low
    at = np.flatnonzero((block >= 0) & (block < high - low))
    for lane in range(LANES):
        at = at[(blocks[block[at], lane] & _bits(mixed[at], lane)) != 0]
    return at


def _neighbours(words: list[str], letters: np.ndarray, place: np.ndarray, alphabet: np.ndarray, blocks: np.ndarray, shards: Shards, low: int, high: int) -> Iterator[tuple[int, str]]:
    """(position, edited word) of the edits of words of one length that pass the filter."""
    length = letters.shape[1]
    terms = _VALUE[letters] * _powers(length)
    before = np.concatenate([np.zeros((len(letters), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1]
    if shards.meets(length - 1, low, high):
        shorter = before[:, :-1] + (whole[:, None] - before[:, 1:]) * _INVERSE
        fresh = np.ones(letters.shape, bool)  # a letter of a run of equal ones is deleted once
        fresh[:, 1:] = letters[:, 1:] != letters[:, :-1]
        who, where = np.nonzero(fresh)
        for hit in _probe(blocks, shards, low, high, length - 1, shorter[who, where]).tolist():
            word, at = words[place[who[hit]]], int(where[hit])
            yield place[who[hit]], word[:at] + word[at + 1 :]
    if shards.meets(length, low, high):
        step = max(1, PROBES // (length * len(alphabet)))
        for start in range(0, len(letters), step):
            part = slice(start, start + step)
            who, where, which = np.nonzero(alphabet[None, None, :] > letters[part][:, :, None])
            put = alphabet[which]
            changed = whole[part][who] + (_VALUE[put] - _VALUE[letters[part][who, where]]) * _powers(length)[where]
            for hit in _probe(blocks, shards, low, high, length, changed).tolist():
                word, at = words[place[start + who[hit]]], int(where[hit])
                yield place[start + who[hit]], word[:at] + chr(put[hit]) + word[at + 1 :]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n), one row a direction, of words (word, n) that differ by exactly one edit."""
    known = dict(vocabulary.groupBy(F.length("word").alias("length")).count().collect())
    seen = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''").distinct()
    alphabet = np.array(sorted(ord(r[0]) for r in seen.collect()), np.uint8)  # at most 26 + 64
    shards, spark = Shards(known), vocabulary.sparkSession
    found = None
    for low in range(0, max(1, shards.total), PASS_BLOCKS):
        high = min(shards.total, low + PASS_BLOCKS)
        held = spark.sparkContext.broadcast(_filters(vocabulary, shards, low, high))

        def edits(batches: Iterator[pd.DataFrame], low: int = low, high: int = high, held=held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                words = batch["word"].tolist()
                for place, letters in _by_length(words):
                    pairs = list(_neighbours(words, letters, place, alphabet, held.value, shards, low, high))
                    if pairs:
                        at, near = zip(*pairs, strict=True)
                        rows = batch.iloc[list(at)]
                        yield pd.DataFrame({"word": rows["word"], "n": rows["n"]}).assign(near=near)

        pairs = vocabulary.select("word", "n").mapInPandas(edits, "word string, n bigint, near string")
        found = pairs if found is None else found.unionByName(pairs)
    exact = found.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    ways = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return exact.select(F.explode(ways).alias("w")).select("w.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form: pointers are doubled until none moves."""
    jumps = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        beyond = jumps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        jumps = checkpoint(jumps.select("word", "root").join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if jumps.filter("moved").isEmpty():
            return jumps.select("word", "root")


def variants(vocabulary: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``vocabulary`` (word, n)."""
    vocabulary = checkpoint(vocabulary.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best")
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best, F.first("n").alias("n"))
    stands = (-F.col("best.less")) >= FORM_TIMES * F.col("n")
    near = checkpoint(near.select("word", "n_near", F.when(stands, F.col("best.near")).alias("form"), F.when(stands, -F.col("best.less")).alias("form_n")))
    roots = _roots(near.filter("form is not null"))
    out = vocabulary.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of ``docs`` (doc_id, text)."""
    return variants(word_counts(docs))
