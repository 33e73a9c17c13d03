"""Best-fit packing of token sequences by non-negative least squares over length patterns.

1. Every text is tokenized and gets an end id.  Documents longer than a sequence are cut so that
   all pieces but the first are full.
2. The histogram of piece lengths (at most one count per possible length, whatever the size of
   the corpus) goes to the driver.  Patterns of up to three lengths that fill a sequence are
   enumerated, their repeat counts are fitted to the histogram by non-negative least squares and
   rounded without using more pieces than there are; what is left is packed best-fit decreasing,
   by counts of equal lengths, also into the gaps of patterns that leave some.
3. The plan says which pieces of a length (by rank) go to which sequences.  Ranks are made without
   sorting a length in one task: a piece counts its equals within its own task, and a window over
   the counts of (length, task) adds where that task begins.

Null text counts as empty: its only token is the end id.  A text of any length is cut into pieces by
one task, which holds its ids.  Repeated rows are packed each on their own; a null doc_id is kept.
Other columns than ``doc_id`` and ``text`` are left out, whatever they are called.  An empty table
gives no sequences.
"""

from __future__ import annotations

import bisect
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.bpe import PieceMemo, pieces
from tidegauge.llm.common import checkpoint, fields

CAPACITY = 1024
#: Triples that are tried for each longest length.
TRIPLES = 4
STEPS = 1500

#: Matches of the split pattern that a worker remembers.
WORDS = 700_000
#: In texts of no other characters, ``_MATCH`` is the library's split pattern.
_OTHER = re.compile(r"[^ -~\t\n\rÀ-ÖØ-öø-ɏ]").search
_MATCH = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+|\s+(?!\S)|\s+").findall

_LOADED: dict[str, PieceMemo] = {}


def matches(text: str) -> list[str]:
    """A text cut where the library cuts it: at each match of its split pattern, or, with characters
    beyond ASCII and Latin letters, before each blank that a non-blank follows."""
    return pieces(text) if _OTHER(text) else _MATCH(text)


def library_tokenizer(path: str) -> PieceMemo:
    """The ``tokenizers`` library's ids, remembered by match, so that a word is encoded once whatever
    stands around it; one for each process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        encode = tokenizer.encode_batch_fast
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        (line_feed,) = tokenizer.encode("\n", add_special_tokens=False).ids
        solid = re.compile(r" ?\S+").fullmatch

        def encode_pieces(missing: list[str]) -> list[bytes]:
            """Pieces without inner blanks go to the library many at a time, a line feed between
            them: it is a match of its own there, and no such piece holds its token."""
            found: dict[str, bytes] = {}
            joined = [p for p in missing if solid(p) and p not in special]
            parts = [joined[i : i + 64] for i in range(0, len(joined), 64)]
            for part, x in zip(parts, encode(["\n".join(part) for part in parts], add_special_tokens=False), strict=True):
                ids = np.array(x.ids, "<u4")
                cuts = np.flatnonzero(ids == line_feed)
                raw, begins, ends = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
                found.update(zip(part, [raw[a:b] for a, b in zip(begins, ends, strict=True)], strict=True))
            rest = [p for p in missing if p not in found]
            for p, x in zip(rest, encode(rest, add_special_tokens=False), strict=True):
                found[p] = np.array(x.ids, "<u4").tobytes()
            return [found[p] for p in missing]

        # the library takes the string of an added token out of a text first, and what is between them as a text each
        apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

        def cut(text: str) -> list[str]:
            if apart is None or not any(s in text for s in special):
                return matches(text)
            return [p for part in apart(text) for p in ([part] if part in special else matches(part))]

        _LOADED[path] = PieceMemo(encode_pieces, cut, WORDS)
    return _LOADED[path]


PIECES = T.StructType(fields("piece int, start bigint, length bigint, ids_le binary, task int, nth bigint"))


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32 bits), and its rank among the pieces
    of its length in its task."""
    schema = T.StructType([T.StructField(key, T.StringType()), *PIECES.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = library_tokenizer(path)
        task, seen, end = TaskContext.get().partitionId(), defaultdict(int), end_id.to_bytes(4, "little")
        for batch in batches:
            keys, texts = batch[key].tolist(), batch[text].fillna("").tolist()
            for at in range(0, len(texts), 256):
                rows = []
                for k, ids in zip(keys[at : at + 256], tokenizer.encode_texts(texts[at : at + 256]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    start = 0
                    for piece, stop in enumerate(range(first, n + 1, capacity)):
                        rows.append((k, piece, start, stop - start, ids[4 * start : 4 * stop], task, seen[stop - start]))
                        seen[stop - start] += 1
                        start = stop
                yield pd.DataFrame(rows, columns=schema.names)

    # the key travels as text: pandas would turn whole numbers beside nulls into doubles
    made = docs.select(F.col(key).cast("string").alias(key), F.col(text).cast("string").alias(text)).mapInPandas(run, schema)
    return made.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


# -- the plan, made from the histogram alone -----------------------------------------------------


def patterns(lengths: list[int], capacity: int, triples: int = TRIPLES) -> list[tuple[int, ...]]:
    """Singles, pairs and triples that fill a sequence, or as near to it as the lengths allow."""
    found = set()

    def largest(most: int) -> int:
        i = bisect.bisect_right(lengths, most)
        return lengths[i - 1] if i else 0

    for a in lengths:
        if not (b := largest(capacity - a)):
            found.add((a,))
            continue
        pair = tuple(sorted((a, b), reverse=True))
        if not largest(capacity - a - b):
            found.add(pair)
        room = lengths[: bisect.bisect_right(lengths, capacity - a)]
        picks = {room[i * (len(room) - 1) // max(1, triples - 1)] for i in range(triples)}
        picks |= {x for x in (largest((capacity - a) // 2), largest((capacity - a) // 3)) if x}
        for b in picks:
            if c := largest(capacity - a - b):
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found)


def nnls(columns: list[tuple[int, ...]], counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|; A[l, p] says how often pattern p holds length l.

    Projected gradient with momentum.  A is kept as index lists: a pattern has few lengths.
    """
    pattern = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    length = np.concatenate([np.array(c) for c in columns])
    size = len(counts)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(length, x[pattern], size)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(pattern, r[length], len(columns))

    v = np.ones(len(columns))
    for _ in range(30):
        w = back(forward(v))
        v = w / np.linalg.norm(w)
    step = 0.99 / np.linalg.norm(back(forward(v)))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(forward(y) - counts))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, triples: int = TRIPLES) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), covering the histogram exactly.

    The fit is rounded in several ways - to the nearest count, down, and down from somewhat smaller
    shares of it, which leaves more to the residual packing - and the plan of fewest sequences stays.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    full = [((capacity,), int(counts[capacity]))] if counts[capacity] else []
    counts[capacity] = 0
    lengths = np.flatnonzero(counts).tolist()
    if not lengths:
        return full
    tried = patterns(lengths, capacity, triples)
    fitted = nnls(tried, counts.astype(float))
    plans = [_rounded(tried, np.floor(fitted * share + up).astype(np.int64), counts.copy(), capacity) for share, up in ((1, 0.5), (1, 0), (0.9, 0), (0.8, 0))]
    return full + min(plans, key=lambda bins: sum(n for _, n in bins))


def _rounded(tried: list[tuple[int, ...]], repeats: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as asked and as pieces last; the rest best-fit decreasing."""
    open_bins: dict[int, list[list]] = defaultdict(list)  # by room: [lengths, how many]
    for p in np.argsort(-repeats, kind="stable").tolist():
        held = tried[p]
        n = min(int(repeats[p]), *(int(left[x]) // held.count(x) for x in held))
        if n > 0:
            for x in held:
                left[x] -= n
            open_bins[capacity - sum(held)].append([held, n])
    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n:
            room = min((r for r, b in open_bins.items() if r >= length and b), default=None)
            if room is None:
                each = capacity // length
                if n >= each:
                    open_bins[capacity - each * length].append([(length,) * each, n // each])
                if n % each:
                    open_bins[capacity - n % each * length].append([(length,) * (n % each), 1])
                break
            held, have = last = open_bins[room][-1]
            used = min(n, have)
            last[1] -= used
            if not last[1]:
                open_bins[room].pop()
            open_bins[room - length].append([(*held, length), used])
            n -= used
    return [(tuple(held), n) for b in open_bins.values() for held, n in b if n]


def _by_length(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, pieces a sequence and where their places stand."""
    table: dict[int, list] = defaultdict(list)
    places: list[int] = []
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for held, n in bins:
        offsets: dict[int, list[int]] = defaultdict(list)
        at = 0
        for length in held:
            offsets[length].append(at)
            at += length
        for length, own in offsets.items():
            table[length].append((used[length], sequence, len(own), len(places)))
            places += own
            used[length] += n * len(own)
        sequence += n
    places_of = np.array(places, np.int64)
    return {length: (*np.array(rows, np.int64).T, places_of) for length, rows in table.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to checkpointed rows that have length, task and nth."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_begin"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(_by_length(plan(histogram, capacity)))
    keep = [c for c in pieces.columns if c not in ("task", "nth")]

    @F.pandas_udf(T.StructType(fields("sequence_id bigint, offset bigint")))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset, ranks = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), rank.to_numpy()
        for own, rows in length.groupby(length).indices.items():
            first, base, each, at, places = shared.value[own]
            segment = np.searchsorted(first, ranks[rows], side="right") - 1
            within = ranks[rows] - first[segment]
            sequence[rows] = base[segment] + within // each[segment]
            offset[rows] = places[at[segment] + within % each[segment]]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = pieces.join(begins, ["length", "task"])
    return ranked.select(*keep, place("length", F.col("nth") + F.col("_begin")).alias("_place")).select(*keep, "_place.*")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.
    """
    pieces = token_pieces(docs, path, end_id, capacity)
    digest = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids_le").alias("ids_crc32"), "task", "nth")
    return pack(checkpoint(digest), capacity)
