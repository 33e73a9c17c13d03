"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features are hashes of words and word pairs, and of the shapes of words (case, digits, punctuation,
length, same word as before) in runs of one to three, in a space of ``2**bits``; their value in a
text is their share of all its features, times a constant.  Training rows are dealt by the hash of
their key to a fixed number of learners; each runs the per-coordinate FTRL-proximal updates over
its share, and the weights of all learners are averaged, a round after another.  A model is one
array of ``2**bits`` doubles, so what goes to the driver and back is bounded by that parameter, and
training rows by ``max_rows``: the labelled rows of least key hash, which are taken whole.

Null text counts as empty; an empty text has no features and gets the score of the bias.  Texts are
read whole.  Without training rows every score is 0.5.  Repeated rows train and score as often as
they are there; a null key or label never trains.  Other columns stay when scoring, one with the
name of the output is replaced; training looks at key, text and label only.  An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import checkpoint, h64

BITS = 18
#: Labelled rows that train at most.
MAX_ROWS = 12_000
LEARNERS = 8
ROUNDS = 4
ALPHA, BETA, L1, L2 = 2, 1.0, 1e-3, 1e-3
#: A text's values add to this.
SCALE = 8.0
_MEMO_SIZE = 150_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_REPEATED = np.uint64(0x5BD1E995)
_LOW = np.uint64(0xFFFFFFFF)

_memo: dict[str, int] = {}


def _shape(word: str) -> str:
    """Case pattern, digits and punctuation of a word, runs of a kind shrunk to one; and its length in fours."""
    if word.isalpha():
        runs = "x" if word.islower() else "Xx" if word[1:].islower() else "X"
    else:
        runs = ""
        for c in word[:24]:
            k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
            if k not in "Xx9" or runs[-1:] != k:
                runs += k
    return runs[:12] + str(min(len(word) // 4, 5))


def _codes(words: list[str]) -> np.ndarray:
    """The word's hash in the upper half, its shape's in the lower."""
    if len(_memo) > _MEMO_SIZE:
        _memo.clear()
    for w in set(words).difference(_memo):
        _memo[w] = h64(w.encode("utf-8", "surrogatepass")) >> 32 << 32 | h64(_shape(w).encode("utf-8", "surrogatepass"), 1) >> 32
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, list[tuple[np.ndarray, int]]]:
    """Where each text's words begin (and the end of all), and for runs of one to three words the
    hashed index at each word with the run's length; runs that cross into the next text are there
    too and must be left out."""
    lists = [t.split() for t in texts]
    begins = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=begins[1:])
    code = _codes([w for x in lists for w in x])
    word, shape = code >> np.uint64(32), code & _LOW
    first = np.zeros(len(code), bool)
    first[begins[:-1][begins[:-1] < len(code)]] = True
    same = np.zeros(len(code), bool)
    same[1:] = (word[1:] == word[:-1]) & ~first[1:]
    shape = np.where(same, shape ^ _REPEATED, shape)
    drop = np.uint64(64 - bits)

    def index(run: np.ndarray, kind: int) -> np.ndarray:
        return (((run ^ np.uint64(kind)) * _MULTIPLIER) >> drop).astype(np.int64)

    with np.errstate(over="ignore"):
        two = shape[:-1] * _MULTIPLIER + shape[1:]
        runs = [
            (index(word, 1 << 40), 1),
            (index(shape, 2 << 40), 1),
            (index(word[:-1] * _MULTIPLIER + word[1:], 3 << 40), 2),
            (index(two, 4 << 40), 2),
            (index(two[:-1] * _MULTIPLIER + shape[2:], 5 << 40), 3),
        ]
    return begins, runs


def features(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices of one text and their values."""
    found = np.concatenate([i for i, _ in grams([text], bits)[1]])
    index, count = np.unique(found, return_counts=True)
    return index, SCALE * count / max(1, len(found))


def dot(texts: list[str], w: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Product of each text's features with ``w``."""
    begins, runs = grams(texts, bits)
    total, number = np.zeros(len(texts)), np.zeros(len(texts))
    for index, size in runs:
        sums = np.concatenate([[0.0], np.cumsum(w[index], dtype=np.float64)])
        ends = np.maximum(begins[1:] - (size - 1), begins[:-1])
        starts = np.minimum(begins[:-1], len(sums) - 1)
        total += sums[np.minimum(ends, len(sums) - 1)] - sums[starts]
        number += ends - begins[:-1]
    return SCALE * total / np.maximum(number, 1)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, float]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass of FTRL-proximal over ``rows``; the last coordinate is the bias."""
    for index, value, label in rows:
        zi, ni = z[index], n[index]
        w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value
        grown = ni + g * g
        z[index] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
        n[index] = grown


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(keys: tuple, pdf: pd.DataFrame, state: dict, bits: int) -> pd.DataFrame:
    """A learner's share of a round: its state after it, where it isn't zero."""
    size = 1 << bits
    shared = state["value"].value if state["value"] is not None else None
    z, n = (shared[0].copy(), shared[1].copy()) if shared is not None else (np.zeros(size + 1), np.zeros(size + 1))
    pdf = pdf.sort_values("_order", kind="stable")
    rows = []
    for text, label in zip(pdf["_text"], pdf["_label"], strict=True):
        index, value = features(text, bits)
        rows.append((np.append(index, size), np.append(value, 1.0), float(label)))
    _ftrl(rows, z, n)
    return pd.DataFrame({"learner": [int(keys[0])], "z": [z.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", bits: int = BITS, max_rows: int = MAX_ROWS, learners: int = LEARNERS, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (the last is the bias) from texts and their 0/1 labels, both by key."""
    size = 1 << bits
    known = labels.select(key, F.col(label).cast("double").alias("_label")).filter(F.col(key).isNotNull() & F.col("_label").isNotNull())
    known = known.withColumn("_order", F.xxhash64(F.col(key).cast("string")))
    # the bound of the sample's key hash, so that only the sample's texts move
    cut = known.orderBy("_order").limit(max_rows).agg(F.max("_order")).first()[0]
    if cut is None:
        return np.zeros(size + 1)
    rows = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).filter(F.xxhash64(F.col(key).cast("string")) <= cut)
    rows = rows.join(known.filter(F.col("_order") <= cut), key).withColumn("_learner", F.pmod(F.col("_order"), F.lit(learners)).cast("int"))
    share = checkpoint(rows.select("_learner", "_order", "_label", "_text"))
    state: dict = {"value": None}
    sc = docs.sparkSession.sparkContext
    for _ in range(rounds):
        parts = share.groupBy("_learner").applyInPandas(_learner(state, bits), "learner int, z binary, n binary").collect()
        if not parts:
            return np.zeros(size + 1)
        z = np.mean([np.frombuffer(p["z"], np.float32) for p in parts], axis=0, dtype=np.float64)
        n = np.mean([np.frombuffer(p["n"], np.float32) for p in parts], axis=0, dtype=np.float64)
        if state["value"] is not None:
            state["value"].unpersist()
        state = {"value": sc.broadcast((z, n))}
    return weights(z, n)


def _learner(state: dict, bits: int):
    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _learn(keys, pdf, state, bits)

    return run


def score(docs: DataFrame, model: np.ndarray, text: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """``docs`` with the probability of label 1: sparse dot products with the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        bias = w[1 << bits]
        for texts in batches:
            rows = texts.tolist()
            found = bias + np.concatenate([np.zeros(0), *(dot(rows[i : i + 256], w, bits) for i in range(0, len(rows), 256))])
            yield pd.Series(1 / (1 + np.exp(-np.clip(found, -35, 35))))

    return docs.withColumn(out, probability(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def held_out(key: str = "doc_id"):
    """Rows that never train: one in five, by the checksum of the key's text."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
