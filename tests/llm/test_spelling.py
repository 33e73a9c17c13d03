"""Spelling variants against a plain version that compares every word with every edit of it."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import spelling


def plain_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def plain_variants(counts):
    letters = sorted({c for w in counts for c in w})
    near = {}
    for w in counts:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in letters}
        near[w] = sorted((-counts[x], x) for x in edits - {w} if x in counts)
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * counts[w] else None for w in counts}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


def found(rows, spark, schema="doc_id bigint, text string"):
    return {tuple(r) for r in spelling.spelling_variants(spark.createDataFrame(rows, schema)).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def corpus(seed, n_docs, alphabet):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(4, 7))) for _ in range(40)]
    words += [w[:i] + rng.choice(alphabet) + w[i + rng.randint(0, 1) :] for w in words for i in (1, 3)]
    return [(i, " ".join(rng.choice(words[: rng.randint(5, len(words))]) for _ in range(rng.randint(0, 400)))) for i in range(n_docs)]


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "abc"), (2, "abcdéÀ÷"), (3, "aB")])
def test_equals_the_plain_version(spark, seed, alphabet):
    rows = corpus(seed, 40, alphabet)
    want = plain_variants(plain_counts(rows))
    assert len(want) > 20 and any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want)
    assert found(rows, spark) == want


def test_odd_rows(spark):
    long = ("Straße naïve éclair " * 30_000) + "x" * 50_000
    rows = [(1, None), (2, ""), (None, "hello hello hello helo helo"), (3, long), (3, long), (4, "中文hello\U0001f600world" * 3), (5, "ééééé éééé ééééé ééééé")]
    assert found(rows, spark) == plain_variants(plain_counts(rows))
    assert found([], spark) == set()


def test_ties_go_to_the_smallest_word(spark):
    vocabulary = spark.createDataFrame([("steam", 3), ("steal", 8), ("steak", 8), ("stear", 5)], "word string, n bigint")
    assert {r["word"]: r["form"] for r in spelling.variants(vocabulary).collect()} == {"steam": "steak", "steal": None, "steak": None, "stear": None}


def test_passes_over_parts_of_the_filters(spark, monkeypatch):
    rows = corpus(4, 30, "abcd")
    whole = found(rows, spark)
    monkeypatch.setattr(spelling, "PASS_BLOCKS", 2)
    assert found(rows, spark) == whole == plain_variants(plain_counts(rows))


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame(corpus(5, 20, "abc"), "doc_id bigint, text string")
    odd = docs.select("*", *[F.lit("x").alias(c) for c in ("word", "n", "key", "near", "root", "form")])
    assert sorted(spelling.spelling_variants(odd).collect()) == sorted(spelling.spelling_variants(docs).collect())


def test_only_positives_are_shuffled(spark):
    vocabulary = spelling.checkpoint(spelling.word_counts(spark.createDataFrame(corpus(6, 40, "abcdefghij"), "doc_id bigint, text string")))
    n = vocabulary.count()
    pairs = spelling.near_words(vocabulary)
    assert pairs.count() < n * 10
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()
