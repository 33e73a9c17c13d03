"""Decontamination against a plain search for windows of words."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = set()
    for item_id, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        windows |= {(tuple(w[i : i + n]), item_id) for i in range(len(w) - n + 1) if n}
    by_window = {}
    for w, item in windows:
        by_window.setdefault(w, set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in by_window}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in by_window:
                    hit |= set(range(i, i + n))
                    found |= by_window[x]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items):
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    return sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def made(seed, n_docs=60, n_items=25, vocabulary=6):
    """Texts of few words, so that windows recur, with passages of items of every length in documents."""
    rng = random.Random(seed)
    words = [f"w{i}" if i % 2 else f"É{i}é" for i in range(vocabulary)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 4, 5, 7, 9, 10, 11, 14, 30]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [text(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            passage = plain_words(rng.choice(items)[1])
            parts += [" ".join(passage[rng.randint(0, 3) : rng.randint(8, 40)]).replace("w", "W"), text(rng.randint(0, 12))]
        docs.append((i, " ".join(parts)))
    return docs, items


def test_equals_the_plain_version(spark):
    for seed, vocabulary in ((1, 4), (2, 30), (3, 400)):
        docs, items = made(seed, vocabulary=vocabulary)
        if vocabulary == 4:  # items of a word or two would hit everything
            items = [x for x in items if len(plain_words(x[1])) >= 9]
        want = plain(docs, items)
        assert found(spark, docs, items) == want and any(r[5] for r in want)


def test_every_shared_span_is_found_and_no_shorter_one(spark):
    rng = random.Random(9)
    item = [f"v{i}" for i in range(40)]
    docs = []
    for n in range(1, 41):
        at = rng.randint(0, 40 - n)
        docs.append((n, " ".join(["left", *item[at : at + n], "right"])))
    rows = found(spark, docs, [(7, " ".join(item))])
    assert {r[0]: r[2] for r in rows} == {n: n if n >= 10 else 0 for n in range(1, 41)}


def test_odd_rows(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = [(1, None), (2, ""), (None, item), (3, "x " * 150_000 + item + " y" * 150_000), (4, item), (4, item), (5, "..,;"), (6, "one Two")]
    items = [(1, item), (1, "one two"), (None, "y y y y y y y y y y"), (2, None), (3, ""), (10, item), (9, item)]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, []) == plain(docs, []) and found(spark, [], items) == []


def test_a_window_in_many_documents_and_items(spark):
    line = "this passage of more than ten words is in every single text there is"
    docs = [(i, f"d{i} {line} e{i} " * (1 + i % 3)) for i in range(400)]
    items = [(i, f"before{i} {line} after{i}") for i in range(300)]
    assert found(spark, docs, items) == plain(docs, items)


def test_columns_with_clashing_names(spark):
    docs, items = made(5)
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    odd = [F.lit("x").alias(c) for c in ("row", "hits", "span", "set_id", "window", "n_words")]
    assert sorted(decontaminate.contamination(d.select("*", *odd), i.select("*", *odd)).collect()) == sorted(decontaminate.contamination(d, i).collect())


def test_maps_that_are_full_only_let_more_through(spark, monkeypatch):
    docs, items = made(6)
    monkeypatch.setattr(decontaminate, "_marked", lambda marks, keys: np.ones(len(keys), bool))
    assert found(spark, docs, items) == plain(docs, items)


def test_fingerprints_are_the_smallest_of_every_window():
    h = np.array(random.Random(1).sample(range(1 << 40), 50), np.uint64)
    g = decontaminate.grams(h, 5)
    assert decontaminate.least(g, 6).tolist() == [min(g[i : i + 6].tolist()) for i in range(len(g) - 5)]
    assert decontaminate.grams(h[3:9], 5).tolist() == g[3:5].tolist() and len(decontaminate.grams(h[:4], 5)) == 0
