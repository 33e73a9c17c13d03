"""The trie against a plain one, and tree contraction against sums along every path."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidegauge.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            said[c].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in said.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            nodes[tuple(made[c][:d])].append(c)
    out = set()
    for node, members in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        kids = lambda n: sum(len(x) == len(n) + 1 and x[: len(n)] == n for x in nodes)
        ends = ",".join(str(c) for c in members if len(made[c]) == len(node))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.add((members[0], len(node), nodes[node[:-1]][0] if node else None, len(members), kids(node), sum(kids(x) == 0 for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, rows):
    out = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    return {tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def made(seed, n=40, texts=3, longest=9):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if texts > 3 else "user", f"é{rng.randrange(texts)}") for c in range(-6, n) for t in range(rng.randint(1, longest))]


def test_equals_the_plain_version(spark):
    for seed, texts, longest in ((1, 2, 9), (2, 5, 14)):
        rows = made(seed, texts=texts, longest=longest)
        assert found(spark, rows) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    monkeypatch.setattr(prefix_trie, "RUN_BITS", 2)
    rows = [(5, None, None, None), (5, 0, "user", ""), (5, 0, "user", ""), (6, 3, "b", "x"), (6, 3, "a", "y"), (6, None, "c", "z"), (None, 0, "user", "lost"), (7, 0, "user", "é" * 100_000), (11, 0, "user", "q")]
    rows += [(c, t, "user", f"t{t % 3}") for c in (20, 21, 22, 23, 24, 100) for t in range(30)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == set()


def test_a_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 5)
    rows = [(1000, t, "user", str(t)) for t in range(700)] + [(c, t, "user", str(t)) for c in range(0, 300) for t in range(3)]
    out = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    deep = out.filter("conv_id = 1000 or depth = 0").orderBy("depth").collect()
    assert len(deep) == 1 + 700 - 3 and [r["n_leaves"] for r in deep[1:]] == [1] * 697
    assert deep[0]["n_convs"] == 301
    small = [r for r in rows if r[0] != 1000 or r[1] < 40]
    assert found(spark, small) == plain(small)


def test_contraction_of_random_trees(spark):
    rng = random.Random(3)
    for bias in (1, 3, 40):  # bushy to stringy
        parent = {0: None} | {i: max(0, i - rng.randint(1, max(1, 200 // bias))) if rng.random() < 0.9 else rng.randrange(i) for i in range(1, 300)}
        value = {i: rng.randint(0, 9) for i in parent}
        want = dict(value)
        for i in sorted(parent, reverse=True):
            if parent[i] is not None:
                want[parent[i]] += want[i]
        nodes = spark.createDataFrame([(i, p, value[i]) for i, p in parent.items()], "id bigint, parent bigint, v bigint")
        assert {r["id"]: r["v"] for r in prefix_trie.subtree_totals(nodes, ["v"]).collect()} == want


def test_columns_with_clashing_names(spark):
    rows = spark.createDataFrame(made(4), SCHEMA)
    odd = rows.select("*", *[F.lit("x").alias(c) for c in ("id", "parent", "depth", "length", "pos", "chunk")])
    assert sorted(prefix_trie.trie(odd).drop("parent_conv_id").collect()) == sorted(prefix_trie.trie(rows).drop("parent_conv_id").collect())
