"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

1. Turns are ordered in each conversation by ``turn`` (null first), turns of one number by the MD5 of role
   and text.  Only that digest and the text's size are kept; texts are not shuffled.  Ranks and
   prefixes are counted in chunks of ``CHUNK`` turns, so that a long conversation is spread over
   tasks; turns of the same number lie in one.
2. ``rebuilt``: conversation c is made of the first h turns of conversation c - c % 5 (sign of c, as SQL has it) and of its own after
   its first h, where h is the CRC-32 of the decimal c modulo 9.
3. A prefix is known by four sums of 32-bit hashes of (position, digest), which running sums give in any
   chunking; a node groups the prefixes that are equal.  Its numbers are partial counts before they move.
4. ``subtree_totals`` contracts the tree: *compress* takes out all chains of nodes with a single child at
   once, by doubling pointers down the chain, and leaves its sum on the edge above the chain's end;
   *rake* takes out all leaves and adds their totals to their parents.  Each pair of them at least halves the
   nodes.  The removed chains are then put back, the last first: a chain node's total is its part of
   the chain and the total of the chain's end.
5. ``ends``: the decimal ids of those that end at a node are joined in runs of ``RUN`` ids, and the runs of a node
   stream in order through one SHA-256.

Rows without conv_id take no part.  Null role and text are empty.  Repeated rows are repeated turns.  Texts of any
length are hashed where they are read.  Columns other than conv_id, turn, role and text are left out, whatever they are
called.  An empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import written

CHUNK_BITS, RUN_BITS = 10, 12
CHUNK, RUN = 1 << CHUNK_BITS, 1 << RUN_BITS
FAMILY, SHARED = 5, 9
_SUMS = ("a", "b", "c", "d")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, chunk, turn, digest and n_bytes of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return rows.withColumn("chunk", F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(-(1 << 62))))


def _before(value: Column, order: str) -> Column:
    """Sum of ``value`` over the rows of a conversation before this one."""
    past = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(past), F.lit(0))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: (conv_id, length) of every rebuilt conversation; its turns as (conv_id, length, pos from 1, digest, n_bytes)."""
    turns = written(_turns(conversations))
    chunks = turns.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED))
    own = chunks.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumns({"shared": shared, "base_id": F.col("conv_id") - F.col("conv_id") % FAMILY})
    sizes = own.select(F.col("conv_id").alias("base_id"), F.col("n_own").alias("n_base"))
    taken = F.least("shared", F.coalesce("n_base", F.lit(0)))
    whole = written(own.join(sizes, "base_id", "left").select("conv_id", "base_id", "shared", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("shared"), F.lit(0))).alias("length")))

    placed = chunks.withColumn("ahead", _before(F.col("n"), "chunk")).select("conv_id", "chunk", "ahead").join(whole.select("conv_id", "shared", "taken", "length"), "conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    ranked = written(turns.withColumn("nth", nth).join(placed, ["conv_id", "chunk"]).select("conv_id", "shared", "taken", "length", (F.col("ahead") + F.col("nth")).alias("rank"), "digest", "n_bytes"))
    kept = ranked.filter("rank > shared").select("conv_id", "length", (F.col("rank") - F.col("shared") + F.col("taken")).alias("pos"), "digest", "n_bytes")
    first = ranked.filter(F.col("rank") < SHARED).select(F.col("conv_id").alias("base_id"), F.col("rank").alias("pos"), "digest", "n_bytes")
    lent = whole.select("conv_id", "length", "base_id", "taken").join(first, "base_id").filter("pos <= taken").select("conv_id", "length", "pos", "digest", "n_bytes")
    return whole.select("conv_id", "length"), kept.unionByName(lent)


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def prefixes(whole: DataFrame, turns: DataFrame) -> DataFrame:
    """id and parent (null: none) of each prefix, its conv_id, depth, n_bytes of its last text, and whether the conversation ends with it."""
    low, high = F.lit(0xFFFFFFFF), lambda c: F.shiftrightunsigned(c, 32)
    h, g = F.xxhash64(F.lit(1), "pos", "digest"), F.xxhash64(F.lit(2), "pos", "digest")
    terms = dict(zip(_SUMS, (h.bitwiseAND(low), high(h), g.bitwiseAND(low), high(g)), strict=True))
    rows = written(turns.select("conv_id", "length", "pos", "n_bytes", F.shiftright("pos", CHUNK_BITS).alias("chunk"), *[t.alias(s) for s, t in terms.items()]))
    sums = rows.groupBy("conv_id", "chunk").agg(*[F.sum(s).alias(s) for s in _SUMS])
    ahead = sums.select("conv_id", "chunk", *[_before(F.col(s), "chunk").alias("ahead_" + s) for s in _SUMS])
    so_far = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("*", *[F.sum(s).over(so_far).alias("run_" + s) for s in _SUMS]).join(ahead, ["conv_id", "chunk"])
    here = [F.col("ahead_" + s) + F.col("run_" + s) for s in _SUMS]
    above = [x - F.col(s) for x, s in zip(here, _SUMS, strict=True)]
    found = run.select(_name(F.col("pos"), here).alias("id"), _name(F.col("pos") - 1, above).alias("parent"), "conv_id", F.col("pos").alias("depth"), "n_bytes", (F.col("pos") == F.col("length")).alias("ends"))
    root = whole.select(_name(F.lit(0), [F.lit(0)] * 4).alias("id"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("n_bytes"), (F.col("length") == 0).alias("ends"))
    return found.unionByName(root)


def ends(found: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes at which conversations end."""
    runs = found.filter("ends").groupBy("id", F.shiftright("conv_id", RUN_BITS).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, sha = None, None
        for batch in batches:
            names, shas = [], []
            for name, ids in zip(batch["id"], batch["ids"], strict=True):
                if name != node:
                    if node is not None:
                        names.append(node)
                        shas.append(sha.hexdigest())
                    node, sha = name, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame({"id": names, "ends_sha256": shas})
        if node is not None:
            yield pd.DataFrame({"id": [node], "ends_sha256": [sha.hexdigest()]})

    return runs.repartition("id").sortWithinPartitions("id", "run").mapInPandas(digest, "id binary, ends_sha256 string")


def _doubled(hops: DataFrame, values: list[str]) -> DataFrame:
    """Every pointer, and the sum along it, goes on by the pointer of where it stands, if that has one."""
    ahead = hops.select(F.col("id").alias("to"), F.col("to").alias("further"), *[F.col(v).alias("_" + v) for v in values])
    return hops.join(ahead, "to", "left").select("id", "top", F.coalesce("further", "to").alias("to"), *[(F.col(v) + F.coalesce("_" + v, F.lit(0))).alias(v) for v in values], F.col("further").isNotNull().alias("moved"))


def _chains(live: DataFrame, values: list[str]) -> DataFrame:
    """(id, to, values, top) of all nodes with a single child: the end of the chain below and the sum down to it;
    ``top`` if no such node is above."""
    single = live.filter("kids = 1 and parent is not null").select("id", *values)
    child = live.select(F.col("parent").alias("id"), F.col("id").alias("to"), *[F.col("add_" + v).alias("_" + v) for v in values])
    hops = single.join(child, "id").select("id", "to", *[(F.col(v) + F.col("_" + v)).alias(v) for v in values])
    below = hops.select(F.col("to").alias("id"), F.lit(False).alias("top"))
    hops = written(hops.join(below, "id", "left").withColumn("top", F.coalesce("top", F.lit(True))))
    while True:
        hops = written(_doubled(_doubled(hops, values), values))
        if hops.filter("moved").isEmpty():
            return hops.drop("moved")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``id`` and, under the names of ``values``, their sums over the subtree of each of ``nodes`` (id, parent, values).

    ``nodes`` is a forest: parents are nodes or null.  Values are whole numbers.
    """
    kids = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("kids")).withColumnRenamed("parent", "id")
    live = nodes.join(kids, "id", "left").select("id", "parent", *values, *[F.lit(0).cast("bigint").alias("add_" + v) for v in values], F.coalesce("kids", F.lit(0)).alias("kids"))
    live, known, chains = written(live), None, []
    while not live.isEmpty():
        if not live.filter("kids = 1 and parent is not null").isEmpty():
            chain = _chains(live, values)
            chains.append(chain.drop("top"))
            # a chain's end takes the place of its top; the sum of the chain, its end's own edge included, is on the edge above
            tops = chain.filter("top").join(live.select("id", F.col("parent").alias("over"), *[F.col("add_" + v).alias("_" + v) for v in values]), "id")
            moved = tops.select(F.col("to").alias("id"), "over", *[(F.col(v) + F.col("_" + v)).alias("_" + v) for v in values])
            edge = {"add_" + v: F.coalesce("_" + v, "add_" + v) for v in values}
            live = written(live.filter("kids <> 1 or parent is null").join(moved, "id", "left").withColumns({"parent": F.coalesce("over", "parent"), **edge}).drop("over", *["_" + v for v in values]))
        raked = live.filter("kids = 0").select("id", *values)
        known = raked if known is None else known.unionByName(raked)
        gains = live.filter("kids = 0 and parent is not null").groupBy("parent").agg(F.count("*").alias("gone"), *[F.sum(F.col(v) + F.col("add_" + v)).alias("_" + v) for v in values]).withColumnRenamed("parent", "id")
        sums = [(F.col(v) + F.coalesce("_" + v, F.lit(0))).alias(v) for v in values]
        live = written(live.filter("kids > 0").join(gains, "id", "left").select("id", "parent", *sums, *["add_" + v for v in values], (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids")))
    if known is None:
        return nodes.select("id", *values)
    for chain in reversed(chains):
        known = written(known)
        below = known.select(F.col("id").alias("to"), *[F.col(v).alias("_" + v) for v in values])
        known = known.unionByName(chain.join(below, "to").select("id", *[(F.col(v) + F.col("_" + v)).alias(v) for v in values]))
    return known


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the rebuilt conversations' trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256."""
    found = written(prefixes(*rebuilt(conversations)))
    nodes = found.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("parent", "depth", "n_bytes")])
    children = nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "id")
    nodes = written(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select("id", "parent", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(subtree_totals(own, ["n_leaves", "saved_tokens"]), "id").join(ends(found), "id", "left").join(above, "parent", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
