"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are quantised to whole numbers and dealt into blocks of bounded size; every block of
queries meets every block of vectors in one task, and the best of each meeting are merged for each
query.  In a block, one list for each dimension holds the block's vectors in the order of their
component.  A query reads its lists from the end that raises its score, all to the same depth; each
vector met gets its whole score by random access.  What no list has shown yet scores at most the sum
of the values at the lists' fronts, and reading stops when that bound is below the k-th best score
so far; an equal bound reads on, as ties go to the smaller id.

Vectors that are null or hold a null or non-finite component, and rows without an id, take no part;
finite components of any size do (beyond 2**53 as Python integers).  A score beyond the range of a
long comes out as the nearest long, before scores are compared.  A query is compared with vectors of
its own length; an empty vector scores 0 against every other empty one.  Rows that repeat an id
count once, with the smallest vector.  Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The scale is a power of two, so that steps of 1 / scale are exact doubles.
K, SCALE, EVERY = 20, 64, 20
BLOCK, QUERY_BLOCK = 8192, 4096
_EXACT = 2**53
_LEAST, _MOST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, scale: int = SCALE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and floor(scale * component) / scale, components as doubles; only what takes part.

    Doubles from 2**53 steps on are whole numbers of steps as they are."""
    parts = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), parts.alias("_v")).filter(F.col("vec_id").isNotNull() & F.col("_v").isNotNull())
    rows = rows.filter(~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    step = lambda x: F.when(F.abs(x) < _EXACT / scale, F.floor(x * scale).cast("double") / scale).otherwise(x)
    return rows.select("vec_id", F.transform("_v", step).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Steps of 1 / scale as integers: of 64 bits, or of Python if some are larger than doubles hold exactly."""
    if np.abs(vectors).max(initial=0) < _EXACT / scale:
        return (vectors * scale).astype(np.int64)
    out = np.empty(vectors.shape, object)
    out.ravel()[:] = [int(x) * scale if abs(x) >= _EXACT else int(x * scale) for x in vectors.ravel().tolist()]
    return out


class Lists:
    """The sorted lists of one block of vectors of integers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids = ids[by_id]
        whole = vectors[by_id]
        # products and sums of doubles are exact below 2**53
        self.largest = int(np.abs(whole).max(initial=0))
        self.exact = self.largest**2 * max(1, whole.shape[1]) < _EXACT
        self.vectors = whole.astype(np.float64) if self.exact else whole.astype(object)
        self.order = np.ascontiguousarray(np.argsort(whole, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.take_along_axis(whole.T, self.order.astype(np.int64), axis=1)

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the k best of the block, and the depth that was read."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        exact = self.exact and int(np.abs(query).max(initial=0)) * self.largest * max(1, len(query)) < _EXACT
        held = (lambda x: x) if exact else lambda x: np.clip(x, _LEAST, _MOST)
        q = query.astype(np.float64) if exact else query.astype(object)
        seen = np.zeros(n, bool)
        own = np.searchsorted(self.ids, query_id)
        if own < n and self.ids[own] == query_id:
            seen[own] = True
        at = np.zeros(0, np.int64)
        scores = np.zeros(0, np.float64 if exact else object)
        depth, step = 0, max(16, n // 64)
        while True:
            to = min(n, depth + step)
            if len(up) + len(down):
                met = np.concatenate([self.order[up, n - to : n - depth].ravel(), self.order[down, depth:to].ravel()])
                fresh = np.zeros(n, bool)
                fresh[met] = True
                fresh &= ~seen
            else:
                fresh, to = ~seen, n
            seen |= fresh
            new = np.flatnonzero(fresh)
            at = np.concatenate([at, new])
            scores = np.concatenate([scores, held(self.vectors[new] @ q)])
            depth = to
            if len(at) > 4 * k:  # only the best so far matter; ties with the k-th stay
                floor = np.partition(scores, len(scores) - k)[len(scores) - k]
                stay = scores >= floor
                at, scores = at[stay], scores[stay]
            if depth == n:
                break
            if len(at) >= k:
                bound = held(q[up] @ self.values[up, n - depth].astype(q.dtype) + q[down] @ self.values[down, depth - 1].astype(q.dtype))
                if bound < np.partition(scores, len(scores) - k)[len(scores) - k]:
                    break
            step = max(step, n // 32)
        order = sorted(range(len(at)), key=lambda i: (-scores[i], at[i]))[:k] if not exact else np.lexsort((at, -scores))[:k]
        return scores[order], self.ids[at[order]], depth


def top_k(vectors: DataFrame, queries: Column, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best other rows.

    vectors: vec_id and v (array of doubles, whole steps of 1 / ``SCALE``), one row an id; queries:
    which rows ask.
    """
    rows = vectors.select("vec_id", "v", F.size("v").alias("dims"), queries.alias("asks"))
    n, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-asking // query_block))

    def dealt(df: DataFrame, parts: int, own: str, other: str, others: int, is_query: bool) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select("dims", "part", "query_part", F.lit(is_query).alias("is_query"), "vec_id", "v")

    meetings = dealt(rows, blocks, "part", "query_part", query_blocks, False).union(dealt(rows.filter("asks"), query_blocks, "query_part", "part", blocks, True))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["is_query"].to_numpy()
        data, queries_here = pdf[~asks], pdf[asks]
        found: list[tuple[int, int, int]] = []
        if len(data) and len(queries_here):
            lists = Lists(data["vec_id"].to_numpy(), whole_numbers(np.stack(data["v"].to_numpy())))
            for query_id, v in zip(queries_here["vec_id"].tolist(), queries_here["v"], strict=True):
                scores, ids, _ = lists.best(query_id, whole_numbers(np.asarray(v, np.float64)), k)
                found += [(query_id, int(i), int(s)) for s, i in zip(scores, ids, strict=True)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    local = meetings.groupBy("dims", "part", "query_part").applyInPandas(lambda pdf: meet(pdf), "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
