"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into segments and indexed by each. A query looks up its segments' values within a radius
that grows by one segment at a time: once radius a is done for segments 0 to j and a - 1 for the others, every
code within distance m * a + j is verified, as any other differs by a + 1 bits in each of the former and
a bits in each of the latter. A query ends when its k-th verified distance is covered.

Equal codes are searched once. Distinct codes are dealt in blocks of ``block_codes``, distinct query codes
in blocks too; a task holds one block of each, with the index over its own codes, and its k
nearest are merged per query. Ties go to the smaller id.

Rows without a code are no neighbours, queries without a code or id get no rows; with fewer
than k rows all come back. Repeated ids are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnrisk.sources.scratch import materialise

BITS = 64


def sign_codes(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds ``code``: bit i is 1 if component i (of at most 64) is above zero; NaN and null are not."""
    bits = f"transform({vector}, (x, i) -> if(x > 0 and not isnan(x), shiftleft(1L, i), 0L))"
    checked = f"if(size({vector}) > {BITS}, raise_error('codes have 64 bits'), {bits})"
    return rows.withColumn("code", F.expr(f"if({vector} is null, null, aggregate({checked}, 0L, (a, b) -> a | b))"))


class Index:
    """Codes by the values of each segment; of equal distances the code that comes first is nearer."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        m = max(4, min(8, round(BITS / max(1.0, math.log2(max(2, len(codes)))))))  # about one code per value
        cuts = [i * BITS // m for i in range(m + 1)]
        self.parts = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.order, self.offsets = [], []
        for a, bits in self.parts:
            value = self.segment(codes, a, bits)
            self.order.append(np.argsort(value, kind="stable"))
            self.offsets.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << bits))]))

    @staticmethod
    def segment(codes: np.ndarray, first: int, bits: int) -> np.ndarray:
        return ((codes >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance) as places in ``queries`` and in the codes, k nearest of each query."""
        k = min(k, len(self.codes))
        none = np.iinfo(np.int64).max
        best = np.full((len(queries), k), none)  # distance * 2^40 + place, ascending
        open_ = np.arange(len(queries))
        m = len(self.parts)
        for radius in range(max(bits for _, bits in self.parts) + 1):
            for j, (first, bits) in enumerate(self.parts):
                if not len(open_):
                    break
                flips = np.array([sum(1 << b for b in c) for c in combinations(range(bits), radius)], np.int64)
                if len(flips):
                    step = max(1, (1 << 20) // len(flips))
                    for i in range(0, len(open_), step):
                        self._verify(queries, open_[i : i + step], j, first, bits, flips, best)
                covered = m * radius + j
                open_ = open_[(best[open_, -1] == none) | (best[open_, -1] >> 40 > covered)]
        at = np.repeat(np.arange(len(queries)), k)
        return at, best.ravel() & ((1 << 40) - 1), best.ravel() >> 40

    def _verify(self, queries: np.ndarray, open_: np.ndarray, j: int, first: int, bits: int, flips: np.ndarray, best: np.ndarray) -> None:
        values = (self.segment(queries[open_], first, bits)[:, None] ^ flips[None, :]).ravel()
        starts = self.offsets[j][values]
        sizes = self.offsets[j][values + 1] - starts
        total = np.cumsum(sizes)
        if not len(total) or not total[-1]:
            return
        found = self.order[j][np.repeat(starts - total + sizes, sizes) + np.arange(total[-1])]
        asks = np.repeat(np.repeat(np.arange(len(open_)), len(flips)), sizes)
        distance = np.bitwise_count(self.codes[found] ^ queries[open_][asks]).astype(np.int64)
        key = (distance << 40) | found
        near = key < best[open_, -1][asks]
        if not near.any():
            return
        asks, key = asks[near], key[near]
        touched = np.unique(asks)
        held = best[open_[touched]]
        asks = np.concatenate([asks, np.repeat(touched, held.shape[1])])
        key = np.concatenate([key, held.ravel()])
        order = np.lexsort((key, asks))
        asks, key = asks[order], key[order]
        new = np.concatenate([[True], (asks[1:] != asks[:-1]) | (key[1:] != key[:-1]) | (key[1:] == np.iinfo(np.int64).max)])
        asks, key = asks[new], key[new]
        heads = np.searchsorted(asks, touched)
        nth = np.arange(len(asks)) - heads[np.searchsorted(touched, asks)]
        take = nth < best.shape[1]
        best[open_[asks[take]], nth[take]] = key[take]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, block_codes: int = 1 << 20, block_queries: int = 1 << 16) -> DataFrame:
    """(query_id, rank, id, distance): of each query (id, code) the ``k`` nearest of ``rows`` (id, code)."""
    rows = rows.select(F.col("id").cast("bigint").alias("id"), "code").filter("code is not null and id is not null")
    asked = queries.select(F.col("id").cast("bigint").alias("query_id"), "code").filter("code is not null and id is not null")
    # at most k ids of a code can be among the nearest
    nth = F.row_number().over(W.partitionBy("code").orderBy("id"))
    members = materialise(rows.withColumn("nth", nth).filter(F.col("nth") <= k), "members")
    codes = members.filter("nth = 1").select("code", F.col("id").alias("first_id"))
    wanted = materialise(asked.select("code").distinct(), "wanted")
    n, n_queries = codes.count(), wanted.count()
    code_blocks = max(1, -(-n // block_codes))
    query_blocks = max(1, -(-n_queries // block_queries), min(16, -(-n_queries // 128)))

    def block(name: str, count: int):
        return F.pmod(F.xxhash64(F.col(name)), F.lit(count)).cast("int")

    schema = "a int, b int, code bigint, first_id bigint, query boolean"
    dealt = codes.select(block("code", code_blocks).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("b"), "code", "first_id", F.lit(False).alias("query"))
    asks = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1))).alias("a"), block("code", query_blocks).alias("b"), "code", F.lit(0).cast("bigint").alias("first_id"), F.lit(True).alias("query"))

    def search(cell: pd.DataFrame) -> pd.DataFrame:
        own = cell[~cell["query"]].sort_values(["first_id", "code"])
        code, ask = own["code"].to_numpy().view(np.uint64), cell.loc[cell["query"], "code"].to_numpy().view(np.uint64)
        if not len(code) or not len(ask):
            return pd.DataFrame({"query_code": [], "code": [], "first_id": [], "distance": []}).astype("int64")
        q, at, distance = Index(code).search(ask, k)
        return pd.DataFrame({"query_code": ask[q].view(np.int64), "code": code[at].view(np.int64), "first_id": own["first_id"].to_numpy()[at], "distance": distance})

    assert dealt.schema.simpleString() == asks.schema.simpleString(), schema
    found = dealt.unionAll(asks).groupBy("a", "b").applyInPandas(search, "query_code bigint, code bigint, first_id bigint, distance bigint")
    by_code = F.row_number().over(W.partitionBy("query_code").orderBy("distance", "first_id", "code"))
    found = found.withColumn("_r", by_code).filter(F.col("_r") <= k).drop("_r", "first_id")
    by_id = F.row_number().over(W.partitionBy("query_code").orderBy("distance", "id", "nth"))
    ranked = found.join(members, "code").withColumn("rank", by_id).filter(F.col("rank") <= k)
    ranked = ranked.select(F.col("query_code").alias("code"), "rank", "id", F.col("distance").cast("int").alias("distance"))
    return asked.join(ranked, "code").select("query_id", "rank", "id", "distance")
