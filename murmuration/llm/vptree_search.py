"""Approximate nearest neighbours by inner product: a vantage-point tree per shard.

As in the pivot index, one added component turns largest inner product into nearest distance.
Vectors are dealt to shards of a bounded number of rows by a hash of their id, and each shard
becomes one tree: a node takes one of its vectors as vantage point and splits the others at the
median distance, down to leaves. A search goes to the nearer side first and to the other only
if its distance bound is within ``radius / factor`` of the query, ``radius`` being the k-th
distance so far. With factor 1 that is the triangle inequality and the search is exact; a
larger factor skips more and may miss neighbours.

Blocks of queries meet every shard's tree in a join on the shard number and walk it together,
as numpy rows. Every vector is indexed. Vectors that are null, empty, zero or hold null or
non-finite components, and rows without an id, take no part; shorter vectors are padded with
zeros; rows sharing an id count once (repeated rows with them). Equal scores are ranked by the
smaller id. Columns other than the id and the vector do not take part, whatever their names, and
texts are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import written
from murmuration.llm.vectors import (best_of, block_rows, finite_vectors, padded, squared_norm,
                                     unpack)

MIN_SHARDS, SHARD_ROWS, QUERY_ROWS = 8, 16384, 256
LEAVES, LEAF_ROWS, MIN_LEAF_ROWS = 16, 512, 16     # a tree's leaves, and their bounds
FACTOR = 4.0      # recall of the 20 nearest at least 0.99 in tests; 1 is exact
NODE = 7      # columns of a node: begin, end, vantage, inner child, outer child, inner max, outer min


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row, always summed alike: equal vectors get equal scores, which a
    matrix product does not promise."""
    return np.einsum("ij,ij->i", np.ascontiguousarray(q), np.ascontiguousarray(v))


@dataclass
class VPTree:
    ids: np.ndarray
    vectors: np.ndarray
    nodes: np.ndarray
    top: float
    scanned: int = 0        # pairs of query and vector met in leaves

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, top: float,
              leaf: int | None = None, seed: int = 0) -> VPTree:
        leaf = leaf or min(LEAF_ROWS, max(MIN_LEAF_ROWS, len(ids) // LEAVES))
        lifted = np.column_stack(
            [vectors, np.sqrt(np.maximum(top - (vectors * vectors).sum(1), 0))])
        order = np.argsort(ids, kind="stable")
        rng = np.random.default_rng(seed)
        nodes: list[list[float]] = [[0, len(ids), -1, -1, -1, 0, 0]]
        todo = [0]
        while todo:
            at = todo.pop()
            a, b = int(nodes[at][0]), int(nodes[at][1])
            if b - a <= leaf:
                order[a:b] = np.sort(order[a:b])
                continue
            vantage = int(order[a + rng.integers(b - a)])
            d = np.sqrt(((lifted[order[a:b]] - lifted[vantage]) ** 2).sum(1))
            by = np.argsort(d, kind="stable")
            order[a:b], d = order[a:b][by], d[by]
            mid = (b - a) // 2
            nodes[at][2:] = [vantage, len(nodes), len(nodes) + 1, d[mid - 1], d[mid]]
            todo += [len(nodes), len(nodes) + 1]
            nodes += [[a, a + mid, -1, -1, -1, 0, 0], [a + mid, b, -1, -1, -1, 0, 0]]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        table = np.array(nodes, dtype=np.float64)
        inner = table[:, 2] >= 0
        table[inner, 2] = place[table[inner, 2].astype(int)]
        return cls(ids[order], vectors[order], table, top)

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float
               ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of each query; missing ones score -inf."""
        best = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), np.iinfo(np.int64).max)
        q2 = (q * q).sum(1)
        n2 = (self.vectors * self.vectors).sum(1)
        slack = 1e-9 * (1 + np.sqrt(self.top))

        def radius(at: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(q2[at] + self.top - 2 * best[at, -1], 0)) / factor + slack

        def visit(node: int, at: np.ndarray) -> None:
            if not len(at):
                return
            a, b, vantage, near, far = self.nodes[node, :5].astype(int)
            if vantage < 0:
                self.scanned += len(at) * (b - a)
                rough = q[at] @ self.vectors[a:b].T
                rough[query_ids[at][:, None] == self.ids[a:b][None]] = -np.inf
                may = rough >= best[at, -1][:, None] - slack * np.sqrt(q2[at])[:, None]
                may &= rough > -np.inf
                better = may.any(1)
                at, may = at[better], may[better]
                r, c = np.nonzero(may)
                s = np.full(may.shape, -np.inf)
                s[r, c] = exact_products(q[at[r]], self.vectors[a + c])
                ids = np.concatenate([who[at], np.broadcast_to(self.ids[a:b], s.shape)], 1)
                s = np.concatenate([best[at], s], 1)
                by = np.argsort(ids, axis=1, kind="stable")
                ids, s = np.take_along_axis(ids, by, 1), np.take_along_axis(s, by, 1)
                by = np.argsort(-s, axis=1, kind="stable")[:, :k]
                who[at], best[at] = np.take_along_axis(ids, by, 1), np.take_along_axis(s, by, 1)
                return
            inner_max, outer_min = self.nodes[node, 5:]
            v = self.vectors[vantage]
            # the added component of a query is 0, that of v is sqrt(M - |v|^2)
            d = np.sqrt(np.maximum(q2[at] + n2[vantage] - 2 * (q[at] @ v), 0)
                        + max(self.top - n2[vantage], 0))
            inward = d <= (inner_max + outer_min) / 2
            visit(near, at[inward])
            visit(far, at[~inward])
            m = inward & (outer_min - d <= radius(at))
            visit(far, at[m])
            m = ~inward & (d - inner_max <= radius(at))
            visit(near, at[m])

        visit(0, np.arange(len(q)))
        return who, best


def _build_shard(top: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["vec_id"].to_numpy(np.int64)
        by = np.argsort(ids, kind="stable")
        tree = VPTree.build(ids[by], np.stack(group["v"].to_numpy())[by].astype(np.float64), top)
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])],
                             "ids": [tree.ids.astype("<i8").tobytes()],
                             "vectors": [tree.vectors.astype("<f8").tobytes()],
                             "nodes": [tree.nodes.astype("<f8").tobytes()]})

    return run


def _search(pairs: DataFrame, k: int, factor: float, top: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids, v = unpack(x["ids"], x["vectors"])
                nodes = np.frombuffer(x["nodes"], dtype="<f8").reshape(-1, NODE)
                qi, q = unpack(x["q_ids"], x["q_vectors"])
                who, best = VPTree(ids, v, nodes, top).search(qi, q, k, factor)
                r, c = np.nonzero(best > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi[r], pa.int64()), pa.array(who[r, c], pa.int64()),
                     pa.array(best[r, c], pa.float64())], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR,
            id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, min_shards: int = MIN_SHARDS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest found.

    ``is_query`` is a condition on ``vec_id``; ``factor`` 1 is exact. There are ``min_shards``
    trees, or more once they would be larger than ``shard_rows``.
    """
    spark = df.sparkSession
    if factor < 1:
        raise ValueError("factor must be 1 or more")
    vectors = written(finite_vectors(df, id_col, vec_col)
                      .where(F.exists("v", lambda x: x != 0)))
    dim, n, top = vectors.agg(F.max(F.size("v")), F.count(F.lit(1)),
                              F.max(squared_norm(F.col("v")))).first()
    if not n:
        return best_of(spark.createDataFrame([], "query_id long, vec_id long, score double"), k)
    vectors = padded(vectors, dim)
    shards = max(min_shards, -(-n // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    trees = written(dealt.groupBy("shard").applyInPandas(
        _build_shard(top), "shard int, ids binary, vectors binary, nodes binary"))
    asked = vectors.where(is_query).withColumn("block", F.lit(0))
    blocks = block_rows(asked.repartitionByRange("vec_id"), "block", QUERY_ROWS, dim)
    asks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                         F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    return best_of(_search(asks.join(trees, "shard"), k, factor, top), k)
