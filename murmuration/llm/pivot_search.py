"""Exact top-k inner-product search with a pivot-distance index.

Largest inner product is made nearest distance: each vector v gets one more component,
sqrt(M - |v|^2) with M the largest squared norm, and a query gets 0 there, so that
|q' - v'|^2 = |q|^2 + M - 2 q.v. Vectors are keyed by their nearest pivot and their distance to
it; a pivot's vectors are cut into rings (annuli) at distance quantiles and stored sorted, in
blocks of bounded size, so a ring of any number of equal vectors is just many blocks.

A query first searches its own annulus, which gives a bound on its k-th distance. Then it goes
to every annulus that the bound cannot rule out: by the triangle inequality no vector of an
annulus is nearer than the gap between the query's distance to the pivot and the annulus's
distance range, nor than half the query's extra distance over its nearest pivot. Nothing else
is skipped, so the result is exact; scores are integers, computed exactly.

Pivots come from a bounded sample (``PIVOT_SAMPLE`` rows of smallest id hash); every vector is
indexed. Vectors that are null or hold null or non-finite components, and rows without an id,
take no part; shorter vectors are padded with zeros; rows sharing an id count once. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import written
from murmuration.llm.vectors import (best_of, block_rows, finite_vectors, matrix, padded,
                                     squared_norm, unpack)

PIVOTS, PIVOT_SAMPLE, RINGS = 16, 256, 8
BLOCK_ROWS, QUERY_ROWS = 2048, 256
EXACT = float(1 << 53)          # products summed below this are exact in doubles


def quantised(v: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) per component, as doubles (from 2^52 on a double is an integer)."""

    def one(x: Column) -> Column:
        y = x * F.lit(scale)
        return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(v, one)


@dataclass
class PivotIndex:
    dim: int
    top: float                  # M
    pivots: np.ndarray
    annuli: np.ndarray          # rows of (annulus, pivot, least distance, largest distance)

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        """Distances of rows to the pivots in the space with the added component."""
        n2, p2 = (v * v).sum(1), (self.pivots * self.pivots).sum(1)
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.top - n2, 0))
        lift = extra[:, None] - np.sqrt(np.maximum(self.top - p2, 0))[None]
        return np.sqrt(np.maximum(n2[:, None] + p2 - 2 * v @ self.pivots.T, 0) + lift * lift)

    def visits(self, v: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Queries x annuli: True where the annulus may hold a vector of score ``kth`` or more."""
        d = self.distances(v, True)
        p = self.annuli[:, 1].astype(int)
        gap = np.maximum(d[:, p] - self.annuli[:, 3], self.annuli[:, 2] - d[:, p])
        gap = np.maximum(gap, (d[:, p] - d.min(1, keepdims=True)) / 2)
        radius = np.sqrt(np.maximum((v * v).sum(1) + self.top - 2 * kth, 0))
        slack = 1e-6 * (1 + np.sqrt(self.top))
        if self.top >= EXACT:
            return np.ones(gap.shape, bool)
        return gap <= radius[:, None] + slack


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of distinct rows."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def inner_products(q: np.ndarray, v: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products, exact: in doubles while they fit, else in Python integers
    (results beyond a long stop at its ends)."""
    if top < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = whole(q).dot(whole(v).T)
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _keyed(rows: DataFrame, index: PivotIndex) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = index.distances(matrix(batch.column(1), index.dim), False)
            at = d.argmin(1) if len(d) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(at, pa.int32()),
                 pa.array(d[np.arange(len(d)), at], pa.float64())],
                names=["vec_id", "v", "pivot", "dist"])

    return rows.select("vec_id", "v").mapInArrow(
        run, "vec_id long, v array<double>, pivot int, dist double")


def build(vectors: DataFrame) -> tuple[PivotIndex, DataFrame]:
    """The index and its rows ``(vec_id, v, pivot, dist, annulus)``; v must be of one length."""
    dim, top = vectors.agg(F.max(F.size("v")), F.max(squared_norm(F.col("v")))).first()
    sample = (vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE)
              .select("v").collect())
    pivots = spread_pivots(np.array([r["v"] for r in sample], dtype=np.float64), PIVOTS)
    index = PivotIndex(dim, top, pivots, np.zeros((0, 4)))
    keyed = written(_keyed(vectors, index))
    share = [k / RINGS for k in range(1, RINGS)]
    # at most PIVOTS rows of RINGS cuts, then PIVOTS * RINGS rows of bounds
    cuts = {r["pivot"]: r["cuts"] for r in keyed.groupBy("pivot").agg(
        F.percentile_approx("dist", share, 1000).alias("cuts")).collect()}
    table = F.array(*[F.array(*[F.lit(float(c)) for c in cuts.get(p, [0.0] * len(share))])
                      for p in range(len(pivots))])
    ring = F.size(F.filter(F.element_at(table, F.col("pivot") + 1),
                           lambda c: c < F.col("dist")))
    keyed = keyed.withColumn("annulus", (F.col("pivot") * RINGS + ring).cast("int"))
    bounds = keyed.groupBy("annulus").agg(F.first("pivot"), F.min("dist"), F.max("dist")).collect()
    index.annuli = np.array(sorted(tuple(r) for r in bounds), dtype=np.float64)
    return index, keyed


def _seed_bounds(pairs: DataFrame, k: int, top: float) -> DataFrame:
    """(query_id, kth): k-th best score of each query within one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                qi, q = unpack(x["q_ids"], x["q_vectors"])
                vi, v = unpack(x["ids"], x["vectors"])
                if len(vi) <= k:
                    continue
                s = inner_products(q, v, top).astype(np.float64)
                s[qi[:, None] == vi[None]] = -np.inf
                kth = np.partition(s, len(vi) - k, axis=1)[:, len(vi) - k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi, pa.int64()), pa.array(kth, pa.float64())],
                    names=["query_id", "kth"])

    return (pairs.mapInArrow(run, "query_id long, kth double").groupBy("query_id")
            .agg(F.max("kth").alias("kth")))


def _visits(queries: DataFrame, index: PivotIndex) -> DataFrame:
    """(annulus, q_ids, q_vectors, q_kth): the queries that must visit each annulus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(lo, QUERY_ROWS)
                ids = batch.column(0).to_numpy().astype("<i8")
                q = matrix(batch.column(1), index.dim)
                kth = batch.column(2).to_numpy(zero_copy_only=False)
                go = index.visits(q, kth)
                for a in np.flatnonzero(go.any(0)):
                    m = go[:, a]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(index.annuli[a, 0])], pa.int32()),
                         pa.array([ids[m].tobytes()]), pa.array([q[m].tobytes()]),
                         pa.array([kth[m].tobytes()])],
                        names=["annulus", "q_ids", "q_vectors", "q_kth"])

    return queries.select("vec_id", "v", "kth").mapInArrow(
        run, "annulus int, q_ids binary, q_vectors binary, q_kth binary")


def _search(pairs: DataFrame, k: int, top: float) -> DataFrame:
    """(query_id, vec_id, score): of each query and block, up to k scores not below its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                qi, q = unpack(x["q_ids"], x["q_vectors"])
                vi, v = unpack(x["ids"], x["vectors"])
                s = inner_products(q, v, top)
                bound = np.frombuffer(x["q_kth"], dtype="<f8")
                r, c = np.nonzero((s >= bound[:, None]) & (qi[:, None] != vi[None]))
                order = np.lexsort((vi[c], -s[r, c].astype(object) if top >= EXACT
                                    else -s[r, c], r))
                r, c = r[order], c[order]
                first = np.searchsorted(r, r)
                keep = np.arange(len(r)) - first < k
                r, c = r[keep], c[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi[r], pa.int64()), pa.array(vi[c], pa.int64()),
                     pa.array(s[r, c], pa.int64())], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k largest integer inner products.

    ``is_query`` is a condition on ``vec_id``.
    """
    spark = df.sparkSession
    vectors = written(finite_vectors(df, id_col, vec_col))
    dim, n = vectors.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not n or not dim:     # no vectors, or only empty ones: every score is 0
        zero = spark.createDataFrame([], "query_id long, vec_id long, score long")
        return best_of(zero, k) if not n else best_of(_all_zero(vectors, is_query, k), k)
    vectors = padded(vectors, dim).withColumn("v", quantised(F.col("v"), scale))
    index, keyed = build(vectors)
    parts = max(1, -(-n // (4 * BLOCK_ROWS)))
    ordered = keyed.repartitionByRange(parts, "annulus", "dist", "vec_id") \
        .sortWithinPartitions("annulus", "dist", "vec_id")
    blocks = written(block_rows(ordered, "annulus", BLOCK_ROWS, dim))
    asked = keyed.where(is_query)
    homes = block_rows(asked.repartitionByRange("annulus", "dist", "vec_id")
                       .sortWithinPartitions("annulus", "dist", "vec_id"),
                       "annulus", QUERY_ROWS, dim)
    homes = homes.select("annulus", F.col("ids").alias("q_ids"), F.col("vectors")
                         .alias("q_vectors"))
    bounds = _seed_bounds(homes.join(blocks, "annulus"), k, index.top)
    known = (asked.join(bounds, asked["vec_id"] == bounds["query_id"], "left")
             .withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))))
    found = _search(_visits(known, index).join(blocks, "annulus"), k, index.top)
    return best_of(found, k)


def _all_zero(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """Only empty vectors: every candidate scores 0, so the k + 1 smallest ids decide."""
    least = vectors.select("vec_id").orderBy("vec_id").limit(k + 1)
    asked = vectors.where(is_query).select(F.col("vec_id").alias("query_id"))
    return (asked.join(F.broadcast(least), F.col("query_id") != F.col("vec_id"))
            .withColumn("score", F.lit(0).cast("long")))


def oracle(k: int = 5, every: int = 50, scale: int = 256) -> str:
    """DuckDB SQL with the same result over ``embeddings`` of one dimension and unique ids."""
    return f"""
    WITH q AS (SELECT vec_id, list_transform(embedding,
                 lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id,
            list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
          FROM q a JOIN q b ON a.vec_id % {every} = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
          FROM s)
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {k}"""
