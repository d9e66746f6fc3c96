"""Vector rows as numpy blocks, shared by the two vector searches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows with an id and a vector without null, NaN or
    infinite components. Of rows sharing an id the smallest vector counts, so repeated rows
    are one candidate."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x) == F.lit(float("inf"))))
    return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
            .groupBy(F.col(id_col).cast("long").alias("vec_id"))
            .agg(F.min(F.col(vec_col).cast("array<double>")).alias("v")))


def padded(df: DataFrame, dim: int) -> DataFrame:
    """Vectors shorter than ``dim`` are filled with zeros, which change no inner product."""
    return df.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim)
                                                           - F.size("v"))))


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's array<double> column as rows of a matrix."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype="<i8")
    v = np.frombuffer(vectors, dtype="<f8")
    return i, v.reshape(len(i), -1)


def block_rows(df: DataFrame, key: str, rows: int, dim: int) -> DataFrame:
    """Pack consecutive rows of equal ``key`` (int) into ``(key, ids, vectors)`` blocks of at
    most ``rows`` rows. Rows must already be sorted by the key inside their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(k, ids, vecs):
            return pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                 pa.array([np.concatenate(vecs).tobytes()], pa.binary())],
                names=[key, "ids", "vectors"])

        at, ids, vecs, held = None, [], [], 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            i = batch.column(1).to_numpy(zero_copy_only=False).astype("<i8")
            v = matrix(batch.column(2), dim)
            lo = 0
            while lo < len(keys):
                if held and (keys[lo] != at or held >= rows):
                    yield block(at, ids, vecs)
                    ids, vecs, held = [], [], 0
                at = int(keys[lo])
                change = np.flatnonzero(keys[lo:] != at)
                hi = min(lo + (int(change[0]) if len(change) else len(keys) - lo),
                         lo + rows - held)
                ids.append(i[lo:hi])
                vecs.append(v[lo:hi])
                held += hi - lo
                lo = hi
        if held:
            yield block(at, ids, vecs)

    return (df.select(F.col(key).cast("int").alias(key), "vec_id", "v")
            .mapInArrow(run, f"{key} int, ids binary, vectors binary"))


def best_of(rows: DataFrame, k: int) -> DataFrame:
    """Per query the ``k`` highest scores, ties to the smaller id, with their rank from 1.

    Spark cuts each task's rows to k a query before the shuffle (a limit on row_number).
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
