"""Pairs of vectors with a cosine of at least t, by sign random projections.

Each vector gets ``bands`` keys of ``bits`` signs of products with random planes. Two vectors at
angle a agree in a sign with probability 1 - a / pi, so the bands and bits decide how likely a pair
at the threshold meets in some band (``expected_recall``); pairs above it meet more surely. Inside
a bucket vectors are compared in blocks by NumPy products of 32-bit copies, and only pairs within
``MARGIN`` of t leave the task; these are then scored from the vectors themselves. So every row is
exact; what the bands miss is missing (recall is measured in the tests).

Equal vectors are one class, named by its smallest id, so that copies do not fill a bucket; the
pair table is between classes and ``vector_classes`` gives each vector's class. A crowded bucket is
cut into blocks, and pairs of blocks are dealt to tasks by (bucket, pair of blocks).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from murmuration.operators.semantic import DIGITS, as_matrix, unit_vectors
from murmuration.session import cut_lineage

BLOCK_ROWS = 256
RECALL = 0.95
MAX_BANDS = 32
MARGIN = 1e-5          # above what 32-bit products are off


def expected_recall(cosine: float, bands: int, bits: int) -> float:
    """Probability that two vectors of this cosine share a band."""
    agree = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return 1 - (1 - agree ** bits) ** bands


def bands_for(threshold: float, bits: int, recall: float = RECALL) -> int:
    """The fewest bands that bring a pair at the threshold together with this probability."""
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree ** bits)))


def bits_for(rows: int, threshold: float) -> int:
    """Signs a key needs for buckets of about a block, but no more than ``MAX_BANDS`` allow."""
    bits = max(4, math.ceil(math.log2(max(2.0, rows / BLOCK_ROWS))))
    while bits > 4 and bands_for(threshold, bits) > MAX_BANDS:
        bits -= 1
    return bits


def vector_classes(vectors: DataFrame, id_col: str = "vec_id",
                   vec_col: str = "embedding") -> DataFrame:
    """``(id, example)``: vectors equal after scaling to unit length share the ``example`` id."""
    unit = unit_vectors(vectors, id_col, vec_col)
    key = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")]
    keyed = cut_lineage(unit.select("id", *key))
    least = keyed.groupBy("h1", "h2").agg(F.min("id").alias("example"))
    return keyed.join(least, ["h1", "h2"]).select("id", "example")


@dataclass
class Meetings:
    """Distinct vectors (id, v, copies) and the pairs of blocks that share a bucket."""

    classes: DataFrame
    met: DataFrame        # band, a, x, ka, b, y, kb (ids, 32-bit vectors, band keys), same
    id_type: str
    dim: int


def meetings(vectors: DataFrame, threshold: float, id_col: str, vec_col: str, bits: int | None,
             bands: int | None, seed: int) -> Meetings:
    unit = cut_lineage(unit_vectors(vectors, id_col, vec_col))
    id_type = unit.schema["id"].dataType.simpleString()
    classes = cut_lineage(unit.groupBy(F.xxhash64("v").alias("h1"),
                                       F.xxhash64(F.lit(1), "v").alias("h2"))
                          .agg(F.min(F.struct("id", "v")).alias("m"),
                               F.count(F.lit(1)).alias("copies"))
                          .select("m.id", "m.v", "copies"))
    rows, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dim = dim or 1
    bits = bits or bits_for(rows, threshold)
    bands = bands or bands_for(threshold, bits)
    planes = np.random.default_rng(seed).normal(size=(dim, bands * bits))
    weight = 1 << np.arange(bits, dtype=np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                v = as_matrix(part.column(1), dim)
                key = (v @ planes > 0).reshape(part.num_rows, bands, bits) @ weight
                short = pa.array([x.tobytes() for x in v.astype("<f4")], pa.binary())
                every = pa.array([x.tobytes() for x in key.astype("<i4")], pa.binary())
                take = pa.array(np.repeat(np.arange(part.num_rows), bands))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(bands, dtype=np.int32), part.num_rows)),
                     pa.array(key.ravel()), part.column(0).take(take), short.take(take),
                     every.take(take)], names=["band", "key", "id", "v", "keys"])

    keyed = cut_lineage(classes.select("id", "v").mapInArrow(
        keys, f"band int, key long, id {id_type}, v binary, keys binary"))
    sizes = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    placed = (keyed.join(sizes, ["band", "key"])
              .withColumn("parts", parts)
              .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    blocks = cut_lineage(placed.groupBy("band", "key", "parts", "part").agg(
        F.collect_list(F.struct("id", "v", "keys")).alias("rows"))
        .select("band", "key", "parts", "part", F.col("rows.id").alias("ids"),
                F.col("rows.v").alias("vs"), F.col("rows.keys").alias("ks")))
    # a block meets itself and the blocks after it; each meeting is a join key of its own
    left = blocks.select("band", "key", F.explode(F.sequence(F.col("part"), F.col("parts") - 1))
                         .alias("other"), "part", F.col("ids").alias("a"), F.col("vs").alias("x"),
                         F.col("ks").alias("ka"))
    right = blocks.select("band", "key", F.explode(F.sequence(F.lit(0), F.col("part")))
                          .alias("part"), F.col("part").alias("other"),
                          F.col("ids").alias("b"), F.col("vs").alias("y"), F.col("ks").alias("kb"))
    met = left.join(right, ["band", "key", "part", "other"])
    return Meetings(classes, met.select("band", "a", "x", "ka", "b", "y", "kb",
                                        (F.col("part") == F.col("other")).alias("same")),
                    id_type, dim)


def _close(row: dict, dim: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a meeting with a 32-bit product of at least ``least``, and the products; a pair
    that shares an earlier band was met there and is left out."""
    v, w = (np.frombuffer(b"".join(row[c]), "<f4").reshape(-1, dim) for c in ("x", "y"))
    score = v @ w.T
    if row["same"]:
        score[np.tril_indices(len(score))] = -2
    i, j = np.nonzero(score >= least)
    ka, kb = (np.frombuffer(b"".join(row[c]), "<i4").reshape(len(row[c]), -1)
              for c in ("ka", "kb"))
    before = row["band"]
    new = np.ones(len(i), dtype=bool)
    for lo in range(0, len(i), 1 << 16):
        at = slice(lo, lo + (1 << 16))
        new[at] = ~(ka[i[at], :before] == kb[j[at], :before]).any(axis=1)
    i, j = i[new], j[new]
    return i, j, score[i, j]


def _exact(maybe: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(id1, id2)`` that reach the threshold in double precision, with their cosine."""
    sides = [classes.select(F.col("id").alias(f"id{k}"), F.col("v").alias(f"v{k}"))
             for k in (1, 2)]
    dot = F.aggregate(F.zip_with("v1", "v2", lambda x, y: F.coalesce(x * y, F.lit(0.0))),
                      F.lit(0.0), lambda s, x: s + x)
    return (maybe.join(sides[0], "id1").join(sides[1], "id2")
            .select("id1", "id2", F.round(dot, DIGITS).alias("cosine"))
            .where(F.col("cosine") >= threshold))


def link_counts(vectors: DataFrame, threshold: float, id_col: str = "vec_id",
                vec_col: str = "embedding", bits: int | None = None, bands: int | None = None,
                seed: int = 11) -> DataFrame:
    """One row per vector: ``id``, ``example`` (its class), ``copies`` (vectors of the class) and
    ``links``, the number of other classes found at a cosine of ``threshold`` or more.

    Pairs are counted where they meet, in the first band that they share, so no table of pairs is
    made; only those within ``MARGIN`` of the threshold leave the task, to be scored exactly.
    Vectors that take no part are those of ``close_pairs``."""
    m = meetings(vectors, threshold, id_col, vec_col, bits, bands, seed)
    dim, id_type = m.dim, m.id_type

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                i, j, score = _close(row, dim, threshold - MARGIN)
                sure = score >= threshold + MARGIN
                n = [np.bincount(x[sure], minlength=len(row[c])) for x, c in ((i, "a"), (j, "b"))]
                ids = [row[c][k] for c, x in zip("ab", n, strict=True)
                       for k in np.flatnonzero(x).tolist()]
                ids += [row["a"][k] for k in i[~sure].tolist()]
                other = [row["b"][k] for k in j[~sure].tolist()]
                links = np.concatenate([x[x > 0] for x in n]).tolist()
                yield pa.RecordBatch.from_pydict({
                    "id1": ids, "id2": [None] * len(links) + other,
                    "n": links + [0] * len(other)}, schema=batch_schema)

    batch_schema = pa.schema([("id1", to_arrow_type(m.classes.schema["id"].dataType)),
                              ("id2", to_arrow_type(m.classes.schema["id"].dataType)),
                              ("n", pa.int64())])
    counted = cut_lineage(m.met.mapInArrow(count, f"id1 {id_type}, id2 {id_type}, n long"))
    edge = _exact(counted.where(F.col("id2").isNotNull()).select("id1", "id2"), m.classes, threshold)
    links = (counted.where(F.col("id2").isNull()).select(F.col("id1").alias("example"), "n")
             .unionByName(edge.select(F.explode(F.array("id1", "id2")).alias("example"),
                                      F.lit(1).cast("long").alias("n")))
             .groupBy("example").agg(F.sum("n").alias("links")))
    copies = m.classes.select(F.col("id").alias("example"), "copies")
    return (vector_classes(vectors, id_col, vec_col).join(copies, "example")
            .join(links, "example", "left")
            .select("id", "example", "copies", F.coalesce("links", F.lit(0)).alias("links")))


def close_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id",
                vec_col: str = "embedding", bits: int | None = None, bands: int | None = None,
                seed: int = 11) -> DataFrame:
    """``(id1 < id2, copies1, copies2, cosine)`` between classes of equal vectors; a class of
    several vectors is also a pair with itself (cosine 1). Vectors that are null, zero or hold null
    or non-finite components take no part; shorter ones count as filled up with zeros."""
    m = meetings(vectors, threshold, id_col, vec_col, bits, bands, seed)
    classes, dim, id_type = m.classes, m.dim, m.id_type

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                i, j, _ = _close(row, dim, threshold - MARGIN)
                at = batch.schema.get_field_index("a"), batch.schema.get_field_index("b")
                ids = [row["a"][k] for k in i.tolist()], [row["b"][k] for k in j.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, batch.schema.field(k).type.value_type)
                     for x, k in zip(ids, at, strict=True)], names=["a", "b"])

    maybe = (m.met.mapInArrow(compare, f"a {id_type}, b {id_type}")
             .select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2")))
    found = _exact(maybe, classes, threshold)
    n = [classes.select(F.col("id").alias(f"id{k}"), F.col("copies").alias(f"copies{k}"))
         for k in (1, 2)]
    cols = ["id1", "id2", "copies1", "copies2", "cosine"]
    inside = (n[0].where("copies1 >= 2").withColumn("id2", F.col("id1"))
              .withColumn("copies2", F.col("copies1")).withColumn("cosine", F.lit(1.0)))
    return (found.join(n[0], "id1").join(n[1], "id2").select(*cols)
            .unionByName(inside.select(*cols)))
