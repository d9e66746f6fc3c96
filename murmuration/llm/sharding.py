"""Sharding by jump consistent hashing, in DataFrame functions only.

The jump sequence of a key is the same whatever the shard count: a key's shard among n is the
last jump below n. So one walk gives the shard for n and for n + 1, no ring table is kept, and
one more shard only takes rows into itself. The generator is the published 64-bit linear
congruential one; its product is taken in DECIMAL(38,0) (below 2^126) and reduced modulo 2^64,
because long arithmetic may raise on overflow.

Slots number the rows of a shard without gaps. Rows are range-partitioned on (shard, id) and
numbered by position in their partition, less the position of their shard's first row there,
plus the rows of earlier partitions: no task holds a whole shard.

The key is the id itself (a null id counts as 0; non-integer ids are hashed). Null text has
size 1 and the checksum of the empty text. Repeated rows share a shard and get separate slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import boxed, nonnull_text, written

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64


def jumps(key: Column, limit: int) -> Column:
    """Ascending jumps below ``limit`` of a long key, as an array of longs starting with 0."""
    big = "decimal(38,0)"
    wide = key.cast(big)
    start = F.struct(F.array(F.lit(0).cast("long")).alias("seen"),
                     F.lit(0).cast("long").alias("next"),
                     F.when(wide < 0, wide + F.lit(str(WORD)).cast(big)).otherwise(wide)
                     .cast("decimal(20,0)").alias("key"))

    def step(s: Column, _: Column) -> Column:
        mixed = ((s["key"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)"))
                 % F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")
        low = mixed % F.lit(1 << 33).cast("decimal(20,0)")   # exact: no rounded quotient
        high = F.floor((mixed - low).cast("double") / F.lit(float(1 << 33)))
        to = F.floor((s["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1.0)))
        live = s["next"] < limit
        landed = to < limit
        return F.struct(
            F.when(live & landed, F.concat(s["seen"], F.array(to))).otherwise(s["seen"])
            .alias("seen"),
            F.when(live, to).otherwise(s["next"]).alias("next"),
            F.when(live, mixed).otherwise(s["key"]).alias("key"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), start, step, lambda s: s["seen"])


def shard_of(seen: Column, shards: int) -> Column:
    """The shard among ``shards``: the last jump below it."""
    return F.array_max(F.filter(seen, lambda x: x < shards)).cast("int")


def shard_key(docs: DataFrame, id_col: str) -> Column:
    integral = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    key = F.col(id_col).cast("long") if integral else F.xxhash64(id_col)
    return F.coalesce(key, F.lit(0).cast("long"))


def assign(docs: DataFrame, shards: int = 16, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (its shard when one more is appended), in place
    of any columns of these names."""
    seen = jumps(shard_key(docs, id_col), shards + 1)
    return (boxed(docs.drop("shard", "grown_shard"), _seen=seen)
            .select("_in.*", shard_of(F.col("_seen"), shards).alias("shard"),
                    shard_of(F.col("_seen"), shards + 1).alias("grown_shard")))


def with_slots(rows: DataFrame, order: list[str], out_col: str = "slot") -> DataFrame:
    """Number the rows of each ``shard`` from 0 without gaps, in ``order``. For rows of this
    module's own columns; names with a leading underscore are taken."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = ["shard", *order]
    placed = written(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                     .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    pieces = (placed.groupBy("shard", part.alias("_part"))
              .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")))
    # one row per shard and partition it spans
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = pieces.select("shard", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0))
                                               - F.col("_first")).alias("_shift"))
    return (placed.withColumn("_part", part).join(offsets, ["shard", "_part"])
            .withColumn(out_col, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"))


def shard_table(docs: DataFrame, shards: int = 16, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text checksum, shard, slot, grown_shard."""
    text = nonnull_text(text_col)
    rows = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return with_slots(assign(rows, shards, id_col), [id_col, "text_crc32"])


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """Write ``docs`` as Parquet, one folder ``shard=<n>`` per shard; large shards get several
    files (rows are spread over files by a hash of the id)."""
    out = assign(docs, shards, id_col).drop("grown_shard")
    out.repartition("shard", F.pmod(F.xxhash64(id_col), F.lit(16))) \
        .write.mode("overwrite").partitionBy("shard").parquet(path)
