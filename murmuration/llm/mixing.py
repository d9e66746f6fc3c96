"""Mixing sources to target weights.

Tokens (words) are summed per source; a source's repetition rate is its target over its size.
Every document is emitted floor(rate) times, plus once more with probability equal to the
fraction, decided by a hash of the document with a seed, so reruns agree.

One draw of a source with few or very uneven documents can miss its target by far. So ``TRIES``
seeds are tried for every source, all in one aggregation, and each source keeps the seed whose
draw takes the number of words nearest its target. A document still has one draw from one hash.

Targets share the total size by weight. A target stops at ``max_rate`` times its source's size;
what is cut is shared again by weight among the others until none is above: that is the common
level L with sum(min(max_rate * size, L * weight)) = total, found by a few one-row aggregations
over the per-source table. Sources are numbered in code-point order (null last) by range
partitions, so any number of sources works.

Null text has size 0; a null source is a source of its own; empty tables give no rows. Repeated
rows draw the same extra copy. Other columns are passed through unused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import boxed, unboxed, word_count, written
from murmuration.operators.ranking import dense_index

SEED = 7
TRIES = 16
WEIGHTS = (1.0, 2.0, 3.0)
MAX_RATE = 3.0


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS,
                   max_rate: float = MAX_RATE) -> DataFrame:
    """``(source, source_size, target, rate)`` from ``(source, source_size)`` rows."""
    order = F.struct(F.col("source").isNull().alias("none"), F.col("source"))
    ranked = dense_index(sizes.withColumn("_order", order), "_order", "_idx").drop("_order")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.col("_idx") % len(weights) + 1).cast("int"))
    t = written(ranked.withColumn("weight", w)
                .withColumn("cap", F.lit(max_rate) * F.col("source_size")))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:   # the level only rises, so capped sources stay capped
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        used, open_weight = t.agg(F.sum(F.when(capped, F.col("cap"))),
                                  F.sum(F.when(~capped, F.col("weight")))).first()
        if not open_weight:
            break
        nxt = (total - (used or 0.0)) / open_weight
        if nxt <= level:
            break
        level = nxt
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    rate = F.when(F.col("source_size") > 0,
                  F.least(F.lit(max_rate), target / F.col("source_size"))).otherwise(0.0)
    return t.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, key: Column, seed: Column) -> Column:
    """floor(rate), plus one if the key's seeded hash falls in the fraction."""
    draw = F.shiftrightunsigned(F.xxhash64(seed, key), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"),
                               F.coalesce(word_count(F.col(text_col)), F.lit(0)).alias("size")))


def source_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS,
                max_rate: float = MAX_RATE, seed: int = SEED, tries: int = TRIES) -> DataFrame:
    """``(_s, source_size, target, rate, seed)`` per source: of ``tries`` seeds from ``seed`` on
    the one whose draw takes the number of words nearest the target (ties: the smallest)."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, max_rate).withColumnRenamed("source", "_s")
    seeds = range(seed, seed + tries)
    words = [F.sum(copies(F.col("rate"), F.col("_id"), F.lit(k)) * F.col("size")) for k in seeds]
    tried = (sized.join(targets, F.col("source").eqNullSafe(F.col("_s")))
             .groupBy(*targets.columns).agg(*[w.alias(f"_{k}") for k, w in zip(seeds, words)]))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"_{k}") - F.col("target")).alias("off"),
                                          F.lit(k).alias("seed")) for k in seeds]))
    return written(tried.select(*targets.columns, best["seed"].alias("seed")))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", weights: Sequence[float] = WEIGHTS,
             max_rate: float = MAX_RATE, seed: int = SEED, tries: int = TRIES) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken."""
    sized = _sized(docs, id_col, text_col, source_col)
    plan = source_plan(sized, weights, max_rate, seed, tries)
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("copies", copies(F.col("rate"), F.col("_id"), F.col("seed")))
            .select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: Sequence[float] = WEIGHTS,
        max_rate: float = MAX_RATE, seed: int = SEED, tries: int = TRIES) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each repeated as often as the mix takes it."""
    plan = source_plan(_sized(docs, id_col, text_col, source_col), weights, max_rate, seed, tries)
    rates = plan.select("_s", F.col("rate").alias("_rate"), F.col("seed").alias("_seed"))
    joined = boxed(docs, _source=F.col(source_col), _id=F.col(id_col)).join(
        rates, F.col("_source").eqNullSafe(F.col("_s")))
    times = copies(F.col("_rate"), F.col("_id"), F.col("_seed"))
    return unboxed(joined.select("_in", F.explode(F.array_repeat(F.lit(0), times.cast("int")))))
