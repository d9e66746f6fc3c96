"""Order-dependent aggregations that stay skew-safe.

* ``first_k_distinct``: the first ``k`` distinct values per group in a given order (the
  reference's ``unique()[:k]``). Done as ``k`` rounds of ``min(struct(order, value))`` hash
  aggregation, each with map-side partial aggregation, so one hot group never lands in a single
  window partition or a collected list. The repeated input is one shuffle that Spark reuses.
* ``dense_index``: 0-based position of each row in a global order without an un-partitioned
  window: range-partition + per-partition row numbers + a prefix sum over partition counts
  (a table with one row per partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.session import cut_lineage


def first_k_distinct(df: DataFrame, group_cols: list[str], value_col: str, order_col: str,
                     k: int, out_col: str = "first_values", count_col: str = "n_distinct"
                     ) -> DataFrame:
    """Per group: array of the first ``k`` distinct values (by earliest ``order_col``) and the
    number of distinct values. Null values are ignored."""
    dedup = (df.where(F.col(value_col).isNotNull())
             .groupBy(*group_cols, F.col(value_col).alias("_v"))
             .agg(F.min(order_col).alias("_o"))
             .select(*group_cols, F.struct(F.col("_o").alias("o"), F.col("_v").alias("v"))
                     .alias("_s")))
    counts = dedup.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(count_col))
    picks = dedup.groupBy(*group_cols).agg(F.min("_s").alias("_p0"))
    acc = picks
    last = "_p0"
    for i in range(1, k):
        nxt = (dedup.join(acc.select(*group_cols, F.col(last).alias("_last")), group_cols)
               .where(F.col("_s") > F.col("_last"))
               .groupBy(*group_cols).agg(F.min("_s").alias(f"_p{i}")))
        acc = acc.join(nxt, group_cols, "left")
        last = f"_p{i}"
    arr = F.filter(F.array(*[F.col(f"_p{i}") for i in range(k)]), lambda x: x.isNotNull())
    return (acc.join(counts, group_cols)
            .select(*group_cols, F.transform(arr, lambda x: x["v"]).alias(out_col), count_col))


def join_with_more(values_col: str, count_col: str, k: int) -> F.Column:
    """``'a, b, c'`` plus ``'...'`` when there are more than ``k`` distinct values."""
    return F.concat(F.array_join(F.col(values_col), ", "),
                    F.when(F.col(count_col) > k, F.lit("...")).otherwise(F.lit("")))


def dense_index(df: DataFrame, order_col: str, out_col: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """0-based index of each row by ``order_col`` (values must be unique)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parted = (df.repartitionByRange(n, F.col(order_col))
              .withColumn("_pid", F.spark_partition_id()))
    # Written once: range bounds come from sampling, so two evaluations of the exchange could
    # place rows differently; numbering and partition sizes must see the same placement.
    local = cut_lineage(parted.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid").orderBy(order_col)) - 1))
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a bounded table, so the un-partitioned window here is fine
    offsets = sizes.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out_col, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local"))
            .drop("_pid", "_local", "_off"))


def previous_in_group(df: DataFrame, key: str, order_col: str, cols: list[str],
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``prev`` = struct of (``order_col``, ``cols``) of the previous row in the same ``key``.

    ``lag`` over ``Window.partitionBy(key)`` would put a hot key (a URL in a third of all posts)
    in one task. Instead rows are range-partitioned on (key, order), which splits a hot key
    across partitions; a window per (key, partition) gives the local previous row, and the first
    row of each piece takes the last row of the piece before it from a table with one row per
    piece. ``order_col`` must be unique within a key (e.g. the post order struct).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rec = F.struct(F.col(order_col).alias("o"), *[F.col(c) for c in cols])
    # written once so the local and boundary branches see the same range placement
    parted = cut_lineage(df.repartitionByRange(n, F.col(key), F.col(order_col))
                         .withColumn("_pid", F.spark_partition_id()).withColumn("_rec", rec))
    local = parted.withColumn(
        "_prev", F.lag("_rec").over(Window.partitionBy(key, "_pid").orderBy(order_col)))
    pieces = parted.groupBy(key, "_pid").agg(F.max("_rec").alias("_last"))
    boundary = pieces.withColumn(
        "_bprev", F.lag("_last").over(Window.partitionBy(key).orderBy("_pid"))) \
        .select(key, "_pid", "_bprev")
    return (local.join(boundary, [key, "_pid"])
            .withColumn("prev", F.coalesce("_prev", "_bprev"))
            .drop("_pid", "_rec", "_prev", "_bprev"))


def count_before(df: DataFrame, keys: list[str], order_col: str, flag_col: str | None = None,
                 out_col: str = "before", num_partitions: int | None = None) -> DataFrame:
    """Per row: how many rows of the same ``keys`` group (with ``flag_col`` true, if given) come
    strictly before it in ``order_col`` order (unique among the flagged rows of a group; rows
    that are not flagged may share an order among themselves).

    A running count over ``Window.partitionBy(keys)`` would give a hot group a single task.
    Here rows are range-partitioned on (keys, order) so a hot group spans several partitions;
    each piece counts locally and adds the totals of the earlier pieces of its group (a table
    with one row per piece).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    flag = F.col(flag_col).cast("long") if flag_col else F.lit(1).cast("long")
    parted = cut_lineage(df.repartitionByRange(n, *[F.col(k) for k in keys], F.col(order_col))
                         .withColumn("_pid", F.spark_partition_id()).withColumn("_f", flag))
    w = Window.partitionBy(*keys, "_pid").orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted.withColumn("_loc", F.sum("_f").over(w) - F.col("_f"))
    pieces = parted.groupBy(*keys, "_pid").agg(F.sum("_f").alias("_s"))
    pw = Window.partitionBy(*keys).orderBy("_pid") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = pieces.select(*keys, "_pid", (F.sum("_s").over(pw) - F.col("_s")).alias("_off"))
    return (local.join(offsets, [*keys, "_pid"])
            .withColumn(out_col, F.col("_loc") + F.col("_off"))
            .drop("_pid", "_f", "_loc", "_off"))
