"""Overview reports: sample rows, top accounts/outlets/hashtags, platform counts, daily volume.

Counts are hash aggregations with map-side partial aggregation, so a hot key (one account with a
third of all posts) costs one partial row per task, not a skewed partition. Top-k uses
``orderBy(...).limit(k)`` which plans as TakeOrderedAndProject (per-partition top-k, then a
k-row merge). Count ties break by key ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions.text import hashtags
from murmuration.operators.preprocess import ORDER


def sample_posts(df: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` posts in post order: ``Influencer, Platform, URL``."""
    return (df.orderBy(ORDER).limit(n)
            .select("post_id", "Influencer", "Platform", "URL"))


def value_counts(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Rows per non-null value of ``col`` (``posts`` column)."""
    name = name or col
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(name))
            .agg(F.count(F.lit(1)).alias("posts")))


def top_values(df: DataFrame, col: str, k: int = 10, name: str | None = None) -> DataFrame:
    name = name or col
    return value_counts(df, col, name).orderBy(F.desc("posts"), F.asc(name)).limit(k)


def top_influencers(df: DataFrame, k: int = 10) -> DataFrame:
    return top_values(df, "Influencer", k)


def platform_counts(df: DataFrame) -> DataFrame:
    return value_counts(df, "Platform")


def top_outlets(df: DataFrame, k: int = 10) -> DataFrame | None:
    """Top outlets when an ``Outlet`` column exists, else top channels, else None."""
    if "Outlet" in df.columns:
        return top_values(df, "Outlet", k)
    if "Channel" in df.columns:
        return top_values(df, "Channel", k)
    return None


def text_tags(df: DataFrame, text_col: str = "text") -> Column:
    """The hashtags of the texts: those that preprocessing kept in their place, if it did."""
    return F.col("text_tags") if "text_tags" in df.columns else hashtags(F.col(text_col))


def with_hashtags(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("hashtags", text_tags(df, text_col))


def hashtag_counts(df: DataFrame, exclude_platform: str | None = "Media") -> DataFrame:
    """Occurrences per hashtag (duplicates within a post count), social platforms only."""
    if exclude_platform is not None:
        # A null platform is kept, as pandas' ``!=`` keeps NaN.
        df = df.where(~F.col("Platform").eqNullSafe(F.lit(exclude_platform)))
    tags = df.select(F.explode(text_tags(df)).alias("hashtag"))
    return tags.groupBy("hashtag").agg(F.count(F.lit(1)).alias("frequency"))


def top_hashtags(df: DataFrame, k: int = 10, exclude_platform: str | None = "Media") -> DataFrame:
    return (hashtag_counts(df, exclude_platform)
            .orderBy(F.desc("frequency"), F.asc("hashtag")).limit(k))


def calendar(ranges: DataFrame, bucket: str) -> DataFrame:
    """Each row of ``ranges`` (``lo``, ``hi``, other columns) once per bucket from ``lo`` to
    ``hi``, in a column named ``bucket``'s name.

    Expanded by years, then within each year, so that a wrong year far off makes many short
    arrays in many rows and not one long array."""
    unit = F.expr(f"INTERVAL 1 {bucket}")
    kind = ranges.schema["lo"].dataType
    year = F.col("_year").cast(kind)
    years = ranges.where(F.col("lo").isNotNull()).withColumn("_year", F.explode(F.sequence(
        F.trunc("lo", "year"), F.trunc("hi", "year"), F.expr("INTERVAL 1 YEAR"))))
    last = F.add_months(F.col("_year"), 12).cast(kind) - unit
    return years.withColumn(bucket, F.explode(F.sequence(
        F.greatest(F.col("lo"), year), F.least(F.col("hi"), last.cast(kind)), unit))) \
        .drop("lo", "hi", "_year")


def daily_volume(df: DataFrame, bucket: str = "day", ts_col: str = "Timestamp") -> DataFrame:
    """Posts per UTC bucket, zero-filled from the first to the last bucket.

    The calendar comes from a one-row min/max aggregate; its size is the length of the date
    range, not the number of posts.
    """
    if bucket not in ("day", "hour"):
        raise ValueError(f"unknown bucket {bucket!r}")
    b = F.date_trunc(bucket, F.col(ts_col))
    counts = df.groupBy(b.alias(bucket)).agg(F.count(F.lit(1)).alias("posts"))
    cal = calendar(df.agg(F.min(b).alias("lo"), F.max(b).alias("hi")), bucket)
    posts = F.coalesce(F.col("posts"), F.lit(0)).cast("long").alias("posts")
    out = cal.join(counts, bucket, "left")
    if bucket == "day":
        return out.select(F.to_date("day").alias("day"), posts)
    return out.select(F.col(bucket).alias("bucket"), posts)
