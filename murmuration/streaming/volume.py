"""Incremental (Structured Streaming) forms of the time-bucketed overview reports.

The reference re-reads and re-aggregates everything on each interaction. For a live feed of posts
the same reports are event-time windowed aggregations with a watermark: state per open bucket,
late rows accepted until the watermark passes, finished buckets emitted once (append mode).

* ``preprocess_stream`` -- canonical posts from a raw post stream. Roles must be given (the
  batch resolver's data check needs the whole table); duplicates are dropped within the
  watermark instead of globally. It sets the event-time watermark; the reports below add one
  only when given ``watermark`` (for streams that were not preprocessed here).
* ``stream_volume`` -- posts per bucket (and optionally per platform).
* ``stream_hashtag_counts`` -- hashtag occurrences per bucket (non-Media platforms).
* ``stream_url_shares`` -- posts and distinct accounts per URL per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.text import hashtags
from murmuration.operators.preprocess import preprocess_posts
from murmuration.operators.roles import Roles


def preprocess_stream(stream: DataFrame, roles: Roles, watermark: str = "1 day",
                      id_col: str | None = None, order_cols: list[str] | None = None,
                      **kwargs) -> DataFrame:
    """Canonical posts for a streaming DataFrame (explicit ``roles``)."""
    out = preprocess_posts(stream, roles=roles, id_col=id_col, order_cols=order_cols,
                           dedupe=False, **kwargs)
    return (out.withWatermark("Timestamp", watermark)
            .dropDuplicatesWithinWatermark(["post_id"]))


def _watermarked(posts: DataFrame, watermark: str | None) -> DataFrame:
    """Add an event-time watermark unless the stream already has one (``watermark=None``)."""
    return posts if watermark is None else posts.withWatermark("Timestamp", watermark)


def stream_volume(posts: DataFrame, bucket: str = "1 day", watermark: str | None = None,
                  by_platform: bool = False) -> DataFrame:
    keys = [F.window("Timestamp", bucket).alias("bucket")]
    if by_platform:
        keys.append(F.col("Platform"))
    return (_watermarked(posts, watermark).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("posts"))
            .select(F.col("bucket.start").alias("bucket_start"),
                    F.col("bucket.end").alias("bucket_end"),
                    *(["Platform"] if by_platform else []), "posts"))


def stream_hashtag_counts(posts: DataFrame, bucket: str = "1 day", watermark: str | None = None,
                          exclude_platform: str | None = "Media") -> DataFrame:
    x = _watermarked(posts, watermark)
    if exclude_platform is not None:
        x = x.where(~F.col("Platform").eqNullSafe(F.lit(exclude_platform)))
    x = x.select("Timestamp", F.explode(hashtags(F.col("text"))).alias("hashtag"))
    return (x.groupBy(F.window("Timestamp", bucket).alias("bucket"), "hashtag")
            .agg(F.count(F.lit(1)).alias("frequency"))
            .select(F.col("bucket.start").alias("bucket_start"), "hashtag", "frequency"))


def stream_url_shares(posts: DataFrame, bucket: str = "1 hour",
                      watermark: str | None = None) -> DataFrame:
    """Posts and distinct accounts per URL per bucket (approximate distinct count, as exact
    distinct aggregation is not supported on streams)."""
    x = _watermarked(posts, watermark).where(F.col("URL").isNotNull())
    return (x.groupBy(F.window("Timestamp", bucket).alias("bucket"), "URL")
            .agg(F.count(F.lit(1)).alias("posts"),
                 F.approx_count_distinct("Influencer").alias("accounts_approx"))
            .select(F.col("bucket.start").alias("bucket_start"), "URL", "posts",
                    "accounts_approx"))
