"""The ``raw_posts`` fixture: a raw social-media post table derived from the driver tables.

The driver tables (``documents``, ``events``, ``pages``) hold no URLs, retweets or hashtags, so
these are added deterministically from ids. The Spark version below and ``RAW_POSTS_SQL`` (run by
DuckDB in the oracle) compute the same rows; both grow with the input tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.functions.text import is_nonblank

# Column roles of the fixture (what a user would pick in the reference's column mapping).
FIXTURE_ROLES = dict(text_col="content", influencer_col="author", timestamp_col="created_at",
                     url_col="link", id_col="post_id", order_cols=["post_id"])

RAW_POSTS_SQL = """
SELECT d.doc_id AS post_id,
  concat('user_', CAST(e.user_id AS STRING)) AS author,
  CAST(date_trunc('second', e.ts) AS STRING) AS created_at,
  concat(
    CASE WHEN d.doc_id % 5 = 0 THEN concat('RT @user_', CAST(d.doc_id % 13 AS STRING), ': ') ELSE '' END,
    d.text,
    CASE WHEN d.doc_id % 3 = 0 THEN concat(' #', d.lang, 'News') WHEN d.doc_id % 3 = 1 THEN concat(' #', d.source) ELSE '' END,
    CASE WHEN d.doc_id % 4 = 0 THEN concat(' https://t.co/', CAST(d.doc_id AS STRING)) ELSE '' END) AS content,
  CASE d.doc_id % 10
    WHEN 0 THEN concat('https://www.tiktok.com/@u/video/', CAST(d.doc_id AS STRING))
    WHEN 1 THEN concat('https://www.facebook.com/p/', CAST(d.doc_id AS STRING))
    WHEN 2 THEN concat('https://twitter.com/u/status/', CAST(d.doc_id AS STRING))
    WHEN 3 THEN concat('https://youtu.be/', CAST(d.doc_id AS STRING))
    WHEN 4 THEN concat('https://www.instagram.com/p/', CAST(d.doc_id AS STRING))
    WHEN 5 THEN concat('https://t.me/ch/', CAST(d.doc_id AS STRING))
    WHEN 8 THEN CAST(NULL AS STRING)
    WHEN 9 THEN concat('https://x.com/share/', CAST(CAST(floor(d.doc_id / 50.0) AS BIGINT) AS STRING))
    ELSE p.url END AS link
FROM documents d
JOIN (SELECT event_id, max(user_id) AS user_id, max(ts) AS ts FROM events GROUP BY event_id) e
  ON e.event_id = d.doc_id * 5
JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)
"""

_CONTENT = """concat(
    CASE WHEN doc_id % 5 = 0 THEN concat('RT @user_', CAST(doc_id % 13 AS STRING), ': ') ELSE '' END,
    text,
    CASE WHEN doc_id % 3 = 0 THEN concat(' #', lang, 'News')
         WHEN doc_id % 3 = 1 THEN concat(' #', source) ELSE '' END,
    CASE WHEN doc_id % 4 = 0 THEN concat(' https://t.co/', CAST(doc_id AS STRING)) ELSE '' END)"""

_LINK = """CASE doc_id % 10
    WHEN 0 THEN concat('https://www.tiktok.com/@u/video/', CAST(doc_id AS STRING))
    WHEN 1 THEN concat('https://www.facebook.com/p/', CAST(doc_id AS STRING))
    WHEN 2 THEN concat('https://twitter.com/u/status/', CAST(doc_id AS STRING))
    WHEN 3 THEN concat('https://youtu.be/', CAST(doc_id AS STRING))
    WHEN 4 THEN concat('https://www.instagram.com/p/', CAST(doc_id AS STRING))
    WHEN 5 THEN concat('https://t.me/ch/', CAST(doc_id AS STRING))
    WHEN 8 THEN CAST(NULL AS STRING)
    WHEN 9 THEN concat('https://x.com/share/', CAST(CAST(floor(doc_id / 50.0) AS BIGINT) AS STRING))
    ELSE url END"""


# One post per event, over all events, documents and pages: a document's text recurs, an account
# repeats texts, and retweet markers come in upper, lower and mixed case. The same expressions run
# in both engines.
EVENT_POST_COLUMNS = {
    "post_id": "event_id",
    "author": "concat('user_', CAST(user_id AS STRING))",
    "created_at": "CAST(date_trunc('second', ts) AS STRING)",
    "content": """concat(
    CASE event_id % 15 WHEN 0 THEN concat('RT @user_', CAST(event_id % 13 AS STRING), ': ')
         WHEN 5 THEN concat('rt @User_', CAST(event_id % 11 AS STRING), ': ')
         WHEN 10 THEN concat('Rt @USER_', CAST(event_id % 7 AS STRING), ' ') ELSE '' END,
    text,
    CASE WHEN event_id % 4 = 0 THEN concat(' cc @User_', CAST(event_id % 17 AS STRING),
         ' qt @user_', CAST(event_id % 19 AS STRING)) ELSE '' END,
    CASE WHEN event_id % 3 = 0 THEN concat(' #', lang, 'News') ELSE '' END)""",
    "link": """CASE event_id % 10
    WHEN 0 THEN concat('https://www.tiktok.com/@u/video/', CAST(event_id % 40 AS STRING))
    WHEN 1 THEN concat('https://twitter.com/u/status/', CAST(event_id % 90 AS STRING))
    WHEN 2 THEN CAST(NULL AS STRING)
    WHEN 3 THEN concat('https://x.com/share/', CAST(CAST(floor(event_id / 50.0) AS BIGINT) AS STRING))
    ELSE url END""",
}
EVENT_POSTS_SQL = ("SELECT " + ", ".join(f"{v} AS {k}" for k, v in EVENT_POST_COLUMNS.items())
                   + """ FROM events e
JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)
JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)""")


def _stand_in() -> Column:
    """What stands for a text that is not read: missing and blank texts themselves, else a digest, so
    that rows stay distinct as they were."""
    text = F.col("text")
    return F.when((text == "nan") | ~is_nonblank(text), text).otherwise(F.sha2(text, 256))


def event_posts(spark: SparkSession, sf_dir: str, texts: bool = True,
                only: DataFrame | None = None) -> DataFrame:
    """Raw posts, one per event. For analyses that do not look into texts, ``texts=False`` puts a
    digest for each, so that no text is copied to its events. ``only``: the ``post_id``s wanted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    if not texts:
        docs = docs.withColumn("text", _stand_in())
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    if only is not None:
        events = events.join(only, F.col("event_id") == F.col("post_id"), "left_semi")
    # from the file footers; an empty table joins nothing
    n_docs, n_pages = docs.count() or None, pages.count() or None
    # texts last, so that they are moved once and not with each of their events
    joined = (events.join(pages, F.col("page_id") == F.col("event_id") % F.lit(n_pages))
              .join(docs, F.col("doc_id") == F.col("event_id") % F.lit(n_docs)))
    return joined.selectExpr(*[f"{v} AS {k}" for k, v in EVENT_POST_COLUMNS.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def raw_posts(spark: SparkSession, sf_dir: str, texts: bool = True) -> DataFrame:
    """Raw posts (``post_id, author, created_at, content, link``) over the whole driver tables;
    ``texts`` as in ``event_posts``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if not texts:
        docs = docs.withColumn("text", _stand_in())
    # event_id is unique, so the oracle's GROUP BY event_id is an identity; no shuffle needed here.
    events = (table(spark, sf_dir, "events").where("event_id % 5 = 0")
              .selectExpr("event_id div 5 AS doc_id", "user_id", "ts"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # From the file footers; an empty table joins nothing. A number, not a scalar subquery: Spark
    # does not wait for a subquery in the join key of a side that it broadcasts, and fails.
    n_pages = pages.count() or None
    # the short columns meet first: texts are moved once, by the id that their posts keep
    short = events.join(pages, F.col("page_id") == F.col("doc_id") % F.lit(n_pages))
    return docs.join(short, "doc_id").selectExpr(
        "doc_id AS post_id",
        "concat('user_', CAST(user_id AS STRING)) AS author",
        "CAST(date_trunc('second', ts) AS STRING) AS created_at",
        f"{_CONTENT} AS content",
        f"{_LINK} AS link",
    )
