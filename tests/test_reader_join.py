"""The reader of the posts where its short columns are the side that Spark broadcasts."""

import pytest

from murmuration.plans.catalog import REGISTRY

LINKS = {0: "https://www.tiktok.com/@u/video/{i}", 1: "https://www.facebook.com/p/{i}",
         2: "https://twitter.com/u/status/{i}", 3: "https://youtu.be/{i}",
         4: "https://www.instagram.com/p/{i}", 5: "https://t.me/ch/{i}",
         9: "https://x.com/share/{k}"}
PLATFORMS = {0: "TikTok", 1: "Facebook", 2: "X", 3: "YouTube", 4: "Instagram", 5: "Telegram",
             8: "Unknown", 9: "X"}
DOCS, PAGES = 200, 50


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """200 documents, each with its event, and 50 pages of long URLs."""
    d = str(tmp_path_factory.mktemp("reader"))
    spark.range(DOCS).selectExpr("id AS doc_id", "'a b' AS text", "'en' AS lang",
                                 "'web' AS source").write.parquet(f"{d}/documents.parquet")
    spark.range(5 * DOCS).selectExpr("id AS event_id", "id % 7 AS user_id",
                                     "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts"
                                     ).write.parquet(f"{d}/events.parquet")
    spark.range(PAGES).selectExpr("id AS page_id", "concat('https://a.org/', id, repeat('p', 1000)) "
                                  "AS url").write.parquet(f"{d}/pages.parquet")
    return d


def expected():
    url = [f"https://a.org/{i}" + "p" * 1000 for i in range(PAGES)]
    for i in range(PAGES):
        yield i, "page", url[i], "Media"
    for i in range(DOCS):
        link = None if i % 10 == 8 else LINKS.get(i % 10, url[i % PAGES])
        yield (i, "post", link and link.format(i=i, k=i // 50), PLATFORMS.get(i % 10, "Media"))


# In bytes: no side is broadcast; the posts (about 3 000), not the pages (about 50 000); either.
@pytest.mark.parametrize("limit", ["-1", "20000", "10000000"])
def test_any_side_is_broadcast(spark, tables, limit):
    """A page's number came from a scalar subquery in the join's key; for the key of a side that it
    broadcasts Spark did not wait for it ("Subquery has not finished")."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": limit}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = [tuple(r) for r in REGISTRY["infer_platform"](spark, tables).collect()]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(got, key=str) == sorted(expected(), key=str)
