"""Golden rows for preprocessing (aliases, date formats, cleaning, platform rules)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from murmuration.functions.platform import infer_platform
from murmuration.operators import filters, overview
from murmuration.operators.preprocess import preprocess_posts
from murmuration.operators.roles import column_roles, resolve_roles, strip_names

ROW1 = ("RT @bob: Vote NOW #Change https://a.b/c", "alice", "Jul 05, 2024 @ 13:04:05.123",
        "https://www.tiktok.com/@a/1")
DIRTY = [
    ROW1,
    ROW1,
    ("rt @bob: vote now #change", None, "05-Jul-2024 01:04PM", "http://site.tg/x"),
    ("QT hello; world\nline2", "carol", "2024-07-05 13:04:05+0200", "https://netflix.com/t"),
    ("part @bob www.x.org ok", "dave", "2024-07-05", "HTTPS://T.ME/abc"),
    ("hello", "dave", "not a date", None),
    ("   ", "erin", "2024-07-06 00:00:00", None),
    ("https://only.url", "erin", "2024-07-06 00:00:00", "https://last.media/1"),
    ("literal\\nbackslash #Été #a_b", "frank", "2024-07-08T09:00:00Z", "https://news.example.org/1"),
    ("nan", "hal", "2024-07-08 09:00:00", None),
    ("RT @a-b: hi", "gina", "Tuesday, 09 Jul 2024 10:00:00", None),
]
EXPECTED = {
    "alice": (dt.datetime(2024, 7, 5, 13, 4, 5, 123000), "TikTok", "rt @bob: vote now #change",
              "vote now #change"),
    "Unknown_User": (dt.datetime(2024, 7, 5, 13, 4), "Unknown", "vote now #change",
                     "vote now #change"),
    "carol": (dt.datetime(2024, 7, 5, 11, 4, 5), "X", "qt hello line2", "qt hello line2"),
    "dave": (dt.datetime(2024, 7, 5), "Unknown", "pa ok", "pa ok"),
    "erin": (dt.datetime(2024, 7, 6), "Telegram", "", ""),
    "frank": (dt.datetime(2024, 7, 8, 9), "Media", "literal backslash #été #a_b",
              "literal backslash #été #a_b"),
    "gina": (dt.datetime(2024, 7, 9, 10), "Unknown", "rt @a-b: hi", "rt @a-b: hi"),
}


@pytest.fixture(scope="module")
def dirty(spark):
    return spark.createDataFrame(DIRTY, "FullText string, author string, created_at string, link string")


@pytest.fixture(scope="module")
def posts(dirty):
    return preprocess_posts(dirty).cache()


def test_roles(dirty):
    r = resolve_roles(dirty)
    assert (r.text, r.influencer, r.timestamp, r.url) == ("FullText", "author", "created_at", "link")
    assert r.platform_mode == "infer"
    assert column_roles(["TEXT", "influencer", "x"])["text"] == "TEXT"


def test_golden_rows(posts):
    rows = {r["Influencer"]: r for r in posts.collect()}
    assert set(rows) == set(EXPECTED)
    for name, (ts, plat, text, orig) in EXPECTED.items():
        r = rows[name]
        assert r["Timestamp"] == ts, name
        assert r["Platform"] == plat, name
        assert r["text"] == text, name
        assert r["original_text"] == orig, name


def test_derived_reports(posts):
    pc = {r["Platform"]: r["posts"] for r in overview.platform_counts(posts).collect()}
    assert pc == {"Unknown": 3, "TikTok": 1, "X": 1, "Telegram": 1, "Media": 1}
    vol = [r["posts"] for r in overview.daily_volume(posts).orderBy("day").collect()]
    assert vol == [4, 1, 0, 1, 1]
    top = overview.top_hashtags(posts).collect()
    assert [(r["hashtag"], r["frequency"]) for r in top] == [("#change", 2)]
    assert filters.filter_date_range(posts, "2024-07-05", "2024-07-05").count() == 4
    assert sum(vol) == posts.count()


def test_platform_rules(spark):
    urls = ["https://www.tiktok.com/x", "https://fb.watch/1", "https://netflix.com", "http://a.b",
            "HTTPS://t.me/x", None, "https://last.media/1", "https://youtu.be/1", "ftp://x"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] for r in df.select(infer_platform(F.col("u"))).collect()]
    assert got == ["TikTok", "Facebook", "X", "Unknown", "Unknown", "Unknown", "Telegram",
                   "YouTube", "Unknown"]


def test_strip_names_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`a ` int, b int")
    assert strip_names(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        strip_names(spark.createDataFrame([(1, 2)], "`a ` int, ` a` int"))


def test_empty_text_column(spark):
    df = spark.createDataFrame([("  ", "u", "2024-01-01")], "text string, author string, Date string")
    assert preprocess_posts(df).count() == 0
