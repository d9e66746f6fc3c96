"""Signals, handles and the platform policy on small goldens; the composed analyses."""

import datetime as dt

from pyspark.sql import functions as F

from murmuration.operators import overview, signals
from murmuration.operators.network import account_clusters, co_cluster_edges
from murmuration.operators.preprocess import preprocess_posts, require_nonempty
from murmuration.operators.roles import NoDataError
from murmuration.plans import analyses

import pytest

BASE = dt.datetime(2024, 7, 5, 12)


def raw(spark, rows, extra=""):
    return spark.createDataFrame(rows, "content string, author string, created_at string, "
                                       "link string" + extra)


def posts(spark, rows):
    """rows: (account, hours after BASE, url, text)"""
    data = [(t, a, str(BASE + dt.timedelta(hours=h)), u) for a, h, u, t in rows]
    return preprocess_posts(raw(spark, data), influencer_col="author", timestamp_col="created_at",
                            text_col="content", url_col="link")


def test_handles_come_from_the_raw_text_in_any_case(spark):
    p = posts(spark, [("Alice", 0, None, "RT @Bob: hello"), ("alice", 1, None, "rt @bob: again"),
                      ("@Carol", 2, None, "hi @Dave and rt @erin"), ("bob", 3, None, "x @Dave @dave"),
                      ("Zed", 4, None, "Rt @BOB no colon")])
    got = {(r["src"], r["dst"]): r["posts"] for r in signals.retweet_edges(p).collect()}
    assert got == {("alice", "bob"): 2, ("zed", "bob"): 1}
    got = {(r["src"], r["dst"]): r["posts"] for r in signals.mention_edges(p).collect()}
    assert got == {("alice", "bob"): 2, ("carol", "dave"): 1, ("carol", "erin"): 1,
                   ("bob", "dave"): 1, ("zed", "bob"): 1}


def test_social_columns_of_the_source(spark):
    df = raw(spark, [("text one", "A", "2024-07-05", None, "@X, y  Z", "@Who", "#a, B"),
                     ("text two", "B", "2024-07-05", None, None, None, "a b")],
             ", mentions string, retweet_from string, hashtags string")
    p = preprocess_posts(df, influencer_col="author", timestamp_col="created_at",
                         text_col="content", url_col="link")
    got = {r["Influencer"]: (r["mentions"], r["retweet_from"]) for r in p.collect()}
    assert got == {"A": (["x", "y", "z"], "who"), "B": ([], None)}
    pair = signals.hashtag_overlap(p, hashtags_col="hashtags").first()
    assert pair["example1"] == "A" and pair["items1"] == 2 and pair["accounts1"] == 2


def test_equal_sets_are_one_class(spark):
    rows = [(f"u{k:03}", "a") for k in range(100)] + [("v", x) for x in "ab"] + \
        [("w", x) for x in "bcd"] + [("x", x) for x in "bcde"]
    sets = spark.createDataFrame(rows, "account string, item string")
    got = {(r["example1"], r["example2"]): (r["shared"], r["jaccard"], r["account_pairs"])
           for r in signals.set_overlap(sets, 0.5).collect()}
    assert got == {("u000", "u000"): (1, 1.0, 4950), ("u000", "v"): (1, 0.5, 100),
                   ("w", "x"): (3, 0.75, 1)}
    members = {r["account"]: (r["example"], r["items"])
               for r in signals.set_members(sets).collect()}
    assert members["u042"] == ("u000", 1) and members["x"] == ("x", 4) and len(members) == 103


def test_a_far_off_year_makes_no_long_array(spark):
    p = spark.createDataFrame([("0001-01-02 00:00:00",), ("2024-02-29 10:00:00",)], "t string") \
        .select(F.to_timestamp("t").alias("Timestamp"))
    got = overview.daily_volume(p).agg(F.count(F.lit(1)), F.countDistinct("day"), F.sum("posts"),
                              F.min("day"), F.max("day")).first()
    assert got[0] == got[1] == (dt.date(2024, 2, 29) - dt.date(1, 1, 2)).days + 1
    assert got[2] == 2 and got[3] == dt.date(1, 1, 2) and got[4] == dt.date(2024, 2, 29)
    late = p.where("Timestamp > '2000-01-01'").unionByName(
        spark.sql("SELECT timestamp '2024-03-01 01:30:00' AS Timestamp"))
    hours = overview.daily_volume(late, "hour").orderBy("bucket").collect()
    assert len(hours) == 16 and [hours[0]["posts"], hours[-1]["posts"]] == [1, 1]


def test_bursts(spark):
    u = "https://e.org/1"
    p = posts(spark, [("a", 0, u, "t0"), ("b", 2, u, "t1"), ("c", 7, u, "t2"), ("a", 20, u, "t3"),
                      ("a", 21, u, "t4"), ("b", 40, u, "t5"), ("c", 44, u, "t6"), ("d", 0, None, "t7")])
    got = {r["burst"]: (r["posts"], r["accounts"]) for r in signals.rapid_co_sharing(p).collect()}
    assert got == {1: (3, 3), 3: (2, 2)}


def test_cadence_has_an_exact_median(spark):
    p = posts(spark, [("a", h, None, f"t{h % 2}") for h in (0, 1, 3, 7, 15)]
              + [("b", 0, None, "x")])
    got = {r["Influencer"]: r for r in signals.account_cadence(p).collect()}
    assert got["a"]["median_gap_s"] == 3 * 3600 and got["a"]["mean_gap_s"] == 3.75 * 3600
    assert got["a"]["dup_text_share"] == 0.6
    assert got["b"]["median_gap_s"] is None and got["b"]["posts"] == 1


def test_repeated_texts_are_whole(spark):
    long = "same beginning " * 20
    p = posts(spark, [("a", 0, None, long + "x"), ("a", 1, None, long + "x"),
                      ("a", 2, None, long + "y"), ("a", 3, None, long + "y")])
    got = {r["text"]: r["posts"] for r in signals.repeated_text_sharing(p).collect()}
    assert got == {long + "x": 2, long + "y": 2}


def test_platform_spikes(spark):
    rows = [("a", 24 * d + k, "https://x.com/1", f"{d} {k}") for d in range(6)
            for k in range(8 if d == 5 else 1)] + [("b", 0, "https://t.me/1", "z")]
    got = {(r["Platform"], r["day"]): r["is_spike"]
           for r in signals.platform_spikes(posts(spark, rows)).collect()}
    assert [k for k, v in got.items() if v] == [("X", dt.date(2024, 7, 10))]
    assert len(got) == 7


@pytest.mark.parametrize("platforms, urls, want", [
    (["TikTok", None], ["https://x.com/1", "https://x.com/2"], {"TikTok", None}),
    ([None, None], ["https://x.com/1", None], {"X", "Unknown"}),
    ([None, None], [None, None], {"Unknown"})])
def test_platform_policy(spark, platforms, urls, want):
    df = raw(spark, [(f"text {k}", "a", "2024-07-05", u, p)
                     for k, (p, u) in enumerate(zip(platforms, urls, strict=True))],
             ", Platform string")
    p = preprocess_posts(df, influencer_col="author", timestamp_col="created_at",
                         text_col="content", url_col="link")
    assert {r["Platform"] for r in p.collect()} == want


def test_channel_report(spark):
    df = raw(spark, [(f"t{k}", "a", "2024-07-05", None, c) for k, c in enumerate("xxy")],
             ", Channel string")
    p = preprocess_posts(df, influencer_col="author", timestamp_col="created_at",
                         text_col="content", url_col="link")
    assert [tuple(r) for r in overview.top_outlets(p).collect()] == [("x", 2), ("y", 1)]


def test_hourly_volume(spark):
    p = posts(spark, [("a", 0, None, "t0"), ("a", 2, None, "t1")])
    assert [r["posts"] for r in overview.daily_volume(p, "hour").orderBy("bucket").collect()] \
        == [1, 0, 1]


def test_require_nonempty(spark):
    df = spark.range(1)
    assert require_nonempty(df, "x") is df
    with pytest.raises(NoDataError):
        require_nonempty(df.where("false"), "x")


def test_incidence_holds_the_edges(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (0, "b"), (1, "a"), (1, "c"), (2, "d"), (-1, "e"),
                                (-1, "a")], "cluster int, Influencer string")
    rows = account_clusters(df).collect()
    by = {}
    for r in rows:
        by.setdefault(r["cluster"], set()).add(r["influencer"])
    pairs = {(a, b) for s in by.values() for a in s for b in s if a < b}
    assert pairs == {(r["src"], r["dst"]) for r in co_cluster_edges(df).collect()}
    assert all(r["co_accounts"] == len(by[r["cluster"]]) - 1 for r in rows)


def test_composed_analyses(spark, sf001):
    from murmuration.operators.preprocess import materialized_posts

    p = materialized_posts(spark, sf001)
    for report in (analyses.overview_report, analyses.coordination_report,
                   analyses.network_report):
        out = report(p, analyses.Filters(start="2024-01-01", end="2024-01-20"))
        assert out
        for df in out.values():
            if hasattr(df, "columns"):
                df.limit(3).collect()
    assert p.where(F.col("mentions").isNull()).count() == 0


def test_network_report_has_every_account_by_default(spark, sf001, monkeypatch):
    from types import SimpleNamespace

    from murmuration.operators.preprocess import materialized_posts

    p = materialized_posts(spark, sf001)
    number = F.abs(F.hash("post_id"))
    posts = p.withColumn("cluster", (number % 7).cast("long")).withColumn(
        "Influencer", F.concat(F.lit("a"), (number % 70).cast("string")))
    monkeypatch.setattr(analyses.cluster, "cluster_posts", lambda _: SimpleNamespace(posts=posts))
    out = analyses.network_report(p)
    want = {r[0] for r in posts.select("Influencer").distinct().collect()}
    assert len(want) > 50
    got = {r["influencer"] for r in out["incidence"].collect()}
    assert got == want
