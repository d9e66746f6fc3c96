"""Coordination signals the reference's README promises (shared URLs, spikes, repeated sharing,
rapid co-sharing, hashtag/content overlap, interaction edges, account cadence).

The reference ships no code for these; the definitions here are ours and documented per function.
All are aggregations, windows and joins; hot keys (a URL or account holding a third of the posts)
go through partial aggregation or the range-partitioned ``previous_in_group`` instead of a single
window partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.functions.stopwords import default_stop_words
from murmuration.functions.text import handle, is_nonblank, tokens
from murmuration.operators.overview import calendar, daily_volume, text_tags
from murmuration.operators.ranking import count_before, dense_index, previous_in_group
from murmuration.operators.setjoin import (account_sets, jaccard_pairs, set_blocks,
                                           sketched_pairs)
from murmuration.operators.simjoin import prefix_items
from murmuration.session import cut_lineage

TIME_ORDER = "time_order"


def _time_order(df: DataFrame) -> DataFrame:
    return df.withColumn(TIME_ORDER, F.struct(F.col("Timestamp").alias("ts"),
                                              F.col("post_id").alias("id")))


def top_shared_urls(posts: DataFrame, k: int = 10) -> DataFrame:
    """URLs by number of posts, with the number of distinct accounts sharing them."""
    return (posts.where(F.col("URL").isNotNull()).groupBy("URL")
            .agg(F.count(F.lit(1)).alias("posts"), F.countDistinct("Influencer").alias("accounts"))
            .orderBy(F.desc("posts"), F.asc("URL")).limit(k))


def posting_spikes(posts: DataFrame, lookback: int = 7, z: float = 2.0,
                   min_history: int = 3) -> DataFrame:
    """Daily volume with a spike flag: count > mean + z * stddev_pop of the previous
    ``lookback`` days (needs ``min_history`` of them). The calendar has one row per day of the
    covered range, so the ordered window runs over days, not posts."""
    vol = daily_volume(posts)
    w = Window.orderBy("day").rowsBetween(-lookback, -1)
    x = vol.select("day", "posts",
                   F.avg("posts").over(w).alias("baseline_mean"),
                   F.stddev_pop("posts").over(w).alias("baseline_std"),
                   F.count("posts").over(w).alias("history"))
    spike = (F.col("history") >= min_history) & \
        (F.col("posts") > F.col("baseline_mean") + F.lit(z) * F.col("baseline_std"))
    return x.select("day", "posts", F.round("baseline_mean", 6).alias("baseline_mean"),
                    F.round("baseline_std", 6).alias("baseline_std"),
                    F.coalesce(spike, F.lit(False)).alias("is_spike"))


def platform_spikes(posts: DataFrame, lookback: int = 7, z: float = 2.0,
                    min_history: int = 3) -> DataFrame:
    """``posting_spikes`` per platform, over each platform's own range of days."""
    p = posts.where(F.col("Platform").isNotNull())
    day = F.to_date("Timestamp")
    counts = p.groupBy("Platform", day.alias("day")).agg(F.count(F.lit(1)).alias("posts"))
    days = calendar(counts.groupBy("Platform").agg(F.min("day").alias("lo"),
                                                   F.max("day").alias("hi")), "day")
    vol = (days.join(counts, ["Platform", "day"], "left")
           .select("Platform", "day", F.coalesce("posts", F.lit(0)).cast("long").alias("posts")))
    # one row per platform and day
    w = Window.partitionBy("Platform").orderBy("day").rowsBetween(-lookback, -1)
    mean, std = F.avg("posts").over(w), F.stddev_pop("posts").over(w)
    spike = (F.count("posts").over(w) >= min_history) & (F.col("posts") > mean + F.lit(z) * std)
    return vol.select("Platform", "day", "posts", F.round(mean, 6).alias("baseline_mean"),
                      F.round(std, 6).alias("baseline_std"),
                      F.coalesce(spike, F.lit(False)).alias("is_spike"))


def repeated_url_sharing(posts: DataFrame, min_posts: int = 2) -> DataFrame:
    """(account, URL) pairs shared at least ``min_posts`` times, with first/last time."""
    return (posts.where(F.col("URL").isNotNull()).groupBy("Influencer", "URL")
            .agg(F.count(F.lit(1)).alias("posts"), F.min("Timestamp").alias("first_time"),
                 F.max("Timestamp").alias("last_time"))
            .where(F.col("posts") >= min_posts))


def repeated_text_sharing(posts: DataFrame, min_posts: int = 2,
                          with_texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(account, text) pairs posted at least ``min_posts`` times, with the whole text.

    Posts are grouped by their texts' digests, and only the text of one post a pair is then read:
    from ``posts``, or if these hold ``text_digest`` alone, from the posts that ``with_texts``
    returns for a table of ``post_id``s."""
    text = F.col("original_text")
    sha = F.sha2(text, 256).alias("text_digest")
    lean = posts if with_texts else posts.where(is_nonblank(text)).select(
        "post_id", "Influencer", "Timestamp", sha)
    groups = cut_lineage(
        lean.where(F.col("text_digest").isNotNull()).groupBy("Influencer", "text_digest")
        .agg(F.count(F.lit(1)).alias("posts"), F.min("Timestamp").alias("first_time"),
             F.max("Timestamp").alias("last_time"), F.min("post_id").alias("post_id"))
        .where(F.col("posts") >= min_posts))
    ids = groups.select("post_id").distinct()
    shown = with_texts(ids) if with_texts else posts.join(ids, "post_id", "left_semi")
    texts = shown.where(is_nonblank(text)).select("post_id", text.alias("text"), sha).distinct()
    return groups.join(texts, ["post_id", "text_digest"]).select(
        "Influencer", "text", "posts", "first_time", "last_time")


def rapid_co_sharing(posts: DataFrame, window_hours: float = 6.0) -> DataFrame:
    """Bursts: several accounts posting one URL in quick succession.

    The posts of a URL, in time order, belong to one burst while each follows the one before it
    by at most ``window_hours``. One row per burst of two or more accounts, so a burst of k
    accounts is one row and not k^2/2 pairs. Bursts of a URL are numbered from 1.
    """
    x = _time_order(posts.where(F.col("URL").isNotNull())
                    .select("URL", "Influencer", "Timestamp", "post_id"))
    x = previous_in_group(x, "URL", TIME_ORDER, [])
    gap = F.col("Timestamp").cast("double") - F.col("prev.o.ts").cast("double")
    x = x.select("URL", "Influencer", "Timestamp", TIME_ORDER,
                 (F.col("prev").isNull() | (gap > F.lit(window_hours * 3600.0))).alias("starts"))
    x = count_before(x, ["URL"], TIME_ORDER, "starts", "earlier")
    return (x.groupBy("URL", (F.col("earlier") + F.col("starts").cast("long")).alias("burst"))
            .agg(F.count(F.lit(1)).alias("posts"),
                 F.countDistinct("Influencer").alias("accounts"),
                 F.min("Timestamp").alias("first_time"), F.max("Timestamp").alias("last_time"))
            .where(F.col("accounts") >= 2))


def co_share_edges(posts: DataFrame, window_hours: float = 6.0, min_urls: int = 3) -> DataFrame:
    """``(account1 < account2, urls)``: accounts that shared at least ``min_urls`` URLs within
    ``window_hours`` of each other, and how many.

    An interval join on (URL, time bucket of the window's length): time within a bucket is always
    close, of neighbouring buckets the last and first posts decide, so one row per account, URL and
    bucket is enough, however often the account posted; accounts and URLs are numbered. Where an
    overlap join spares most of the meetings it goes first: pairs are then formed only on the URLs
    of the accounts' prefixes (``prefix_items``): a URL that everybody shares is the last of every
    list, and joined only for accounts with too few rarer ones; accounts of fewer than ``min_urls``
    URLs drop out before. Where accounts share so many URLs that their prefixes hold most of them,
    it would list every pair's URLs beside those that it shares, and all meetings are formed at once.
    """
    width = int(window_hours * 3_600_000_000)
    at = F.unix_micros("Timestamp")
    named = cut_lineage(
        posts.where(F.col("URL").isNotNull() & F.col("Influencer").isNotNull())
        .groupBy("Influencer", "URL", F.floor(at / F.lit(width)).alias("bucket"))
        .agg(F.min(at).alias("lo"), F.max(at).alias("hi")))
    accounts = cut_lineage(dense_index(named.select("Influencer").distinct(), "Influencer", "account"))
    urls = dense_index(named.select("URL").distinct(), "URL", "link")
    cells = cut_lineage(named.join(accounts, "Influencer").join(urls, "URL").select(
        "account", "link", "bucket", "lo", "hi"))

    def side(rows: DataFrame, k: int) -> DataFrame:
        return rows.select("link", *[F.col(c).alias(f"{c}{k}")
                                    for c in ("account", "bucket", "lo", "hi")])

    def spread(rows: DataFrame) -> DataFrame:
        """Each cell under its own bucket and both neighbours."""
        near = F.sequence(F.col("bucket2") - 1, F.col("bucket2") + 1)
        return rows.withColumn("bucket1", F.explode(near))

    step = F.col("bucket2") - F.col("bucket1")
    close = (F.when(step == 0, True)
             .when(step == 1, F.col("lo2") - F.col("hi1") <= width)
             .otherwise(F.col("lo1") - F.col("hi2") <= width))

    def meetings(rows: DataFrame) -> DataFrame:
        return (side(rows, 1).join(spread(side(rows, 2)), ["link", "bucket1"])
                .where((F.col("account1") < F.col("account2")) & close)
                .select("account1", "account2", "link"))

    pre = cut_lineage(prefix_items(cells, min_urls, "account", "link"))
    few = cells.join(pre, ["account", "link"], "left_semi")
    if _spares_little(few, cells):
        met = meetings(cells)
    else:
        cand = cut_lineage(meetings(cut_lineage(few)).select("account1", "account2").distinct())
        met = (cand.join(side(cells, 1), "account1")
               .join(spread(side(cells, 2)), ["account2", "link", "bucket1"]).where(close))
    edges = (met.select("account1", "account2", "link").distinct()
             .groupBy("account1", "account2").agg(F.count(F.lit(1)).alias("urls"))
             .where(F.col("urls") >= min_urls))
    for k in (1, 2):
        edges = edges.withColumnRenamed(f"account{k}", "account").join(accounts, "account") \
            .drop("account").withColumnRenamed("Influencer", f"account{k}")
    return edges.select("account1", "account2", "urls")


def _spares_little(few: DataFrame, cells: DataFrame) -> bool:
    """Whether the cells ``few`` form a quarter or more of the meetings of all ``cells``."""
    def formed(rows: DataFrame) -> int:
        n = rows.groupBy("link", "bucket").agg(F.count(F.lit(1)).alias("n"))
        near = n.select("link", F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1))
                        .alias("bucket"), F.col("n").alias("m"))
        return n.join(near, ["link", "bucket"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0

    return 4 * formed(few) >= formed(cells)


def hashtag_bags(posts: DataFrame, hashtags_col: str | None = None) -> DataFrame:
    """``(account, items)`` per post: its hashtags, from the text or from ``hashtags_col`` (a comma-
    or space-separated list, with or without ``#``)."""
    if hashtags_col:
        listed = F.split(F.lower(F.coalesce(F.col(hashtags_col), F.lit(""))), r"[,\s]+")
        tags = F.transform(F.filter(listed, lambda t: F.length(F.ltrim(t, F.lit("#"))) > 0),
                           lambda t: F.concat(F.lit("#"), F.ltrim(t, F.lit("#"))))
    else:
        tags = text_tags(posts)
    return posts.select(F.col("Influencer").alias("account"), tags.alias("items"))


def hashtag_sets(posts: DataFrame, hashtags_col: str | None = None) -> DataFrame:
    """``(account, item)``: the distinct hashtags of every account (see ``hashtag_bags``)."""
    return hashtag_bags(posts, hashtags_col).select("account", F.explode("items").alias("item")) \
        .distinct()


def content_bags(posts: DataFrame) -> DataFrame:
    """``(account, items)`` per post: the tokens of its text."""
    return posts.select(F.col("Influencer").alias("account"),
                        tokens(F.col("original_text")).alias("items"))


def content_sets(posts: DataFrame, stop_words=None) -> DataFrame:
    """``(account, item)``: the distinct non-stop-word tokens of all posts of every account."""
    stop = list(default_stop_words() if stop_words is None else stop_words)
    sets = content_bags(posts).select("account", F.explode("items").alias("item"))
    return (sets.where(~F.col("item").isin(stop)) if stop else sets).distinct()


def _prints(sets: DataFrame) -> DataFrame:
    """``(account, items, h1, h2)``: size and 128-bit fingerprint of each account's distinct
    items; a fixed-size state an account, so no set is collected."""
    return sets.groupBy("account").agg(F.count(F.lit(1)).alias("items"),
                                       F.bit_xor(F.xxhash64("item")).alias("h1"),
                                       F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("h2"))


def set_members(sets: DataFrame) -> DataFrame:
    """``(account, example, items)``: accounts with equal sets share the ``example`` account (the
    smallest of them), the class that ``set_overlap`` reports."""
    prints = _prints(sets)
    keys = ["items", "h1", "h2"]
    least = prints.groupBy(*keys).agg(F.min("account").alias("example"))
    return prints.join(least, keys).select("account", "example", "items")


def set_overlap(sets: DataFrame, threshold: float,
                pairs: Callable[..., DataFrame] = jaccard_pairs) -> DataFrame:
    """Pairs of overlapping sets (Jaccard >= ``threshold``) from ``(account, item)`` rows.

    Accounts with equal sets are one class, named by its smallest account (a hashtag used by a
    third of all accounts makes many equal one-tag sets). The exact Jaccard join runs over one
    set a class; a row stands for ``account_pairs`` pairs of accounts. A class of several
    accounts is also a pair with itself (Jaccard 1). ``set_members`` gives each account's class.
    """
    return bag_overlap(sets.select("account", F.array("item").alias("items")), threshold, pairs)


def bag_overlap(bags: DataFrame, threshold: float, pairs: Callable[..., DataFrame] = jaccard_pairs,
                stop_words=None) -> DataFrame:
    """``set_overlap`` of the items of all ``(account, items)`` rows of an account."""
    sets = account_sets(bags, stop_words)
    classes = cut_lineage(sets.groupBy("items", "digest").agg(
        F.min("account").alias("example"), F.count(F.lit(1)).alias("accounts"))
        .where(F.col("example").isNotNull()).select("example", "items", "accounts"))
    one = classes.select("example", "accounts").join(
        sets.select(F.col("account").alias("example"), "items", "rks"), "example")
    cross = pairs(set_blocks(one), threshold) \
        .withColumn("account_pairs", F.col("accounts1") * F.col("accounts2"))
    same = classes.where("accounts >= 2").select(
        *[F.col(c).alias(f"{c}{k}") for k in (1, 2) for c in classes.columns],
        F.col("items").alias("shared"), F.lit(1.0).alias("jaccard"),
        (F.col("accounts") * (F.col("accounts") - 1) / 2).cast("long").alias("account_pairs"))
    cols = ["example1", "example2", "items1", "items2", "accounts1", "accounts2", "shared",
            F.round("jaccard", 6).alias("jaccard"), "account_pairs"]
    return cross.select(*cols).unionByName(same.select(*cols))


def hashtag_overlap(posts: DataFrame, threshold: float = 0.5,
                    hashtags_col: str | None = None) -> DataFrame:
    """Groups of accounts with overlapping hashtag sets (see ``set_overlap``)."""
    return bag_overlap(hashtag_bags(posts, hashtags_col), threshold)


def _content_overlap(posts: DataFrame, threshold: float, stop_words, pairs) -> DataFrame:
    stop = list(default_stop_words() if stop_words is None else stop_words)
    return bag_overlap(content_bags(posts), threshold, pairs, stop)


def content_overlap(posts: DataFrame, threshold: float = 0.5, stop_words=None) -> DataFrame:
    """Groups of accounts with overlapping vocabularies (see ``set_overlap``)."""
    return _content_overlap(posts, threshold, stop_words, jaccard_pairs)


def content_overlap_sketched(posts: DataFrame, threshold: float = 0.5,
                             stop_words=None) -> DataFrame:
    """``content_overlap`` from MinHash candidates: a subset of it; shared words are counted for
    these only."""
    return _content_overlap(posts, threshold, stop_words, sketched_pairs)


def mention_edges(posts: DataFrame) -> DataFrame:
    """Directed author -> mentioned-account edges; weight = posts mentioning (once per post).

    Handles come from preprocessing (the raw text or a ``mentions`` column); both ends are in
    the compared form (lower case, no ``@``), so they join with each other."""
    x = posts.select(handle(F.col("Influencer")).alias("src"), F.explode("mentions").alias("dst"))
    return x.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("posts"))


def retweet_edges(posts: DataFrame) -> DataFrame:
    """Directed author -> retweeted-account edges, from the raw text's leading ``RT @user`` in
    any case or a ``retweet_from`` column."""
    x = (posts.select(handle(F.col("Influencer")).alias("src"), F.col("retweet_from").alias("dst"))
         .where(F.col("dst") != ""))
    return x.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("posts"))


def account_cadence(posts: DataFrame) -> DataFrame:
    """Per account: posts, active days, posts per active day, shortest, mean and median gap
    between consecutive posts (seconds), and the share of posts repeating an earlier text.

    Only hashes of texts are shuffled. The median is exact: the middle gaps are found by their
    rank, which is counted over range partitions, so a hot account spans many tasks."""
    sha = (F.col("text_digest") if "text_digest" in posts.columns
           else F.nullif(F.sha2("original_text", 256), F.sha2(F.lit(""), 256)))
    lean = posts.select("Influencer", "Timestamp", "post_id",
                        F.coalesce(sha, F.lit("")).alias("text_hash"))
    x = previous_in_group(_time_order(lean.drop("text_hash")), "Influencer", TIME_ORDER, [])
    gap = F.col("Timestamp").cast("double") - F.col("prev.o.ts").cast("double")
    x = x.select("Influencer", gap.alias("gap"), "post_id")
    base = x.groupBy("Influencer").agg(
        F.count(F.lit(1)).alias("posts"), F.count("gap").alias("gaps"),
        F.min("gap").alias("min_gap_s"), F.avg("gap").alias("mean_gap_s"))
    days = (lean.select("Influencer", F.to_date("Timestamp").alias("day")).distinct()
            .groupBy("Influencer").agg(F.count(F.lit(1)).alias("active_days")))
    texts = (lean.select("Influencer", "text_hash").distinct()
             .groupBy("Influencer").agg(F.count(F.lit(1)).alias("distinct_texts")))
    ranked = count_before(x.where(F.col("gap").isNotNull())
                          .withColumn("gap_order", F.struct("gap", "post_id")),
                          ["Influencer"], "gap_order", None, "rank")
    middle = (ranked.join(base.select("Influencer", "gaps"), "Influencer")
              .where(F.col("rank").between(F.floor((F.col("gaps") - 1) / 2),
                                           F.floor(F.col("gaps") / 2)))
              .groupBy("Influencer").agg(F.avg("gap").alias("median_gap_s")))
    out = (base.join(days, "Influencer").join(texts, "Influencer")
           .join(middle, "Influencer", "left"))
    return out.select("Influencer", "posts", "active_days",
                      F.round(F.col("posts") / F.col("active_days"), 6).alias("posts_per_day"),
                      F.round("min_gap_s", 3).alias("min_gap_s"),
                      F.round("mean_gap_s", 3).alias("mean_gap_s"),
                      F.round("median_gap_s", 3).alias("median_gap_s"),
                      F.round(1 - F.col("distinct_texts") / F.col("posts"), 6)
                      .alias("dup_text_share"))
