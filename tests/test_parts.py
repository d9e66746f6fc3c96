"""Posts without their texts: the same rows, and the parts of the texts that are kept."""

import datetime as dt

from pyspark.sql import functions as F

from murmuration.operators import signals
from murmuration.operators.preprocess import TEXT_PARTS, posts_from_fixture, preprocess_posts
from murmuration.sources.fixtures import FIXTURE_ROLES, event_posts, raw_posts


def _tables(spark, path):
    """Two documents of one id and different texts, a repeated one, and missing or blank texts."""
    docs = [(0, "one #a text", "en", "s"), (0, "another text @b", "en", "s"), (1, "x", "en", "s"),
            (1, "x", "en", "s"), (2, None, "en", "s"), (3, "  ", "en", "s"), (4, "nan", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string") \
        .coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, f"https://a.b/{k}") for k in range(3)],
                          "page_id long, url string").coalesce(1) \
        .write.parquet(f"{path}/pages.parquet")
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k, t + dt.timedelta(hours=k), k % 3) for k in range(40)],
                          "event_id long, ts timestamp, user_id long").coalesce(1) \
        .write.parquet(f"{path}/events.parquet")
    return str(path)


def test_lean_posts_are_the_same_rows(spark, tmp_path):
    path = _tables(spark, tmp_path)
    for read in (raw_posts, event_posts):
        full = preprocess_posts(read(spark, path), **FIXTURE_ROLES)
        lean = preprocess_posts(read(spark, path, texts=False), parts=[], **FIXTURE_ROLES)
        cols = ["post_id", "Influencer", "Timestamp", "URL", "Platform", "post_order"]
        assert sorted(map(tuple, full.select(*cols).collect()), key=repr) \
            == sorted(map(tuple, lean.select(*cols).collect()), key=repr)
        assert "text" not in lean.columns


def test_parts_are_those_of_the_texts(spark, sf001):
    from murmuration.functions.text import hashtags

    full = posts_from_fixture(spark, sf001).select(
        "post_id", F.sha2("original_text", 256), hashtags(F.col("text")), "mentions", "retweet_from")
    lean = posts_from_fixture(spark, sf001, parts=TEXT_PARTS).select("post_id", *TEXT_PARTS)
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    want = [tuple(None if x == empty else x for x in r) for r in full.collect()]
    assert sorted(want, key=repr) == sorted(map(tuple, lean.collect()), key=repr)


def test_no_text_in_a_shuffle(spark, sf001):
    plan = posts_from_fixture(spark, sf001, events=True, parts=["text_digest"]) \
        ._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate" in line]
    assert grouped and not any("content" in line for line in grouped)


def test_repeated_texts_from_digests(spark, tmp_path):
    path = _tables(spark, tmp_path)
    want = signals.repeated_text_sharing(posts_from_fixture(spark, path, events=True))
    got = signals.repeated_text_sharing(
        posts_from_fixture(spark, path, events=True, parts=["text_digest"]),
        with_texts=lambda ids: posts_from_fixture(spark, path, events=True, only=ids))
    rows = sorted(map(tuple, want.collect()), key=repr)
    assert rows and rows == sorted(map(tuple, got.collect()), key=repr)


def test_terms_are_counted_without_a_shuffle_of_their_own(spark, sf001):
    from murmuration.operators import narratives, tfidf

    groups = tfidf.text_groups(narratives.similarity_input(posts_from_fixture(spark, sf001)))

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert shuffles(tfidf.term_counts(groups)) == shuffles(groups)


def test_equal_texts_are_one_group(spark):
    from murmuration.operators import tfidf

    rows = [(3, "b a"), (1, "b a"), (2, "a"), (4, "")]
    posts = spark.createDataFrame(rows, "post_id long, original_text string") \
        .withColumn("post_order", F.struct("post_id"))
    groups = tfidf.text_groups(posts)
    assert sorted((r.tid.post_id, r.text, r.c) for r in groups.collect()) \
        == [(1, "b a", 2), (2, "a", 1), (4, "", 1)]
    assert sorted((r.post_id, r.tid.post_id) for r in
                  tfidf.text_of_posts(posts, groups, "tid").collect()) \
        == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_postings_are_made_in_their_blocks(spark):
    """No window and one exchange by block at most holds postings; copies count as often as they are."""
    import math

    from murmuration.operators import tfidf

    rows = [(0, "red fox red", 3), (1, "red hen", 1), (2, "the of", 5), (3, "", 2)]
    groups = spark.createDataFrame(rows, "tid long, text string, c long")
    out = tfidf.tfidf_postings(groups, stop_words=["the", "of"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and out.columns == ["tid", "term", "df", "w"]
    idf = {t: math.log(12 / (df + 1)) + 1 for t, df in (("red", 4), ("fox", 3), ("hen", 1))}
    raw = {0: {"red": 2 * idf["red"], "fox": idf["fox"]}, 1: {"red": idf["red"], "hen": idf["hen"]}}
    want = {(i, t): w / math.sqrt(sum(x * x for x in ws.values()))
            for i, ws in raw.items() for t, w in ws.items()}
    got = {(r["tid"], r["term"]): r["w"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    top = {r["term"] for r in tfidf.tfidf_postings(groups, 1, ["the", "of"]).collect()}
    assert top == {"red"}
