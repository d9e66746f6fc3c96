"""Prefix-filtered cosine join vs the naive join; narrative reports vs a pair-level brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from murmuration.operators import narratives, tfidf
from murmuration.operators.preprocess import posts_from_fixture
from murmuration.operators.simjoin import cosine_pairs, jaccard_pairs, naive_cosine_pairs


@pytest.fixture(scope="module")
def fixture_posts(spark, sf001):
    return posts_from_fixture(spark, sf001).cache()


@pytest.fixture(scope="module")
def postings(fixture_posts):
    groups = tfidf.text_groups(narratives.similarity_input(fixture_posts))
    return tfidf.tfidf_postings(groups, 10000).cache()


def _pairs(df):
    return {(r["tid1"]["k0"], r["tid2"]["k0"]): round(r["similarity"], 9) for r in df.collect()}


@pytest.mark.parametrize("t,floor", [(0.85, None), (0.85, 0.5), (0.7, None), (0.5, 0.3), (0.3, None)])
def test_prefix_join_equals_naive(postings, t, floor):
    fast, slow = _pairs(cosine_pairs(postings, t, floor)), _pairs(naive_cosine_pairs(postings, t))
    assert fast == slow
    assert fast  # the fixture has similar texts at every tested threshold


def test_unit_norm(postings):
    norms = postings.groupBy("tid").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms)


def _brute(posts_rows, pairs_by_text):
    """Pair-level expansion, as the reference builds its table (post order = post_id)."""
    rows = sorted(posts_rows, key=lambda r: r["post_id"])
    out = []
    for a, b in itertools.combinations(rows, 2):
        key = (a["text"], b["text"])
        if a["text"] == b["text"] and a["nz"] or key in pairs_by_text or key[::-1] in pairs_by_text:
            out.append((a, b))
    return out


def test_narratives_with_hot_copy_group(spark):
    """Many copies of one text plus near variants: summaries without pair expansion must equal
    the counts from explicit pairs."""
    from murmuration.operators.preprocess import with_post_order

    base = "coordinated message about the election fraud claims spreading fast today"
    texts = [base] * 40 + [base + " now"] * 5 + ["completely different words here"] * 3 \
        + ["another unrelated sentence entirely"]
    rows = [(i, t, f"acct{i % 7}", ["X", "TikTok", "Media"][i % 3]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "post_id long, original_text string, Influencer string, Platform string")
    df = df.withColumn("Timestamp", F.timestamp_seconds(F.col("post_id"))).withColumn("URL", F.lit(None).cast("string"))
    df = with_post_order(df, ["post_id"])
    sim = narratives.find_similarities(df, 0.85, prefiltered=True)
    text_pairs = {(r["tid1"]["k0"], r["tid2"]["k0"]) for r in sim.pairs.collect()}
    tids = {r["tid"]["k0"]: (r["text"], r["nz"]) for r in sim.texts.collect()}
    by_text = {(tids[a][0], tids[b][0]) for a, b in text_pairs}
    prow = [dict(post_id=i, text=t, infl=f"acct{i % 7}", plat=["X", "TikTok", "Media"][i % 3],
                 nz=True) for i, t in enumerate(texts)]
    pairs = _brute(prow, by_text)
    # share counts per snippet (first post's text; all < 150 chars)
    expected = {}
    for a, b in pairs:
        expected[a["text"]] = expected.get(a["text"], 0) + 1
    got = {r["shared_narrative"]: r["share_count"] for r in narratives.narrative_summary(sim).collect()}
    assert got == expected
    # appearances per account
    app = {}
    for a, b in pairs:
        app[a["infl"]] = app.get(a["infl"], 0) + 1
        app[b["infl"]] = app.get(b["infl"], 0) + 1
    cc = {r["Influencer"]: r["coordination_instances"]
          for r in narratives.coordination_counts(sim).collect() if r["coordination_instances"]}
    assert cc == app
    # the pair table and the copies stand for the same pairs
    table = narratives.similar_pairs(sim).collect()
    copies = {r["text_post_id"]: r["copies"] for r in narratives.text_members(sim).collect()}
    assert sum(r["copies1"] * r["copies2"] for r in table) \
        + sum(c * (c - 1) // 2 for c in copies.values()) == len(pairs)
    assert all(r["post_id1"] < r["post_id2"] for r in table)


def test_share_counts_of_interleaved_copies(spark):
    """Similar texts whose posts alternate in time: counts by direction, against pairs."""
    from murmuration.operators.preprocess import with_post_order

    base = "coordinated message about the election fraud claims spreading fast today"
    kinds = [base, base + " now", base + " here", base + " again please"]
    texts = [kinds[(i * i + i // 3) % 4] for i in range(60)]
    df = spark.createDataFrame([(i, t, f"a{i % 5}", "X") for i, t in enumerate(texts)],
                               "post_id long, original_text string, Influencer string, Platform string")
    df = with_post_order(df.withColumn("Timestamp", F.timestamp_seconds(F.col("post_id")))
                         .withColumn("URL", F.lit(None).cast("string")), ["post_id"])
    sim = narratives.find_similarities(df, 0.8, prefiltered=True)
    names = {r["tid"]["k0"]: r["text"] for r in sim.texts.collect()}
    linked = {frozenset((names[r["tid1"]["k0"]], names[r["tid2"]["k0"]]))
              for r in sim.pairs.collect()}
    assert linked
    expected = {}
    for a, b in itertools.combinations(texts, 2):
        if a == b or frozenset((a, b)) in linked:
            expected[a] = expected.get(a, 0) + 1
    got = {r["shared_narrative"]: r["share_count"] for r in narratives.narrative_summary(sim).collect()}
    assert got == expected


def test_jaccard_join_equals_brute_force(spark):
    import random

    rnd = random.Random(7)
    sets = {k: {rnd.randrange(30) for _ in range(rnd.randrange(1, 12))} for k in range(60)}
    sets[60] = set(range(25))  # a large set sharing items with most others
    rows = [(k, i) for k, s in sets.items() for i in s]
    df = spark.createDataFrame(rows, "key long, item long")
    for t in (0.3, 0.5, 0.8):
        got = {(r["k1"], r["k2"]) for r in jaccard_pairs(df, t).collect()}
        exp = {(a, b) for a, b in itertools.combinations(sorted(sets), 2)
               if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert got == exp, t
