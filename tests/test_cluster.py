"""Components and DBSCAN-equivalent clustering vs brute force."""

import random

import pytest
from pyspark.sql import functions as F

from murmuration.operators import cluster, tfidf
from murmuration.operators.components import connected_components
from murmuration.operators.preprocess import posts_from_fixture
from murmuration.operators.simjoin import naive_cosine_pairs


def _union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_connected_components_random_graph(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)]
    edges += [(i, i + 1) for i in range(400, 460)]  # a long path (many rounds for naive labels)
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["comp"] for r in connected_components(df).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    exp = _union_find(nodes, [e for e in edges if e[0] != e[1]])
    assert got == {n: min(k for k in nodes if exp[k] == exp[n]) for n in nodes}


def _dbscan(ids, neighbors, min_samples):
    """Textbook DBSCAN over precomputed neighbourhoods (self included), points in id order."""
    labels, cid = {}, 0
    core = {p for p in ids if len(neighbors[p]) >= min_samples}
    for p in ids:
        if p in labels or p not in core:
            continue
        labels[p] = cid
        stack = [p]
        while stack:
            q = stack.pop()
            for r in neighbors[q]:
                if r not in labels:
                    labels[r] = cid
                    if r in core:
                        stack.append(r)
        cid += 1
    return {p: labels.get(p, -1) for p in ids}


@pytest.mark.parametrize("min_samples", [2, 3])
def test_cluster_posts_matches_dbscan(spark, sf001, min_samples):
    posts = cluster.clustering_input(posts_from_fixture(spark, sf001)).cache()
    got = {r["post_id"]: r["cluster"] for r in
           cluster.cluster_posts(posts, min_samples=min_samples, prefiltered=True).posts.collect()}
    groups = tfidf.text_groups(posts)
    postings = tfidf.tfidf_postings(groups)
    tpairs = naive_cosine_pairs(postings, 0.7).collect()
    nz = {r["tid"]["k0"] for r in postings.select("tid").distinct().collect()}
    members = {r["post_id"]: r["tid"]["k0"] for r in posts.join(
        groups.select(F.col("text").alias("original_text"), "tid"), "original_text").collect()}
    by_text = {}
    for p, t in members.items():
        by_text.setdefault(t, []).append(p)
    adj = {t: set() for t in by_text}
    for r in tpairs:
        adj[r["tid1"]["k0"]].add(r["tid2"]["k0"])
        adj[r["tid2"]["k0"]].add(r["tid1"]["k0"])
    ids = sorted(members)
    neighbors = {}
    for p in ids:
        t = members[p]
        nb = set(by_text[t]) if t in nz else set()
        for u in adj[t]:
            nb |= set(by_text[u])
        neighbors[p] = nb
    exp = _dbscan(ids, neighbors, min_samples)
    assert got == exp
    assert len(set(exp.values())) > 2


def test_cluster_summary_and_sizes(spark, sf001):
    posts = posts_from_fixture(spark, sf001)
    c = cluster.cluster_posts(posts)
    sizes = {r["cluster"]: r["posts"] for r in cluster.cluster_sizes(c.posts).collect()}
    assert sum(sizes.values()) == c.posts.count()
    summ = cluster.cluster_summary(c.posts).collect()
    assert {r["cluster"] for r in summ} == {k for k in sizes if k != -1}
    assert all(r["num_posts"] == sizes[r["cluster"]] for r in summ)


def test_empty_vocabulary_is_cluster_zero(spark):
    from murmuration.operators.preprocess import with_post_order

    df = spark.createDataFrame([(1, "the and of", "the and of"), (2, "a an", "a an")],
                               "post_id long, text string, original_text string")
    df = with_post_order(df.withColumn("Timestamp", F.current_timestamp()), ["post_id"])
    got = [r["cluster"] for r in cluster.cluster_posts(df, prefiltered=True).posts.collect()]
    assert got == [0, 0]
