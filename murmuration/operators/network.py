"""Account interaction network built from clustered posts: edges and node attributes.

The graph of all clusters and accounts is an incidence table (``account_clusters``) and a node
table (``graph_nodes``), both linear in the posts. Expanded account edges are for drawing a
selection: the accounts of the largest clusters, most active first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.operators.cluster import NOISE
from murmuration.operators.preprocess import ORDER
from murmuration.operators.ranking import dense_index
from murmuration.operators.simjoin import overlap_candidates
from murmuration.session import cut_lineage

# The node sizes drawn.
MIN_NODE_SIZE, MAX_NODE_SIZE = 10.0, 25.0


def top_clusters(clustered: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest non-noise clusters (``cluster, posts``); ties by cluster id."""
    return (clustered.where(F.col("cluster") != NOISE).groupBy("cluster")
            .agg(F.count(F.lit(1)).alias("posts"))
            .orderBy(F.desc("posts"), F.asc("cluster")).limit(n))


def posts_of_top_clusters(clustered: DataFrame, n: int = 5) -> DataFrame:
    """All posts of accounts with at least one post in the top clusters.

    With no cluster at all, every post is kept (the reference then graphs all posts).
    """
    top = top_clusters(clustered, n)
    accounts = clustered.join(top.select("cluster"), "cluster", "left_semi") \
        .select("Influencer").distinct()
    no_cluster = top.agg(F.count(F.lit(1)) == 0).scalar()
    keep = clustered.join(accounts, "Influencer", "left_semi")
    return keep.unionByName(clustered.where(no_cluster))


def top_active_subset(df: DataFrame, m: int | None = 50) -> DataFrame:
    """Posts of the ``m`` most active accounts (ties by name); ``None`` keeps all."""
    if m is None:
        return df
    top = (df.groupBy("Influencer").agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), F.asc("Influencer")).limit(m).select("Influencer"))
    return df.join(F.broadcast(top), "Influencer", "left_semi")  # at most m rows


def _cluster_accounts(subset: DataFrame) -> DataFrame:
    """(cluster, Influencer, n) for non-noise clusters with >= 2 posts in the subset."""
    c = subset.where((F.col("cluster") != NOISE) & F.col("Influencer").isNotNull())
    big = subset.where(F.col("cluster") != NOISE).groupBy("cluster") \
        .agg(F.count(F.lit(1)).alias("_posts")).where(F.col("_posts") >= 2)
    return c.join(big.select("cluster"), "cluster", "left_semi") \
        .groupBy("cluster", "Influencer").agg(F.count(F.lit(1)).alias("n"))


def account_clusters(subset: DataFrame) -> DataFrame:
    """The account graph as an incidence table ``(cluster, influencer, posts, co_accounts)``.

    Two accounts are connected when they share a row's cluster, so the table holds the whole
    graph at one row per account and cluster, however large a cluster is; ``co_accounts`` is how
    many other accounts the cluster connects this one with."""
    ca = _cluster_accounts(subset)
    size = ca.groupBy("cluster").agg(F.count(F.lit(1)).alias("_accounts"))
    return ca.join(size, "cluster").select("cluster", F.col("Influencer").alias("influencer"),
                                           F.col("n").alias("posts"),
                                           (F.col("_accounts") - 1).alias("co_accounts"))


def co_cluster_edges(subset: DataFrame) -> DataFrame:
    """Undirected account edges ``(src < dst, weight)``: weight = number of shared clusters.

    The expanded form, for a selection of accounts to draw (see ``top_active_subset``); the
    whole graph is ``account_clusters``."""
    ca = _cluster_accounts(subset)
    a = ca.select("cluster", F.col("Influencer").alias("src"))
    b = ca.select("cluster", F.col("Influencer").alias("dst"))
    return (a.join(b, "cluster").where(F.col("src") < F.col("dst"))
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))


def co_cluster_edges_by_post(subset: DataFrame) -> DataFrame:
    """Variant counting post pairs: weight = sum over clusters of n_u * n_v; an account with
    n posts in a cluster gets a self-loop of n(n-1)/2. No post pairs are materialised."""
    ca = _cluster_accounts(subset)
    a = ca.select("cluster", F.col("Influencer").alias("src"), F.col("n").alias("na"))
    b = ca.select("cluster", F.col("Influencer").alias("dst"), F.col("n").alias("nb"))
    w = F.when(F.col("src") == F.col("dst"), F.col("na") * (F.col("na") - 1) / 2) \
        .otherwise(F.col("na") * F.col("nb"))
    return (a.join(b, "cluster").where(F.col("src") <= F.col("dst"))
            .groupBy("src", "dst").agg(F.sum(w).cast("long").alias("weight"))
            .where(F.col("weight") > 0))


def account_classes(subset: DataFrame) -> DataFrame:
    """``(influencer, example, clusters)``: accounts with equal posts in equal clusters share the
    ``example`` account (the smallest of them), found by fixed-size fingerprints."""
    prints = _cluster_accounts(subset).groupBy("Influencer").agg(
        F.count(F.lit(1)).alias("clusters"), F.bit_xor(F.xxhash64("cluster", "n")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit(1), "cluster", "n")).alias("h2"))
    keys = ["clusters", "h1", "h2"]
    least = prints.groupBy(*keys).agg(F.min("Influencer").alias("example"))
    return prints.join(least, keys).select(F.col("Influencer").alias("influencer"), "example",
                                           "clusters")


def shared_cluster_pairs(subset: DataFrame, min_shared: int = 2) -> DataFrame:
    """The edges of the whole account graph between accounts that share ``min_shared`` or more
    clusters, with both weights: shared clusters, and pairs of posts in them.

    Accounts of one class (``account_classes``) have the same edges, so a row is a pair of classes,
    named by their smallest accounts, and stands for ``account_pairs`` edges; a class of several
    accounts is also a pair with itself. Pairs come from an overlap join: only clusters of the
    prefixes are joined, and an account in fewer than ``min_shared`` clusters, such as those that
    only one crowded cluster connects, costs nothing. Edges of weight one are in
    ``account_clusters``, as incidence.
    """
    members = cut_lineage(account_classes(subset))
    classes = cut_lineage(members.groupBy("example", "clusters")
                          .agg(F.count(F.lit(1)).alias("accounts"))
                          .where(F.col("clusters") >= min_shared))
    ca = cut_lineage(_cluster_accounts(subset).join(
        classes.select(F.col("example").alias("Influencer")), "Influencer", "left_semi")
        .select(F.col("Influencer").alias("account"), "cluster", "n"))
    cand = overlap_candidates(ca, min_shared, "account", "cluster")
    a = ca.select(F.col("account").alias("account1"), "cluster", F.col("n").alias("n1"))
    b = ca.select(F.col("account").alias("account2"), "cluster", F.col("n").alias("n2"))
    size = [classes.select(F.col("example").alias(f"account{k}"),
                           F.col("accounts").alias(f"accounts{k}")) for k in (1, 2)]
    weights = [F.count(F.lit(1)).alias("weight"), F.sum(F.col("n1") * F.col("n2")).alias("post_pairs")]
    cross = (cand.join(a, "account1").join(b, ["account2", "cluster"])
             .groupBy("account1", "account2").agg(*weights).where(F.col("weight") >= min_shared)
             .join(size[0], "account1").join(size[1], "account2")
             .withColumn("account_pairs", F.col("accounts1") * F.col("accounts2")))
    inside = (a.withColumn("n2", F.col("n1")).groupBy("account1").agg(*weights)
              .join(size[0].where("accounts1 >= 2"), "account1")
              .withColumn("account2", F.col("account1")).withColumn("accounts2", F.col("accounts1"))
              .withColumn("account_pairs",
                          (F.col("accounts1") * (F.col("accounts1") - 1) / 2).cast("long")))
    cols = ["account1", "account2", "accounts1", "accounts2", "weight", "post_pairs",
            "account_pairs"]
    return cross.select(*cols).unionByName(inside.select(*cols))


def graph_nodes(subset: DataFrame) -> DataFrame:
    """Every account of the subset: main platform (mode, lowest on ties, else 'Unknown'),
    cluster of its last post, post count, display size scaled to [10, 25] (17.5 when all equal)
    and ``color_index`` = rank of its cluster among the node clusters."""
    base = (subset.where(F.col("Influencer").isNotNull()).groupBy("Influencer")
            .agg(F.coalesce(F.mode("Platform", True), F.lit("Unknown")).alias("platform"),
                 F.max_by("cluster", ORDER).alias("cluster"),
                 F.count(F.lit(1)).alias("posts")))
    lo, hi = base.agg(F.min("posts")).scalar(), base.agg(F.max("posts")).scalar()
    size = F.when(hi == lo, F.lit((MIN_NODE_SIZE + MAX_NODE_SIZE) / 2)).otherwise(
        F.lit(MIN_NODE_SIZE) + F.lit(MAX_NODE_SIZE - MIN_NODE_SIZE)
        * (F.col("posts") - lo) / (hi - lo))
    colors = dense_index(base.select("cluster").distinct(), "cluster", "color_index")
    return (base.join(colors, "cluster")
            .select(F.col("Influencer").alias("influencer"), "platform", "cluster", "posts",
                    F.round(size, 6).alias("node_size"), "color_index"))


def graph_coverage(before_limit: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: accounts shown vs distinct accounts before the account limit."""
    total = before_limit.agg(F.countDistinct("Influencer")).scalar()
    return nodes.agg(F.count(F.lit(1)).alias("nodes_shown")) \
        .select("nodes_shown", total.alias("total_influencers"))


@dataclass
class Network:
    nodes: DataFrame
    edges: DataFrame
    incidence: DataFrame
    subset: DataFrame
    before_limit: DataFrame


def interaction_network(clustered: DataFrame, n_clusters: int | None = None,
                        max_accounts: int | None = None) -> Network:
    """The network tab: (top clusters ->) their accounts' posts (-> most active accounts) ->
    nodes, edges and incidence. Without limits it covers every cluster and account; then use
    ``incidence``, which is linear, rather than ``edges``."""
    before = clustered if n_clusters is None else posts_of_top_clusters(clustered, n_clusters)
    subset = top_active_subset(before, max_accounts)
    return Network(graph_nodes(subset), co_cluster_edges(subset), account_clusters(subset),
                   subset, before)
