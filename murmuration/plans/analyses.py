"""The reference's three views as composed Spark plans over canonical posts.

``overview_report`` (tab 1), ``coordination_report`` (tab 2) and ``network_report`` (tab 3) take canonical
posts plus the sidebar filters and return named DataFrames. Nothing is collected; the caller
decides which reports to run, show or write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from murmuration.operators import cluster, filters, narratives, network, overview, signals


@dataclass
class Filters:
    start: object = None          # first UTC day (inclusive); None = no bound
    end: object = None            # last UTC day (inclusive)
    platforms: list | None = None  # None = every non-null platform


def filtered(posts: DataFrame, f: Filters | None = None) -> DataFrame:
    f = f or Filters()
    return filters.apply_global_filters(posts, f.start, f.end, f.platforms)


def overview_report(posts: DataFrame, f: Filters | None = None, k: int = 10) -> dict[str, DataFrame]:
    p = filtered(posts, f)
    out = {
        "sample_posts": overview.sample_posts(posts),  # the reference samples unfiltered posts
        "top_influencers": overview.top_influencers(p, k),
        "platform_counts": overview.platform_counts(p),
        "top_hashtags": overview.top_hashtags(p, k),
        "daily_volume": overview.daily_volume(p),
        "top_shared_urls": signals.top_shared_urls(p, k),
        "posting_spikes": signals.posting_spikes(p),
    }
    outlets = overview.top_outlets(p, k)
    if outlets is not None:
        out["top_outlets"] = outlets
    return out


def coordination_report(posts: DataFrame, f: Filters | None = None, threshold: float = 0.85,
                 platforms: list | None = None) -> dict:
    """Similar pairs and narratives (eager: the similarity join runs here)."""
    p = filtered(posts, f)
    if platforms is not None:
        p = filters.filter_platforms(p, platforms)
    sim = narratives.find_similarities(p, threshold)
    summary = narratives.narrative_summary(sim)
    return {
        "similarity": sim,
        "similar_pairs": narratives.similar_pairs(sim),
        "narrative_summary": summary,
        "top_narratives": narratives.top_narratives(summary),
        "high_risk_influencers": narratives.high_risk_influencers(sim),
    }


def network_report(posts: DataFrame, f: Filters | None = None, n_clusters: int | None = None,
                     max_accounts: int | None = None, platforms: list | None = None) -> dict:
    """Clusters, their summary and the account network (eager: clustering runs here).

    Without limits ``incidence`` is the whole graph; ``edges`` expands it, for a selection."""
    p = filtered(posts, f)
    if platforms is not None:
        p = filters.filter_platforms(p, platforms)
    c = cluster.cluster_posts(p)
    net = network.interaction_network(c.posts, n_clusters, max_accounts)
    with_texts = cluster.add_texts(c.posts, p)
    return {
        "clustered": with_texts,
        "cluster_sizes": cluster.cluster_sizes(c.posts),
        "cluster_summary": cluster.cluster_summary(c.posts),
        "cluster_members": cluster.cluster_members(with_texts),
        "nodes": net.nodes,
        "edges": net.edges,
        "incidence": net.incidence,
        "coverage": network.graph_coverage(net.before_limit, net.nodes),
    }
