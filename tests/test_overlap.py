"""Overlap joins: account edges of the whole graph, and repeated co-sharing."""

import datetime as dt
import random
from collections import defaultdict
from itertools import combinations

from murmuration.operators import network, signals
from murmuration.operators.simjoin import overlap_candidates, prefix_items

T0 = dt.datetime(2024, 7, 1, tzinfo=dt.timezone.utc)


def clustered(spark, rows):
    return spark.createDataFrame(rows, "Influencer string, cluster long").repartition(3)


def plain_edges(rows, least):
    held = defaultdict(lambda: defaultdict(int))
    for account, cluster in rows:
        if cluster != -1:
            held[account][cluster] += 1
    out = {}
    for a, b in combinations(sorted(held), 2):
        both = held[a].keys() & held[b].keys()
        if len(both) >= least:
            out[a, b] = (len(both), sum(held[a][c] * held[b][c] for c in both))
    return out


def expanded(pairs, classes):
    """Class pairs as account pairs."""
    of = defaultdict(list)
    for r in classes.collect():
        of[r["example"]].append(r["influencer"])
    out = {}
    for r in pairs.collect():
        xs, ys = of[r["account1"]], of[r["account2"]]
        assert (len(xs), len(ys)) == (r["accounts1"], r["accounts2"])
        both = list(combinations(sorted(xs), 2)) if r["account1"] == r["account2"] else \
            [tuple(sorted((x, y))) for x in xs for y in ys]
        assert len(both) == r["account_pairs"]
        for p in both:
            assert p not in out
            out[p] = (r["weight"], r["post_pairs"])
    return out


def test_shared_cluster_pairs_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [(f"a{rng.randrange(40)}", rng.choice([-1, 0, 0, 0, *range(25)])) for _ in range(500)]
    rows += [(f"twin{k}", c) for k in range(6) for c in (30, 30, 31, 32)]     # one class
    rows += [("twin9", 30), ("a0", -1), (None, 30)]
    df = clustered(spark, rows).where("Influencer is not null")
    want = plain_edges([r for r in rows if r[0]], 2)
    got = expanded(network.shared_cluster_pairs(df, 2), network.account_classes(df))
    assert got == want and len(got) > 50


def test_one_crowded_cluster_costs_nothing(spark):
    """3 000 accounts of one cluster: 4.5 million edges of weight one, and no row of pairs."""
    rows = [(f"a{k}", 0) for k in range(3000)] + [(f"a{k}", 1 + k % 1400) for k in range(2800)]
    df = clustered(spark, rows + rows)
    sets = df.select("Influencer", "cluster").distinct()
    assert prefix_items(sets, 2, "Influencer", "cluster").where("cluster = 0").count() == 0
    assert overlap_candidates(sets, 2, "Influencer", "cluster").count() == 1400
    assert network.shared_cluster_pairs(df, 2).count() == 1400
    assert network.account_classes(df).count() == 3000


def shares(spark, rows):
    data = [(a, u, T0 + dt.timedelta(seconds=s)) for a, u, s in rows]
    return spark.createDataFrame(data, "Influencer string, URL string, Timestamp timestamp") \
        .repartition(3)


def plain_co_shares(rows, window, least):
    urls = defaultdict(set)
    for (a, u, s), (b, v, t) in combinations(rows, 2):
        if u == v and u is not None and a is not None and b is not None and a != b \
                and abs(s - t) <= window:
            urls[min(a, b), max(a, b)].add(u)
    return {k: len(v) for k, v in urls.items() if len(v) >= least}


def edges(df):
    return {(r["account1"], r["account2"]): r["urls"] for r in df.collect()}


def test_co_share_edges_equal_a_range_join(spark):
    rng = random.Random(2)
    rows = [(f"a{rng.randrange(25)}", f"u{int(rng.paretovariate(0.7)) % 30}",
             rng.randrange(0, 400_000)) for _ in range(900)]
    rows += [("x", f"p{k}", 3600 * k) for k in range(3)] + \
        [("y", f"p{k}", 3600 * k + 3600) for k in range(3)] + \
        [("z", f"p{k}", 3600 * k + 3601) for k in range(3)]       # one second too late
    rows += [(None, "p0", 0), ("x", None, 0), ("y", None, 0)]
    for least in (1, 3):
        got = edges(signals.co_share_edges(shares(spark, rows), 1.0, least))
        assert got == plain_co_shares(rows, 3600, least)
        assert ("x", "y") in got and (("x", "z") in got) is False


def test_a_url_that_everybody_shares(spark):
    """2 000 accounts share one URL within the hour; only the ring that shares three is found."""
    rows = [(f"a{k}", "hot", k % 3000) for k in range(2000)]
    rows += [(f"a{k}", f"own{k}-{m}", m) for k in range(2000) for m in range(3)]
    rows += [(f"a{k}", f"ring{m}", m * 90_000 + k) for k in range(5) for m in range(3)]
    df = shares(spark, rows)
    pre = prefix_items(df.select("Influencer", "URL"), 3, "Influencer", "URL")
    assert pre.where("URL = 'hot'").count() == 0
    got = edges(signals.co_share_edges(df, 6.0, 3))
    assert got == {(f"a{i}", f"a{j}"): 4 for i, j in combinations(range(5), 2)}


def test_pairs_are_not_joined_with_all_urls_of_an_account(spark):
    """Accounts that share many URLs each: the meetings are formed once, and no pair of accounts
    meets the whole list of one of them."""
    import re

    rows = [(f"a{k}", f"u{u}", (7 * k + 11 * u) % 9 * 1800) for k in range(12) for u in range(40)]
    out = signals.co_share_edges(shares(spark, rows), 1.0, 3)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert not re.search(r"Join \w+, \(account1#\w+ = account1#", plan)
    assert edges(out) == plain_co_shares(rows, 3600, 3)
