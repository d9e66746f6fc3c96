"""The two vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import pivot_search, vptree_search


def vector_rows():
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(0, 1, 6).tolist()) for k in range(300)]
    same = rng.normal(0, 1, 6).tolist()
    rows += [(1000 + k, same) for k in range(150)]                      # ties
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (None, same),
             (2004, [0.0] * 6), (2005, []), (2006, [0.5, 0.25]),        # zero, empty, short
             (20, rows[20][1]), (40, rows[40][1])]                      # repeated rows
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    df = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>")
    return df.withColumn("v", F.lit("clash")).withColumn("dist", F.lit(1)).withColumn(
        "score", F.lit("x")).repartition(4).cache()


def plain(drop_zero, change):
    seen = {}
    for k, v in vector_rows():
        if k is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = np.zeros(6)
        w[:len(v)] = np.asarray(v, dtype=np.float32)
        if not drop_zero or w.any():
            seen[k] = change(w)
    return seen


def brute(seen, every, k):
    ids = np.array(sorted(seen))
    m = np.stack([seen[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        s = np.einsum("ij,ij->i", m, np.broadcast_to(seen[i], m.shape).copy())
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("scale", [256.0, 1e12])      # the second is beyond exact doubles
def test_pivot_search_is_exact(vectors, scale):
    got = found(pivot_search.top_k(vectors, F.col("vec_id") % 5 == 0, 5, scale=scale))
    seen = plain(False, lambda w: np.array([int(np.floor(scale * x)) for x in w], dtype=object))
    ids = sorted(seen)
    want = {}
    for i in ids:
        if i % 5 == 0:
            s = sorted(((-max(-(1 << 63), min((1 << 63) - 1, int(seen[i].dot(seen[j])))), j)
                        for j in ids if j != i))[:5]
            want[i] = [(j, -x) for x, j in s]
    assert got == want


def test_vptree_factor_one_is_exact(vectors):
    got = found(vptree_search.nearest(vectors, F.col("vec_id") % 4 == 0, 20, factor=1.0,
                                      min_shards=3, shard_rows=100))
    want = brute(plain(True, lambda w: w), 4, 20)
    assert got.keys() == want.keys()
    for k, rows in want.items():
        assert [r[0] for r in got[k]] == [r[0] for r in rows]
        assert np.allclose([r[1] for r in got[k]], [r[1] for r in rows], rtol=1e-14, atol=1e-14)


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_tree_is_exact_at_any_leaf_size(leaf):
    rng = np.random.default_rng(leaf)
    v = np.concatenate([rng.normal(0, 1, (200, 5)), np.ones((30, 5))])
    ids = np.arange(len(v))
    tree = vptree_search.VPTree.build(ids, v, (v * v).sum(1).max(), leaf)
    who, best = tree.search(ids[:40], v[:40], 7, 1.0)
    s = v[:40] @ v.T
    s[np.arange(40), np.arange(40)] = -np.inf
    assert np.allclose(best, -np.sort(-s, axis=1)[:, :7])


def test_recall_with_the_production_factor(spark, sf001):
    path = sf001.replace("sf0.001", "sf0.1") + "/embeddings.parquet"
    df = spark.read.parquet(path)
    got = found(vptree_search.nearest(df, F.col("vec_id") % 20 == 0, 20))
    rows = df.collect()
    ids = np.array([r["vec_id"] for r in rows])
    m = np.array([r["embedding"] for r in rows], dtype=np.float64)
    hit = n = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        s[i] = -np.inf
        best = set(ids[np.argsort(-s)[:20]].tolist())
        hit += len(best & {x[0] for x in got[int(ids[i])]})
        n += 20
    assert hit / n >= 0.95


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (none, spark.createDataFrame([(0, None)], none.schema)):
        assert pivot_search.top_k(df, F.lit(True)).count() == 0
        assert vptree_search.nearest(df, F.lit(True)).count() == 0
    lone = spark.createDataFrame([(0, [1.0, 2.0])], none.schema)
    assert pivot_search.top_k(lone, F.lit(True)).count() == 0
    assert vptree_search.nearest(lone, F.lit(True)).count() == 0
    hollow = spark.createDataFrame([(0, []), (1, []), (2, [])], none.schema)
    assert found(pivot_search.top_k(hollow, F.col("vec_id") == 0, 5)) == {0: [(1, 0), (2, 0)]}


@pytest.mark.parametrize("groups,share", [(0, 1.0), (200, 0.98)])
def test_deep_trees_keep_recall_and_skip_leaves(groups, share):
    """20 000 unit vectors in eight trees of sixteen leaves, with and without clusters."""
    rng = np.random.default_rng(groups)
    v = rng.normal(size=(20_000, 64))
    if groups:
        v = rng.normal(size=(groups, 64))[rng.integers(0, groups, len(v))] + 0.4 * v
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.arange(len(v))
    asked = ids[::100]
    scores = v[asked] @ v.T
    scores[np.arange(len(asked)), asked] = -9
    truth = np.argsort(-scores, axis=1)[:, :20]
    who, best, scanned = [], [], 0
    for s in range(vptree_search.MIN_SHARDS):
        mine = ids % vptree_search.MIN_SHARDS == s
        tree = vptree_search.VPTree.build(ids[mine], v[mine], 1.0 + 1e-12)
        assert len(tree.nodes) >= 31
        w, b = tree.search(asked, v[asked], 20, vptree_search.FACTOR)
        who.append(w)
        best.append(b)
        scanned += tree.scanned
    order = np.argsort(-np.hstack(best), axis=1)[:, :20]
    got = np.take_along_axis(np.hstack(who), order, 1)
    hits = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(got, truth, strict=True)])
    assert hits >= 0.95
    assert scanned < share * len(asked) * len(v)
