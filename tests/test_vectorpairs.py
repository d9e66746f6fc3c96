"""Sign-projection pairs: every row exact, recall on planted pairs."""

from collections import Counter

import numpy as np
import pandas as pd

from murmuration.operators import vectorpairs


def frame(spark, v):
    rows = pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(map(list, v))})
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def planted(n=6000, dim=32, seed=2):
    """Random vectors; every tenth has a neighbour at a cosine of about 0.8 to 0.99."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = np.arange(1, n, 10)
    noise = rng.normal(size=(len(near), dim))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    v[near] = v[near - 1] + rng.uniform(0.1, 0.75, size=(len(near), 1)) * noise
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_exact_rows_and_recall(spark):
    v = planted()
    got = vectorpairs.close_pairs(frame(spark, v), 0.8).collect()
    scores = np.round(v @ v.T, 9)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(scores, 1) >= 0.8), strict=True)}
    found = {(r["id1"], r["id2"]) for r in got}
    assert len(found) == len(got) and found <= want
    assert all(abs(r["cosine"] - scores[r["id1"], r["id2"]]) < 1e-8 for r in got)
    assert len(found) >= 0.9 * len(want) > 300
    links = {r["id"]: r["links"] for r in vectorpairs.link_counts(frame(spark, v), 0.8).collect()}
    ends = Counter(x for p in found for x in p)
    assert links == {k: ends[k] for k in range(len(v))}


def test_copies_are_one_class_and_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vectorpairs, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4, 16))
    near = v[0] + 0.05 * rng.normal(size=(60, 16))        # one crowded bucket of variants
    rows = np.concatenate([v, near, np.repeat(v[1:2], 500, axis=0)])
    df = frame(spark, rows)
    got = {(r["id1"], r["id2"]): (r["copies1"], r["copies2"])
           for r in vectorpairs.close_pairs(df, 0.9, bits=4, bands=24).collect()}
    assert got.pop((1, 1)) == (501, 501)
    variants = [0, *range(4, 64)]
    assert set(got) == {(a, b) for a in variants for b in variants if a < b}
    counts = {r["id"]: (r["example"], r["copies"], r["links"])
              for r in vectorpairs.link_counts(df, 0.9, bits=4, bands=24).collect()}
    assert counts[70] == (1, 501, 0) and counts[5] == (5, 1, 60) and len(counts) == len(rows)
    classes = vectorpairs.vector_classes(df).collect()
    assert sum(r["example"] == 1 for r in classes) == 501 and len(classes) == len(rows)


def test_awkward_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [1.0]), (7, [None, 1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["id1"], r["id2"]) for r in vectorpairs.close_pairs(df, 0.9).collect()}
    assert got == {(1, 1), (1, 6)}
    assert vectorpairs.close_pairs(df.where("false"), 0.9).collect() == []
