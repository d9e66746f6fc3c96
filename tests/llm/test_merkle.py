"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from murmuration.llm import merkle
from murmuration.llm.queries import ORACLE, QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(doc, text):
    k, _, lang, source, chars = doc
    return h(*map(enc, (k, source, lang, chars, text)))


def climb(nodes):
    """Top digest and, per node, its siblings as (left, right) from the bottom up."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            run = nodes[at[k] // 8 * 8:at[k] // 8 * 8 + 8]
            paths[k].append(("".join(run[:at[k] % 8]), "".join(run[at[k] % 8 + 1:])))
            at[k] //= 8
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    """Counter of (id, leaf, subroot, root, proof digest)."""
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append((r[0] is not None, r[0], plain_leaf(r, r[1])))
    tops, inner = [], []
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        leaves = sorted(langs[g], key=lambda x: (x[0], x[1] or 0, x[2]))
        top, paths = climb([x[2] for x in leaves])
        tops.append(top)
        inner.append((leaves, paths))
    if not tops:
        return Counter()
    root, over = climb(tops)
    return Counter((x[1], x[2], top, root, h(*[s for step in p + up for s in step]))
                   for top, (leaves, paths), up in zip(tops, inner, over, strict=True)
                   for x, p in zip(leaves, paths, strict=True))


def got(out):
    return Counter(tuple(r) for r in out.select(
        "doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof"))).collect())


def test_awkward_rows(docs, clashing, empty, rows):
    out = merkle.manifest(docs)
    assert got(out) == plain_manifest(rows)
    assert out.where(~merkle.verified(F.col("leaf"), F.col("proof"), F.col("root"))).count() == 0
    assert got(merkle.manifest(clashing)) == plain_manifest(rows)
    assert merkle.manifest(empty).collect() == []


@pytest.mark.parametrize("sizes", [[1], [8, 9, 1], [64, 65], [700, 3]])
def test_uneven_trees(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10 ** 6), f"t{k}", f"l{g}" if g else None, "s", 1)
            for g, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                     "n_chars long")
    assert got(merkle.manifest(df)) == plain_manifest(rows)


def test_many_groups_and_one_hot_row(spark):
    """More groups than a block holds, and one row repeated more often than that."""
    rows = [(k, "x", f"lang {k}", "s", 1) for k in range(600)] + [(7, "x", "hot", "s", 1)] * 1100
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                     "n_chars long").repartition(6)
    assert got(merkle.manifest(df)) == plain_manifest(rows)


def test_query_finds_the_tampered_rows(spark, sf001):
    out = {r["doc_id"]: r for r in QUERIES["op13_merkle"](spark, sf001).collect()}
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        changed = (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and d["text"] is not None
                   and any("A" <= c <= "Z" for c in d["text"]))
        assert out[d["doc_id"]]["verified"] == (not changed)
    assert "op13_merkle" in ORACLE
