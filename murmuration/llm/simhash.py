"""SimHash near-duplicates: fingerprints, and a binary-trie self-join over them.

The fingerprints, seen as 64-bit paths, form a binary trie. The join walks pairs of trie nodes
down together, adds up the bits in which their paths differ, and drops a pair as soon as that
sum is over the Hamming budget. The top of the trie is walked as DataFrames (one row per pair
of non-empty nodes, two bits a round) until a pair of subtrees holds few enough fingerprints
for one task; the bottom is walked inside the tasks, vectorised over node pairs. A task returns
a spanning forest of the links it finds, never all pairs of a dense group.

Equal fingerprints are collapsed before the join, so exact copies cost one row.

Null text counts as empty; a text without words has fingerprint zero. Rows with a null id take
part and get the smallest non-null id of their component (null if it has none). Repeated rows
are separate documents with the same fingerprint. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.common import boxed, row_hash, unboxed, written
from murmuration.operators.components import connected_components

SEED = 42
BITS = 64
STEP = 2                 # trie levels walked per DataFrame round
SUBTREE_ROWS = 8192      # fingerprints of a node pair that one task walks
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_SLOT = (np.arange(8) * 256).astype(np.int64)


def simhash(text: bytes, width: int) -> int:
    """Fingerprint of one text: per bit, the majority over its word shingles' XXH64."""
    words = text.lower().split()       # bytes: A-Z and ASCII white space only
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= width:
        spans = [(0, len(joined))]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes)[:n - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _SLOT).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BYTE_BITS).ravel()
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """64-bit SimHash of a text column, as a signed long."""

    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.array([simhash(x, width) for x in texts], dtype=np.uint64)
            yield pd.Series(values.view(np.int64))

    return run(F.coalesce(text, F.lit("")).cast("binary"))


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- walk inside one task

def _merge(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union the sets of u[i] and v[i]; ``parent`` stays fully compressed to the smallest index."""
    while True:
        pu, pv = parent[u], parent[v]
        open_ = pu != pv
        if not open_.any():
            return parent
        u, v, pu, pv = u[open_], v[open_], pu[open_], pv[open_]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def trie_forest(a: np.ndarray, b: np.ndarray | None, depth: int, budget: int,
                product: int = 256, frontier: int = 200_000) -> list[tuple[int, int]]:
    """Spanning links of fingerprints of subtree ``a`` with those of ``b`` (None: ``a`` itself).

    ``depth``: bits already walked; both inputs are sorted unsigned arrays. Index pairs refer to
    ``a`` followed by ``b``.
    """
    same = b is None
    right = a if same else b
    shift = 0 if same else len(a)
    parent = np.arange(len(a) + (0 if same else len(b)))
    spent = 0 if same else int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(BITS - depth))
                               if depth else 0)
    stack = [(depth, np.array([[0, len(a), 0, len(right), spent]], dtype=np.int64))]
    while stack:
        level, f = stack.pop()
        if len(f) > frontier:
            half = len(f) // 2
            stack += [(level, f[half:]), (level, f[:half])]
            continue
        na, nb = f[:, 1] - f[:, 0], f[:, 3] - f[:, 2]
        small = (na * nb <= product) | (level >= BITS)
        if small.any():
            g, ga, gb = f[small], na[small], nb[small]
            total = ga * gb
            at = np.repeat(np.arange(len(g)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            i, j = g[at, 0] + k // gb[at], g[at, 2] + k % gb[at]
            near = np.bitwise_count(a[i] ^ right[j]) <= budget
            if same:
                near &= i < j
            if near.any():
                parent = _merge(parent, i[near], j[near] + shift)
            f = f[~small]
        if not len(f):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - level)
        keep = np.uint64(0) if level == 0 else ~((bit << np.uint64(1)) - np.uint64(1))
        am = np.clip(np.searchsorted(a, (a[f[:, 0]] & keep) | bit), f[:, 0], f[:, 1])
        bm = np.clip(np.searchsorted(right, (right[f[:, 2]] & keep) | bit), f[:, 2], f[:, 3])
        alo, ahi, blo, bhi, err = f.T
        kids = [np.stack([alo, am, blo, bm, err], 1), np.stack([am, ahi, bm, bhi, err], 1),
                np.stack([alo, am, bm, bhi, err + 1], 1)]
        mirror = np.stack([am, ahi, blo, bm, err + 1], 1)
        # a node paired with itself reaches its two halves' pair once, not twice
        kids.append(mirror[(alo != blo) | (ahi != bhi)] if same else mirror)
        nxt = np.concatenate(kids)
        nxt = nxt[(nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2]) & (nxt[:, 4] <= budget)]
        if len(nxt):
            stack.append((level + 1, nxt))
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return list(zip(linked.tolist(), parent[linked].tolist(), strict=True))


def _walk_subtrees(budget: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        depth, left = int(group["depth"].iloc[0]), int(group["a"].iloc[0])
        fps = group["fp"].to_numpy(np.int64).view(np.uint64)
        if group["b"].iloc[0] == left:
            a, b = np.sort(fps), None
            members = a
        else:
            mine = group["mine"].to_numpy(bool)
            a, b = np.sort(fps[mine]), np.sort(fps[~mine])
            members = np.concatenate([a, b])
        links = trie_forest(a, b, depth, budget)
        at = np.array(links, dtype=np.int64).reshape(-1, 2)
        signed = members.view(np.int64)
        return pd.DataFrame({"src": signed[at[:, 0]], "dst": signed[at[:, 1]]})

    return run


# ---------------------------------------------------------------- walk of the top, as DataFrames

def _node(depth: int) -> Column:
    """The first ``depth`` bits; in two shifts, as one by 64 would be none. Never a constant, so
    that joins on it stay equi-joins at the root as well."""
    return F.shiftrightunsigned(F.shiftrightunsigned("fp", (BITS - depth) // 2),
                                BITS - depth - (BITS - depth) // 2)


def trie_links(fps: DataFrame, budget: int = 2, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """``(src, dst)``: spanning links between distinct fingerprints (column ``fp``, long) whose
    Hamming distance is at most ``budget``. Every link's ends are connected by the result."""
    depth = 0
    n = fps.count()
    pairs = fps.sparkSession.createDataFrame([(0, 0, 0, n, n)],
                                             "a long, b long, err int, na long, nb long")
    found: list[DataFrame] = []
    while True:
        small = (F.col("na") + F.col("nb") <= subtree_rows) | F.lit(depth >= BITS)
        found.append(_subtree_rows(pairs.where(small), fps, depth))
        pairs = pairs.where(~small)
        if depth >= BITS or pairs.isEmpty():
            break
        depth += STEP
        nodes = fps.groupBy(_node(depth).alias("node")).agg(F.count(F.lit(1)).alias("rows"))
        up = F.shiftrightunsigned("node", STEP)
        kid_a = nodes.select(up.alias("a"), F.col("node").alias("ka"), F.col("rows").alias("ra"))
        kid_b = nodes.select(up.alias("b"), F.col("node").alias("kb"), F.col("rows").alias("rb"))
        err = F.col("err") + F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))
                                         .bitwiseAND(F.lit((1 << STEP) - 1)))
        pairs = written(pairs.select("a", "b", "err").join(kid_a, "a").join(kid_b, "b")
                        .where((F.col("ka") <= F.col("kb")) & (err <= budget))
                        .select(F.col("ka").alias("a"), F.col("kb").alias("b"), err.alias("err"),
                                F.col("ra").alias("na"), F.col("rb").alias("nb")))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return (rows.groupBy("depth", "a", "b")
            .applyInPandas(_walk_subtrees(budget), "src long, dst long").distinct())


def _subtree_rows(pairs: DataFrame, fps: DataFrame, depth: int) -> DataFrame:
    """The fingerprints of each pair of nodes that one task will walk."""
    members = fps.select(_node(depth).alias("node"), "fp")
    side_a = pairs.join(members, F.col("a") == F.col("node")).withColumn("mine", F.lit(True))
    side_b = (pairs.where("a != b").join(members, F.col("b") == F.col("node"))
              .withColumn("mine", F.lit(False)))
    return (side_a.unionByName(side_b)
            .select(F.lit(depth).alias("depth"), "a", "b", "mine", "fp"))


def link_components(prints: DataFrame, budget: int = 2) -> DataFrame:
    """``(fp, root)`` for the distinct fingerprints of ``prints``: equal roots are linked."""
    fps = written(prints.select("fp").distinct())
    comps = connected_components(trie_links(fps, budget))
    return (fps.join(comps.select(F.col("node").alias("fp"), "comp"), "fp", "left")
            .select("fp", F.coalesce("comp", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 3, budget: int = 2) -> DataFrame:
    """One row per document: id, ``fp`` (long) and ``component_id`` (smallest id reachable)."""
    prints = written(docs.select(F.col(id_col).alias("id"),
                                 fingerprint(F.col(text_col), width).alias("fp")))
    roots = link_components(prints, budget)
    least = prints.groupBy("fp").agg(F.min("id").alias("least")).join(roots, "fp")
    least = written(least)
    comp = least.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = least.select("fp", "root").join(comp, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
             budget: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (nulls last), then the smallest
    row hash. Rows equal in every column count once."""
    prints = written(docs.select(F.col(id_col).alias("id"), row_hash(docs).alias("row"),
                                 fingerprint(F.col(text_col), width).alias("fp")))
    roots = written(link_components(prints, budget))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    first = prints.groupBy("fp").agg(F.min(order).alias("first")).join(roots, "fp")
    kept = first.groupBy("root").agg(F.min("first").alias("first"))
    rows = prints.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")) \
        .agg(F.count(F.lit(1)).alias("_times"))
    kept = kept.join(rows, (F.col("first.row") == F.col("_row"))
                     & F.col("first.id").eqNullSafe(F.col("_id")))
    out = boxed(docs, _key=F.col(id_col), _hash=row_hash(docs)).join(
        kept.select("_id", "_row", "_times"),
        (F.col("_hash") == F.col("_row")) & F.col("_key").eqNullSafe(F.col("_id")))
    again = out.where("_times > 1").select("_in").dropDuplicates()
    return unboxed(out.where("_times = 1")).unionByName(unboxed(again))
