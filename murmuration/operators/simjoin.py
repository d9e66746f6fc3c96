"""Exact all-pairs cosine similarity join over unit-length sparse vectors (postings).

Plan (DataFrame joins and aggregations only):

1. Re-key: texts get dense ``long`` ids and terms get ``int`` ranks in the global order
   ``(df asc, term asc)`` (rare terms first), so every shuffle below moves a few primitives.
2. Tails: each posting carries the norm of its vector from that term on. From a shared term of
   rank r on, two vectors have a cosine of at most the product of their tails at r; so a pair
   with cosine >= t has its first shared term where that product is at least t. Postings with
   a tail of at least ``floor`` (``floor <= t``) are joined on the term, and joined rows whose
   product is below ``floor`` are dropped inside the join. As products fall with the rank, what
   is kept of a pair is its first shared terms.
3. Cells: a term's list is split by tail level, and only the pairs of levels whose product can
   reach ``floor`` meet (join key: term, level, partner's level). Frequent terms come late, where
   tails are short, so most of a long list's pairs are never formed, and the list is split.
4. Bound: for a candidate, ``p`` = sum of ``w1*w2`` over its kept terms; the rest is at most the
   product of the two tails after the last kept term, and below ``floor``. Candidates whose best
   product is below ``t``, or with ``p`` plus that rest below ``t``, are dropped (exact).
5. Verify: ``cos = p + R``, ``R`` = shared terms after the last kept one, from the vector with
   fewer terms left, joined against the other's postings on ``(id, term)``.

AQE's skew join splits the cells that remain large. Intermediate tables are written to the shared
checkpoint folder (lineage cut, reused, executor-loss safe).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.ranking import count_before, dense_index
from murmuration.session import cut_lineage

EPS = 1e-9


LEVELS = 4         # tail levels of a term's list
FLOOR_GAP = 0.05


def default_floor(threshold: float) -> float:
    """Tail product down to which a pair's shared terms are added up before verification.

    A planning value: results do not depend on it. A low one forms more rows in the join, a high
    one leaves more candidates to verify.
    """
    return max(0.1, threshold - FLOOR_GAP)


def rekey(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tix, rk, w)`` postings plus the ``(tid, tix)`` id map."""
    ids = cut_lineage(dense_index(postings.select("tid").distinct(), "tid", "tix"))
    terms = dense_index(postings.select(F.struct("df", "term").alias("k")).distinct(), "k", "rk")
    terms = terms.select(F.col("k.term").alias("term"), F.col("rk").cast("int").alias("rk"))
    slim = postings.join(ids, "tid").join(terms, "term").select("tix", "rk", "w")
    return cut_lineage(slim), ids


def with_tails(slim: DataFrame) -> DataFrame:
    """Annotate ``(tix, rk, w)`` with ``tail`` (norm from this term on), ``after`` (norm behind
    it) and ``left`` (terms behind it)."""
    suf = Window.partitionBy("tix").orderBy(F.col("rk").desc())
    upto = suf.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = slim.withColumn("t2", F.sum(F.col("w") * F.col("w")).over(upto)) \
        .withColumn("left", F.row_number().over(suf) - 1)
    after = F.sqrt(F.greatest(F.lit(0.0), F.col("t2") - F.col("w") * F.col("w")))
    return x.select("tix", "rk", "w", F.sqrt("t2").alias("tail"), after.alias("after"), "left")


def cells(pre: DataFrame, floor: float, side: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Postings of one side of the join with the keys ``ci``, ``cj`` (tail levels of the two
    sides): one row per level of the other side that can meet this one; ``more`` columns too."""
    step = (1.0 - floor) / LEVELS
    upper = [floor + step * (k + 1) for k in range(LEVELS - 1)] + [1.0 + EPS]
    level = F.least(F.lit(LEVELS - 1), F.floor((F.col("tail") - floor) / step)).cast("int")
    meets = F.create_map(*[x for k in range(LEVELS) for x in (
        F.lit(k), F.array(*[F.lit(m) for m in range(LEVELS)
                            if upper[k] * upper[m] >= floor - EPS]))])
    mine, other = ("ci", "cj") if side == "i" else ("cj", "ci")
    rows = pre.withColumn(mine, F.greatest(F.lit(0), level))
    return rows.select(F.col("tix").alias(side), "rk", mine, F.explode(meets[F.col(mine)])
                       .alias(other), *[F.col(c).alias(f"{c}_{side}")
                                        for c in ("w", "tail", "after", "left", *more)])


def joined_postings(x: DataFrame, floor: float) -> DataFrame:
    """One row per pair of vectors and shared term with a tail product of at least ``floor``."""
    pre = x.where(F.col("tail") >= F.lit(floor - EPS))
    return (cells(pre, floor, "i").join(cells(pre, floor, "j"), ["rk", "ci", "cj"])
            .where((F.col("i") < F.col("j"))
                   & (F.col("tail_i") * F.col("tail_j") >= F.lit(floor - EPS))))


def pair_bounds(joined: DataFrame, t: float, floor: float) -> DataFrame:
    """Candidates ``(i, j, p, last, e, l)`` of joined postings: the pairs whose kept terms and the
    bound of the rest can reach ``t``; ``e`` is the text with fewer terms left, ``l`` the other."""
    cand = (joined.groupBy("i", "j")
            .agg(F.sum(F.col("w_i") * F.col("w_j")).alias("p"),
                 F.max(F.col("tail_i") * F.col("tail_j")).alias("best"),
                 F.min(F.col("after_i") * F.col("after_j")).alias("rest"),
                 F.max("rk").alias("last"),
                 F.min("left_i").alias("left_i"), F.min("left_j").alias("left_j"))
            .where((F.col("best") >= F.lit(t - EPS))
                   & (F.col("p") + F.least(F.lit(floor), F.col("rest")) >= F.lit(t - EPS))))
    i_short = F.col("left_i") <= F.col("left_j")
    return cand.select(
        "i", "j", "p", "last", F.when(i_short, F.col("i")).otherwise(F.col("j")).alias("e"),
        F.when(i_short, F.col("j")).otherwise(F.col("i")).alias("l"))


def remainder(cand: DataFrame, x: DataFrame) -> DataFrame:
    """``(i, j, similarity)`` of candidates: ``p`` plus the shared terms after the last kept one."""
    short = x.select(F.col("tix").alias("e"), "rk", F.col("w").alias("we"))
    full = x.select(F.col("tix").alias("l"), "rk", F.col("w").alias("wl"))
    rem = (cand.select("e", "l", "last").join(short, "e").where(F.col("rk") > F.col("last"))
           .join(full, ["l", "rk"])
           .groupBy("e", "l").agg(F.sum(F.col("we") * F.col("wl")).alias("rem")))
    total = F.col("p") + F.coalesce(F.col("rem"), F.lit(0.0))
    return cand.join(rem, ["e", "l"], "left").select("i", "j", total.alias("similarity"))


def cosine_pairs_slim(slim: DataFrame, threshold: float, floor: float | None = None,
                      exact_values: bool = True) -> DataFrame:
    """Pairs ``(i < j, similarity)`` of dense ids with cosine >= ``threshold``.

    With ``exact_values=False`` (membership only, e.g. a neighbour graph) candidates whose kept
    terms alone reach ``t`` are accepted without verification and report that lower bound as
    ``similarity``; only the undecided ones are verified.
    """
    t = float(threshold)
    floor = default_floor(t) if floor is None else min(float(floor), t)
    x = cut_lineage(with_tails(slim))
    cand = cut_lineage(pair_bounds(joined_postings(x, floor), t, floor))
    certain = None
    if not exact_values:
        certain = cand.where(F.col("p") >= F.lit(t)).select("i", "j", F.col("p").alias("similarity"))
        cand = cand.where(F.col("p") < F.lit(t))
    out = remainder(cand, x).where(F.col("similarity") >= F.lit(t))
    return out if certain is None else out.unionByName(certain)


def cosine_pairs(postings: DataFrame, threshold: float, floor: float | None = None,
                 exact_values: bool = True) -> DataFrame:
    """All unordered vector pairs ``(tid1 < tid2)`` with cosine >= ``threshold``.

    ``postings`` = ``(tid, term, df, w)`` with unit norm per ``tid``. Columns out:
    ``tid1, tid2, similarity`` (see ``cosine_pairs_slim`` for ``exact_values``).
    """
    slim, ids = rekey(postings)
    pairs = cosine_pairs_slim(slim, threshold, floor, exact_values)
    a = ids.select(F.col("tix").alias("i"), F.col("tid").alias("tid1"))
    b = ids.select(F.col("tix").alias("j"), F.col("tid").alias("tid2"))
    return pairs.join(a, "i").join(b, "j").select("tid1", "tid2", "similarity")


def naive_cosine_pairs(postings: DataFrame, threshold: float) -> DataFrame:
    """Reference implementation for tests: full postings self-join (cost grows with sum df^2)."""
    a = postings.select(F.col("tid").alias("tid1"), "term", F.col("w").alias("w1"))
    b = postings.select(F.col("tid").alias("tid2"), "term", F.col("w").alias("w2"))
    return (a.join(b, "term").where(F.col("tid1") < F.col("tid2"))
            .groupBy("tid1", "tid2").agg(F.sum(F.col("w1") * F.col("w2")).alias("similarity"))
            .where(F.col("similarity") >= F.lit(float(threshold))))


def jaccard_pairs(sets: DataFrame, threshold: float, key: str = "key",
                  item: str = "item") -> DataFrame:
    """Exact set-similarity join: pairs ``(key1 < key2)`` with Jaccard >= ``threshold``.

    ``sets`` holds one row per (key, item), duplicates ignored. Sets meet by blocks (see
    ``setjoin``).
    """
    from murmuration.operators import setjoin      # which takes its packing from blockjoin

    bags = sets.select(F.col(key).alias("account"), F.array(item).alias("items"))
    own = setjoin.account_sets(bags).where(F.col("account").isNotNull()).select(
        F.col("account").alias("example"), F.lit(1).cast("long").alias("accounts"), "items", "rks")
    return setjoin.jaccard_pairs(setjoin.set_blocks(own), threshold).select(
        F.col("example1").alias("k1"), F.col("example2").alias("k2"), "shared", "jaccard")


def prefix_items(sets: DataFrame, at_least: int, key: str, item: str) -> DataFrame:
    """The ``(key, item)`` rows that decide which keys can share ``at_least`` items.

    Items are ordered rare first and a key of n items keeps its first ``n - at_least + 1``: of
    ``at_least`` shared items the first is followed by ``at_least - 1`` others in both keys, so it
    is kept in both. Keys of fewer items drop out, and a frequent item is kept only where too few
    rarer ones stand before it.
    """
    s = sets.select(F.col(key).alias("k"), F.col(item).alias("it")).distinct()
    sizes = s.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    s = cut_lineage(s.join(sizes, "k"))
    freq = s.groupBy("it").agg(F.count(F.lit(1)).alias("f"))
    ordered = s.join(freq, "it").withColumn("o", F.struct("f", "it"))
    return (count_before(ordered, ["k"], "o", out_col="before")
            .where(F.col("before") <= F.col("n") - at_least)
            .select(F.col("k").alias(key), F.col("it").alias(item)))


def overlap_candidates(sets: DataFrame, at_least: int, key: str, item: str) -> DataFrame:
    """Pairs ``(key1 < key2)`` that include all with ``at_least`` shared items: the pairs that share
    an item of both prefixes."""
    pre = cut_lineage(prefix_items(sets, at_least, key, item))
    a = pre.select(F.col(key).alias(f"{key}1"), item)
    b = pre.select(F.col(key).alias(f"{key}2"), item)
    return (a.join(b, item).where(F.col(f"{key}1") < F.col(f"{key}2"))
            .select(f"{key}1", f"{key}2").distinct())
