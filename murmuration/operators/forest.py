"""Components of the neighbour graph (cosine >= t) without the graph: a forest join.

DBSCAN with two samples a core needs only the components, and those need a spanning forest, not
every similar pair: a template with k variants has k^2 / 2 pairs but k - 1 links. So texts that are
already connected are never compared again:

1. Stars: each text's smallest hashed terms (MinHash, ``STARS`` of them) name buckets; a text is
   compared, exactly, with the texts that are the first of ``SHARED`` or more of its buckets.
   Variants of a template nearly always meet this way, at a few comparisons a text.
2. What is left is found exactly, by the bounds of ``simjoin``, among texts of different
   components only. A term whose texts all belong to one component drops out before the join. In
   any other term, the texts of its largest component meet the other texts, not each other:
   of two texts of different components at least one is not in the largest, so the join of
   (others) with (all) misses no pair and a term of n texts, m of them outside the largest
   component, forms m * n rows instead of n^2.
3. Candidates whose kept terms alone reach t connect their components at once. The others are
   verified, all of them if they are at most ``FEW`` per text; else each text's most promising
   ones first, after which merged components go back to the candidates, and only those between
   components that still differ are looked at again, until none is left.

The result does not depend on the stars or the order of verification: at the end every candidate
pair is verified, or within one component.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.operators.components import connected_components
from murmuration.operators.simjoin import (EPS, cells, default_floor, pair_bounds, remainder,
                                           with_tails)
from murmuration.session import cut_lineage

STARS = 8
SHARED = 2
FEW = 4
JUMPS = 3


@dataclass
class Forest:
    labels: DataFrame      # tix, comp: the texts with a neighbour; comp is the smallest tix
    links: DataFrame       # i, j: the verified pairs that were written
    candidates: int        # pairs that step 2 wrote for step 3


def star_candidates(slim: DataFrame, stars: int = STARS) -> DataFrame:
    """``(i, j)``: every text with the texts that are the first of ``SHARED`` of its buckets."""
    least = [F.min(F.struct(F.xxhash64(F.lit(s), "rk"), "rk"))["rk"].alias(f"_{s}")
             for s in range(stars)]
    keys = F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"_{s}").alias("rk"))
                     for s in range(stars)])
    held = (slim.groupBy("tix").agg(*least)
            .select("tix", F.explode(keys).alias("k")).select("tix", "k.s", "k.rk"))
    first = held.groupBy("s", "rk").agg(F.min("tix").alias("i"))
    return (held.join(first, ["s", "rk"]).where(F.col("i") != F.col("tix"))
            .groupBy("i", F.col("tix").alias("j")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min(stars, SHARED)).select("i", "j"))


def verified(pairs: DataFrame, slim: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(i, j)`` with cosine >= ``threshold``. The postings of ``j`` are listed first, so a
    text that is in very many pairs as ``i`` is spread over its terms."""
    mine = slim.select(F.col("tix").alias("j"), "rk", F.col("w").alias("wj"))
    other = slim.select(F.col("tix").alias("i"), "rk", F.col("w").alias("wi"))
    return (pairs.select("i", "j").join(mine, "j").join(other, ["i", "rk"])
            .groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("c"))
            .where(F.col("c") >= F.lit(threshold)).select("i", "j"))


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(tix, comp)`` of all nodes; a node without a link is its own component."""
    comps = connected_components(links.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    return cut_lineage(nodes.join(comps.withColumnRenamed("node", "tix"), "tix", "left")
                       .select("tix", F.coalesce("comp", F.col("tix")).alias("comp")))


def _star_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(tix, comp)`` by following each text's smallest link a few times: texts of one label are
    connected, though connected texts may still have several labels."""
    first = links.groupBy(F.col("j").alias("tix")).agg(F.min("i").alias("comp"))
    at = cut_lineage(nodes.join(first, "tix", "left")
                     .select("tix", F.coalesce("comp", F.col("tix")).alias("comp")))
    for _ in range(JUMPS):
        on = at.select(F.col("tix").alias("comp"), F.col("comp").alias("further"))
        at = cut_lineage(at.join(on, "comp").select("tix", F.col("further").alias("comp")))
    return at


def _between(x: DataFrame, labels: DataFrame, floor: float) -> DataFrame:
    """Joined postings of the pairs of different components (see step 2)."""
    pre = cut_lineage(x.where(F.col("tail") >= F.lit(floor - EPS)).join(labels, "tix"))
    sizes = pre.groupBy("rk", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = (sizes.groupBy("rk").agg(F.max(F.struct("n", "comp")).alias("m"),
                                       F.count(F.lit(1)).alias("comps"))
               .where(F.col("comps") > 1).select("rk", F.col("m.comp").alias("largest")))
    pre = cut_lineage(pre.join(largest, "rk")
                      .withColumn("outside", F.col("comp") != F.col("largest")))
    left = cells(pre.where("outside"), floor, "i", ("comp",))
    right = cells(pre, floor, "j", ("comp", "outside"))
    both = (left.join(right, ["rk", "ci", "cj"])
            .where((F.col("comp_i") != F.col("comp_j"))
                   & (~F.col("outside_j") | (F.col("i") < F.col("j")))
                   & (F.col("tail_i") * F.col("tail_j") >= F.lit(floor - EPS))))
    swap = F.col("i") > F.col("j")

    def ordered(a: str, b: str) -> tuple[Column, Column]:
        return F.when(swap, F.col(b)).otherwise(F.col(a)), F.when(swap, F.col(a)).otherwise(F.col(b))

    out = [F.col("rk")]
    for a, b in (("i", "j"), *[(f"{c}_i", f"{c}_j") for c in ("w", "tail", "after", "left")]):
        lo, hi = ordered(a, b)
        out += [lo.alias(a), hi.alias(b)]
    return both.select(*out)


def _relabel(cand: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidates whose texts are in different components."""
    a = labels.select(F.col("tix").alias("i"), F.col("comp").alias("ca"))
    b = labels.select(F.col("tix").alias("j"), F.col("comp").alias("cb"))
    return (cand.join(a, "i").join(b, "j").where(F.col("ca") != F.col("cb"))
            .drop("ca", "cb"))


def forest(slim: DataFrame, threshold: float, floor: float | None = None,
           stars: int = STARS) -> Forest:
    """Components of the texts ``(tix, rk, w)`` under cosine >= ``threshold``."""
    t = float(threshold)
    floor = default_floor(t) if floor is None else min(float(floor), t)
    links = cut_lineage(verified(star_candidates(slim, stars), slim, t))
    nodes = cut_lineage(slim.select("tix").distinct())
    labels = _star_labels(nodes, links)
    x = cut_lineage(with_tails(slim))
    cand = cut_lineage(pair_bounds(_between(x, labels, floor), t, floor))
    found, few, pick = cand.count(), FEW * nodes.count(), FEW
    sure = cand.where(F.col("p") >= F.lit(t)).select("i", "j")
    links = cut_lineage(links.unionByName(_one_a_pair(sure, labels)))
    rest, left = cand.where(F.col("p") < F.lit(t)), found
    while left:
        now = rest
        if left > few:
            labels = _labels(nodes, links)
            best = Window.partitionBy("i").orderBy(F.desc("p"), "j")
            rest = cut_lineage(_relabel(rest, labels)
                               .withColumn("_k", F.row_number().over(best)))
            now, rest = (rest.where(c).drop("_k") for c in (F.col("_k") <= pick,
                                                            F.col("_k") > pick))
            pick *= 8
        exact = remainder(now, x).where(F.col("similarity") >= F.lit(t)).select("i", "j")
        links = cut_lineage(links.unionByName(_one_a_pair(exact, labels)))
        left = 0 if now is rest else rest.count()
    labels = _labels(nodes, links)
    linked = links.select(F.explode(F.array("i", "j")).alias("tix")).distinct()
    return Forest(labels.join(linked, "tix", "left_semi"), links, found)


def _one_a_pair(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One of the given pairs for every two components that they connect."""
    a = labels.select(F.col("tix").alias("i"), F.col("comp").alias("ca"))
    b = labels.select(F.col("tix").alias("j"), F.col("comp").alias("cb"))
    return (pairs.join(a, "i").join(b, "j")
            .groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"))
            .agg(F.min(F.struct("i", "j")).alias("e")).select("e.i", "e.j"))
