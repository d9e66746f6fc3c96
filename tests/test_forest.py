"""The forest join: components without the pairs of a group of variants."""

import random

import pytest

from murmuration.operators.components import connected_components
from murmuration.operators.forest import forest
from murmuration.operators.simjoin import cosine_pairs_slim
from pyspark.sql import functions as F


def vectors(spark, texts):
    """Unit vectors of term lists; term numbers ascend with frequency, as ``rekey`` gives them."""
    rows = []
    for tix, terms in enumerate(texts):
        w = 1 / len(set(terms)) ** 0.5
        rows += [(tix, t, w) for t in sorted(set(terms))]
    return spark.createDataFrame(rows, "tix long, rk int, w double").repartition(4)


def labels(df):
    return {r["tix"]: r["comp"] for r in df.collect()}


@pytest.mark.parametrize("threshold,stars", [(0.7, 1), (0.85, 4)])
def test_components_equal_those_of_all_pairs(spark, threshold, stars):
    rng = random.Random(stars)
    texts = []
    for _ in range(40):            # groups of texts that drift away from their first
        terms = rng.sample(range(500, 900), 12)
        for _ in range(rng.randint(1, 9)):
            terms = list(terms)
            terms[rng.randrange(12)] = rng.randrange(500)
            texts.append(terms)
    slim = vectors(spark, texts)
    pairs = cosine_pairs_slim(slim, threshold).select(F.col("i").alias("src"),
                                                      F.col("j").alias("dst"))
    want = {r["node"]: r["comp"] for r in connected_components(pairs).collect()}
    got = forest(slim, threshold, stars=stars)
    assert labels(got.labels) == want
    assert got.links.count() <= 8 * len(texts)


def test_a_template_of_many_variants_is_linear(spark):
    """5 000 variants: 12.5 million similar pairs, but few links and no candidates between them."""
    rng = random.Random(1)
    n, base = 5000, list(range(900, 920))
    texts = [[*base, rng.randrange(600), rng.randrange(600, 880)] for _ in range(n)]
    texts += [rng.sample(range(880), 15) for _ in range(100)]
    got = forest(vectors(spark, texts), 0.7)
    comp = labels(got.labels)
    assert all(comp[k] == 0 for k in range(n))
    assert got.links.count() <= 9 * n
    assert got.candidates <= 8 * n         # texts that share a term with other groups


def test_no_vectors(spark):
    got = forest(spark.createDataFrame([], "tix long, rk int, w double"), 0.7)
    assert got.labels.collect() == [] and got.links.collect() == []
