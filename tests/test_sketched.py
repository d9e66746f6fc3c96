"""MinHash overlap: rows of the exact join, with measured recall."""

import random

from pyspark.sql import functions as F

from murmuration.operators import signals


def rows(df):
    return {(r["example1"], r["example2"]): (r["shared"], r["jaccard"], r["account_pairs"])
            for r in df.collect()}


def test_rows_are_exact_and_most_are_found(spark):
    rng = random.Random(4)
    data = []
    for g in range(60):                        # groups around a common vocabulary
        base = rng.sample(range(4000), 40)
        for a in range(rng.randint(1, 6)):
            kept = rng.sample(base, rng.randint(26, 40))
            data += [(f"a{g}-{a}", f"w{x}") for x in kept + rng.sample(range(4000), 4)]
    data += [(f"t{k}", f"x{m}") for k in range(300) for m in range(9)]      # one class of 300
    data += [("one", "w1"), (None, "w1")]
    sets = spark.createDataFrame(data, "account string, item string").distinct() \
        .where(F.col("account").isNotNull())
    exact = rows(signals.set_overlap(sets, 0.5))
    found = rows(signals.set_overlap(sets, 0.5, signals.sketched_pairs))
    assert len(exact) > 60 and found.items() <= exact.items()
    assert len(found) >= 0.9 * len(exact)
    assert found["t0", "t0"][2] == 300 * 299 // 2
    assert rows(signals.set_overlap(sets.where("false"), 0.5, signals.sketched_pairs)) == {}
