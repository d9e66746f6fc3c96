"""Skew-safe ordered helpers vs straightforward computations."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from murmuration.operators.ranking import dense_index, first_k_distinct, previous_in_group


def test_first_k_distinct(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), f"u{rnd.randrange(12)}", i) for i in range(400)]
    rows += [("hot", f"u{i % 50}", 1000 + i) for i in range(3000)]  # one hot group
    df = spark.createDataFrame(rows, "g string, v string, o long")
    got = {r["g"]: (r["first_values"], r["n_distinct"])
           for r in first_k_distinct(df, ["g"], "v", "o", 5).collect()}
    for g in {r[0] for r in rows}:
        seen = []
        for _, v, _o in sorted((r for r in rows if r[0] == g), key=lambda r: r[2]):
            if v not in seen:
                seen.append(v)
        assert got[g] == (seen[:5], len(seen))


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(10_000), 500)], "x long")
    got = sorted((r["x"], r["idx"]) for r in dense_index(df, "x", "idx", 7).collect())
    assert [i for _, i in got] == list(range(500))


def test_previous_in_group_matches_lag(spark):
    rnd = random.Random(9)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(20)}", i, rnd.randrange(5))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, o long, val long")
    got = {r["o"]: (r["prev"]["o"] if r["prev"] else None, r["prev"]["val"] if r["prev"] else None)
           for r in previous_in_group(df, "key", "o", ["val"], num_partitions=6).collect()}
    w = Window.partitionBy("key").orderBy("o")
    exp = {r["o"]: (r["po"], r["pv"]) for r in df.select(
        "o", F.lag("o").over(w).alias("po"), F.lag("val").over(w).alias("pv")).collect()}
    assert got == exp


def test_count_before(spark):
    from murmuration.operators.ranking import count_before

    rnd = random.Random(11)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(9)}", i, rnd.random() < 0.4)
            for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, o long, flag boolean")
    got = {r["o"]: r["before"] for r in count_before(df, ["key"], "o", "flag", num_partitions=5).collect()}
    exp, seen = {}, {}
    for k, o, f in sorted(rows, key=lambda r: r[1]):
        exp[o] = seen.get(k, 0)
        seen[k] = seen.get(k, 0) + (1 if f else 0)
    assert got == exp
