import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])
#: Names that the operators use themselves.
CLASHING = ["fp", "size", "score", "mask", "_row", "_in", "shard", "slot", "id", "_id", "rate",
            "stats", "words", "line", "copies", "sequence_id", "row", "label", "spans", "base"]

WORDS = [f"w{k}" for k in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, hot copies."""
    rng = random.Random(5)
    common = sentence(rng, 12)
    passage = sentence(rng, 60)
    rows = [(k, "\n".join([common, sentence(rng, rng.randint(3, 40)), sentence(rng, 9)]), "en",
             f"s{k % 4}", 0) for k in range(40)]
    copy = sentence(rng, 30)
    rows += [(100 + k, copy, "en", "s0", 0) for k in range(30)]
    near = copy.split(" ")
    rows += [(140 + k, " ".join([*near[:-1], f"x{k}"]), "fr", "s1", 0) for k in range(5)]
    rows += [(150 + k, sentence(rng, 20) + "\n" + passage + "\n" + sentence(rng, 6), "en", "s2", 0)
             for k in range(4)]
    rows += [(200, None, None, None, None), (201, "", "en", "s1", 0), (202, " \t\n ", "de", "s1", 3),
             (203, "one", "en", None, 3), (204, "one two", "en", "é", 7),
             (205, "One TWO thrée 日本 🙂", "ja", "s3", 9), (None, "no id here at all", "en", "s3", 1),
             (None, None, None, None, None), (206, "\0nul\0 byte", "en", "s3", 9),
             (207, "\n".join(sentence(rng, 20) for _ in range(2500)), "en", "s2", 1)]
    rows += [rows[0], rows[0], (200, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    out = docs
    from pyspark.sql import functions as F

    for c in CLASHING:
        out = out.withColumn(c, F.lit(f"{c}!"))
    return out


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
