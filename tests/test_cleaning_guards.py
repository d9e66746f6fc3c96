"""Cleaning: steps that are skipped where they cannot match give what all steps give."""

import random

from pyspark.sql import functions as F

from murmuration.functions import text as T


def plain(c):
    t = F.coalesce(c, F.lit(""))
    for pattern, put in ((T.QT_FIRST_LINE, "$1"), (T.URL_RE, ""), (T.ESCAPED_BREAK_RE, " "),
                         (T.RT_MENTION_RE, ""), (T.QT_MENTION_RE, "")):
        t = F.regexp_replace(t, pattern, put)
    return F.trim(F.regexp_replace(F.lower(t), T.WS_RUN_RE, " "))


def test_guarded_steps_equal_all_steps(spark):
    rng = random.Random(5)
    parts = ["QT", " ", "ht", "tp", "http", "www", ";", "\n", "\\n", "\\", "n", "rt", " @", "@bob", "qt",
             "r", "t @x", "word", "\t", "É"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))),) for _ in range(4000)]
    df = spark.createDataFrame([*rows, (None,), ("rthttp://x @bob y",)], "t string")
    bad = df.where(T.clean_text(F.col("t")) != plain(F.col("t"))).count()
    assert bad == 0
