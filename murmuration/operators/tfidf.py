"""TF-IDF vectors as long-form postings ``(tid, term, w)`` with unit L2 norm per text.

Semantics of the reference's vectoriser (public scikit-learn defaults): lower-case, tokens are
runs of >= 2 word characters, stop words removed, vocabulary = the ``max_features`` terms with the
highest total corpus frequency (ties: term ascending), ``tf`` = raw count,
``idf = ln((1 + n) / (1 + df)) + 1``, then L2 normalisation. ``n`` and ``df`` count *posts*.

Identical texts are collapsed first (``text_groups``): one row per distinct text with its post
count ``c``; every statistic is weighted by ``c`` so results equal the per-post computation while
a group of a million copies is tokenised once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions.stopwords import default_stop_words
from murmuration.functions.text import tokens
from murmuration.operators.blockjoin import block_postings, text_blocks
from murmuration.operators.preprocess import ORDER
from murmuration.session import cut_lineage


def text_key(text: Column) -> Column:
    """What texts are compared and joined by."""
    return F.sha2(text, 256)


def text_groups(posts: DataFrame, text_col: str = "original_text") -> DataFrame:
    """One row per distinct text: ``tid`` (post order of its first post), ``text``, ``c``, and its
    ``key``.

    ``tid`` is unique (it contains the post id) and orders texts by their first appearance.
    """
    text = F.col(text_col)
    return (posts.groupBy(text_key(text).alias("key"))
            .agg(F.min(ORDER).alias("tid"), F.any_value(text).alias("text"),
                 F.count(F.lit(1)).alias("c")))


def text_of_posts(posts: DataFrame, groups: DataFrame, *cols: str,
                  text_col: str = "original_text") -> DataFrame:
    """``posts`` with the ``cols`` of their texts' groups; texts meet by their keys."""
    return posts.withColumn("_key", text_key(F.col(text_col))).join(
        groups.select(F.col("key").alias("_key"), *cols), "_key").drop("_key")


def term_counts(groups: DataFrame, stop_words=None, by: tuple[str, ...] = ()) -> DataFrame:
    """``(tid, c, term, tf)`` for every distinct text; stop words removed.

    Tokens of one text come from one row and stay in its task: the rows are grouped by the texts'
    ``key``, by which ``text_groups`` has dealt them. ``by`` names further columns to keep.
    """
    stop = list(default_stop_words() if stop_words is None else stop_words)
    own = [*dict.fromkeys(("tid", "c", *(["key"] if "key" in groups.columns else []), *by))]
    toks = groups.select(*own, F.explode(tokens(F.col("text"))).alias("term"))
    if stop:
        toks = toks.where(~F.col("term").isin(stop))
    return (toks.groupBy(*own, "term").agg(F.count(F.lit(1)).alias("tf"))
            .select("tid", "c", *by, "term", "tf"))


def vocabulary(tf: DataFrame, max_features: int | None) -> DataFrame:
    """``(term, df, total)``; all terms, or the top ``max_features`` by total frequency (the
    vectoriser's feature)."""
    stats = tf.groupBy("term").agg(F.sum(F.col("tf") * F.col("c")).alias("total"),
                                   F.sum("c").alias("df"))
    if max_features:
        stats = stats.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    return stats


def n_documents(groups: DataFrame) -> DataFrame:
    """One row: the number of posts (documents) behind the groups."""
    return groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_docs"))


def tfidf_postings(groups: DataFrame, max_features: int | None = None,
                   stop_words=None) -> DataFrame:
    """Unit-length postings ``(tid, term, df, w)``.

    Texts are tokenised once, into blocks with their own numbers of terms (written); only the distinct
    terms of each block meet the vocabulary, an ordinary join side (Spark broadcasts it only when
    its size is below the session's threshold). The document count enters as a scalar subquery.
    """
    raw = cut_lineage(text_blocks(groups, "tid", "text", stop_words, copies_col="c"))
    counted = raw.select(F.explode(F.arrays_zip("terms", "dfs", "totals")).alias("t")).select(
        F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"),
        F.col("t.totals").alias("total"))
    vocab = counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    if max_features:
        vocab = vocab.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    n = n_documents(groups).scalar()  # scalar subquery: the number of posts
    return block_postings(raw, vocab.select(
        "term", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")), "tid")
