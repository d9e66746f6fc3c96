"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.session import cut_lineage

# ASCII white space only: every other code point is part of a word.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared checkpoint folder.

    Ends the lineage at files every executor can read and lets later steps prune columns.
    """
    return cut_lineage(df)


def nonnull_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def boxed(df: DataFrame, **derived: Column) -> DataFrame:
    """The rows of ``df`` as one struct ``_in`` beside derived columns, so that no helper column
    can clash with a column of the input. ``unboxed`` gives the rows back."""
    return df.select(F.struct("*").alias("_in"), *[c.alias(n) for n, c in derived.items()])


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("_in.*")


def word_count(text: Column) -> Column:
    """Number of words. Each word becomes one sign and white space goes, so that counting needs
    no array of the words (``regexp_count`` makes one)."""
    marks = F.translate(F.regexp_replace(text, WORD_RE, "x"), " \t\n\x0b\x0c\r", "")
    return F.length(marks).cast("long")


def row_hash(df: DataFrame) -> Column:
    """64-bit content hash of every column (a null counts as a value of its own)."""
    parts: list[Column] = []
    for c in df.columns:
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
    return F.xxhash64(*parts)
