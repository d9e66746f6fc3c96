"""Row filters and small bound queries over canonical posts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmuration.functions.text import is_nonblank

# Above this many values an ``isin`` list becomes a broadcast semi join instead of a literal set.


def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(str(d))


def filter_date_range(df: DataFrame, start=None, end=None, ts_col: str = "Timestamp") -> DataFrame:
    """Inclusive UTC day range: ``start <= ts < end + 1 day``; one bound = that side only.

    Both bounds as literals so the predicate reaches the parquet scan when ``ts_col`` is stored.
    """
    cond = F.lit(True)
    if start is not None:
        s = _as_date(start)
        cond = cond & (F.col(ts_col) >= F.lit(dt.datetime(s.year, s.month, s.day)))
    if end is not None:
        e = _as_date(end) + dt.timedelta(days=1)
        cond = cond & (F.col(ts_col) < F.lit(dt.datetime(e.year, e.month, e.day)))
    return df.where(cond)


def filter_platforms(df: DataFrame, platforms, col: str = "Platform") -> DataFrame:
    """Keep rows whose platform is in ``platforms`` (nulls drop out).

    ``platforms`` may be a Python collection (literal set, pushed down) or a one-column DataFrame
    (left-semi join), the form for lists that grow with the data.
    """
    if isinstance(platforms, DataFrame):
        key = platforms.columns[0]
        return df.join(platforms.select(F.col(key).alias("__p")).distinct(),
                       F.col(col) == F.col("__p"), "left_semi")
    return df.where(F.col(col).isin(list(platforms)))


def filter_nonblank(df: DataFrame, col: str = "original_text") -> DataFrame:
    return df.where(F.col(col).isNotNull() & is_nonblank(F.col(col)))


def drop_null_subset(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols)


def date_bounds(df: DataFrame, ts_col: str = "Timestamp") -> DataFrame:
    """One row: first and last post date (UTC)."""
    return df.agg(F.to_date(F.min(ts_col)).alias("min_date"),
                  F.to_date(F.max(ts_col)).alias("max_date"))


def distinct_platforms(df: DataFrame, col: str = "Platform") -> DataFrame:
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("Platform")).distinct()


def apply_global_filters(df: DataFrame, start=None, end=None, platforms=None) -> DataFrame:
    """The sidebar filters: date range, then platform set (``None`` = all non-null platforms)."""
    out = filter_date_range(df, start, end)
    if platforms is None:
        return out.where(F.col("Platform").isNotNull())
    return filter_platforms(out, platforms)
