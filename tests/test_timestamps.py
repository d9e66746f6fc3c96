"""Goldens for timestamp parsing: every form, both day orders, and what must stay null."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from murmuration.functions.timestamps import parse_timestamp
from murmuration.operators.preprocess import unparsed_timestamps

T = dt.datetime(2024, 7, 5, 13, 4, 5)
DAY, MINUTE = dt.datetime(2024, 7, 5), dt.datetime(2024, 7, 5, 13, 4)
GOLDEN = {
    "2024-07-05 13:04:05": T, "2024-07-05T13:04:05Z": T, "2024-07-05T15:04:05+02:00": T,
    "2024-07-05 13:04:05.250000": T.replace(microsecond=250000),
    "2024-07-05 08:04:05-0500": T, "2024-07-05": DAY, " 2024-07-05 13:04:05 ": T,
    "Fri Jul 05 13:04:05 +0000 2024": T, "Fri, 05 Jul 2024 13:04:05 GMT": T,
    "Fri, 05 Jul 2024 15:04:05 +0200": T, "Friday, 5 Jul 2024 13:04:05": T,
    "July 5, 2024": DAY, "5 July 2024": DAY, "Jul 5, 2024": DAY, "5 Jul 2024": DAY,
    "July 5, 2024 1:04 PM": MINUTE, "Jul 5, 2024 1:04PM": MINUTE, "5 Jul 2024 1:04PM": MINUTE,
    "Jul 5, 2024 @ 13:04:05.000000": T, "5-Jul-2024 1:04PM": MINUTE,
    "2024/07/05": DAY, "2024/07/05 13:04:05": T, "20240705": DAY,
    "7/5/2024": DAY, "7/5/2024 13:04": MINUTE, "7/5/2024 13:04:05": T, "7/5/2024 1:04 PM": MINUTE,
    "13/02/2024": dt.datetime(2024, 2, 13), "13/02/2024 10:00": dt.datetime(2024, 2, 13, 10),
    "Fri Jul  5 13:04:05 2024": T, "Fri Jul 5 13:04:05 UTC 2024": T, "7/5/2024, 1:04:05 PM": T,
    "2024-07-05 1:04 PM": MINUTE, "2024-07-05 13:04:05,123": T.replace(microsecond=123000),
    "Jul 5 2024 1:04PM": MINUTE, "5-Jul-24": DAY, "7/5/24": DAY, "07.05.2024": DAY,
    "07-05-2024 10:00": dt.datetime(2024, 7, 5, 10), "Sept 5, 2024": dt.datetime(2024, 9, 5),
    "July 5th, 2024": DAY, "20240705130405": T, "20240705T130405": T,
    "2024/07/05 13:04 +0200": dt.datetime(2024, 7, 5, 11, 4), "Jul 2024": dt.datetime(2024, 7, 1),
    "Jul. 5, 2024 1pm": dt.datetime(2024, 7, 5, 13), "5 Jul 2024 12:04 a.m.":
    dt.datetime(2024, 7, 5, 0, 4), "7/5/99": dt.datetime(1999, 7, 5), "2024 July 5": DAY,
    "1st of May": None, "Jul 5 2024 13:04 PM": None, "31/2/2024": None, "1/2/3/4": None,
    "12": None, "5 Julember 2024": None, "7/5/2024 25:00": None, "7/5/2024 1:2": None,
    "13:04:05": None, "13:04:05.1234": None, "T13:04": None, "soon": None, "": None, None: None,
    "2024-13-45": None, "99/99/2024": None,
}


def parsed(spark, values, **kw):
    df = spark.createDataFrame(list(enumerate(values)), "k int, s string")
    rows = df.select("k", parse_timestamp(F.col("s"), **kw).alias("t")).orderBy("k").collect()
    return [r["t"] for r in rows]


def test_goldens(spark):
    got = dict(zip(GOLDEN, parsed(spark, list(GOLDEN)), strict=True))
    assert got == GOLDEN


def test_day_first_holds_for_dates_and_date_times(spark):
    values = ["05/02/2024", "05/02/2024 10:00:00", "05/02/2024 1:00 PM", "02/13/2024"]
    assert [t.month for t in parsed(spark, values)] == [5, 5, 5, 2]
    assert [t.month for t in parsed(spark, values, day_first=True)] == [2, 2, 2, 2]


@pytest.mark.parametrize("unit, value", [("s", "1720184645"), ("ms", "1720184645000"),
                                         ("us", "1720184645000000")])
def test_epochs(spark, unit, value):
    assert parsed(spark, [value, "x", "9" * 30], epoch_unit=unit) == [T, None, None]


def test_unparsed_rows_are_counted(spark):
    df = spark.createDataFrame([("2024-07-05",), ("soon",), (None,), (" ",)], "when string")
    assert tuple(unparsed_timestamps(df, "when").first()) == (4, 2, 1)
