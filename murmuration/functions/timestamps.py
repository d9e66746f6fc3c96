"""Loose timestamp parsing: ISO values by Spark's own parser, all others by one small grammar.

A value is split once: the time of day (``13:04``, ``1:04:05.25 PM``, ``1pm``), the offset or zone
name behind it, and what is left, the date, as up to three tokens. Each token is a year (four
digits), a number (one or two) or a month name; the sequence of kinds is the date's *shape*, and a
table tells which token of a shape is year, month and day. The timestamp is built from these
numbers, so values that no calendar has are null. Weekday names in front, commas, ``@`` and the
``st`` of ``1st`` are left out first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, and the shapes with the places of year, month and day (from 1; 0: the first).
# Y year, n number, M month name. Shapes of two numbers beside a year are month-first or day-first.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_RE = (r"^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?"
            r"|oct(ober)?|nov(ember)?|dec(ember)?)$")
SHAPES = {"MnY": (3, 1, 2), "nMY": (3, 2, 1), "YMn": (1, 2, 3), "Ynn": (1, 2, 3),
          "Mnn": (3, 1, 2), "nMn": (3, 2, 1), "MY": (2, 1, 0), "YM": (1, 2, 0)}
EITHER_WAY = ("nnY", "nnn")
WEEKDAY_RE = r"^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?\.?,?\s+"
COMPACT_RE = r"^(\d{4})(\d{2})(\d{2})(?:[t ]?(\d{2})(\d{2})(\d{2}))?$"
BARE_HOUR_RE = r"(?<![:\d])(\d{1,2})\s*([ap])\.?m\b"
TIME_RE = r"(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)(?:\s*([ap])\.?m\b\.?)?"
ZONE_RE = r"(?:\s*(z|gmt|utc|ut|[+-]\d{2}:?\d{2})(?![\w:]))?"
NOISE_RE = r"[,@]|(?<=\d)(st|nd|rd|th)\b|(?<=[a-z])\."
CENTURY = 69                                        # two-digit years from here on are 19xx
ISO_RE = r"^[0-9]{4}(-[0-9]{1,2}){0,2}([T ].*)?$"   # Spark's own parser; never a time alone
EPOCH_RE = r"^-?[0-9]+$"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _kind(token: Column) -> Column:
    return (F.when(token.rlike(r"^\d{4}$"), "Y").when(token.rlike(r"^\d{1,2}$"), "n")
            .when(token.rlike(MONTH_RE), "M").otherwise("?"))


def _time_of_day(r: Column) -> tuple[Column, Column, Column]:
    """Hour, minute and second (decimal) of the time found; zero without one, null if the hour is
    none of a twelve-hour clock."""
    def part(k: int) -> Column:
        return F.coalesce(F.get(r["time"], F.lit(k)), F.lit("0"))

    hour = F.when(r["time"][0] == "", F.lit(0)).otherwise(_number(part(0)))
    hour = (F.when(r["half"] == "", hour)
            .when(hour.between(1, 12), hour % 12 + F.when(r["half"] == "p", 12).otherwise(0)))
    second = F.concat(part(2), F.lit("."), F.substring(part(3), 1, 6))
    return hour, _number(part(1)), second.try_cast("decimal(16,6)")


def _offset_micros(zone: Column) -> Column:
    """An offset in microseconds; zero for none and for zone names."""
    minutes = (_number(F.substring(zone, 2, 2)) * 60
               + _number(F.substring(F.replace(zone, F.lit(":"), F.lit("")), 4, 2)))
    return (F.when(zone.startswith("-"), -minutes).when(zone.startswith("+"), minutes)
            .otherwise(F.lit(0)) * F.lit(60_000_000).cast("long"))


def _made(r: Column, day_first: bool) -> Column:
    """The timestamp of a split value ``(time, half, zone, tokens, shape)``."""
    def token(k: Column) -> Column:
        return F.get(r["tokens"], k - 1)

    def built(place: Column) -> Column:
        y, a, b = (token(place[k]) for k in range(3))
        year = _number(y)
        year = F.when(F.length(y) > 2, year).otherwise(
            year + F.when(year < CENTURY, 2000).otherwise(1900))
        named = F.floor((F.instr(F.lit(MONTHS), F.substring(a, 1, 3)) + 2) / 3).cast("int")
        month, day = F.coalesce(_number(a), named), F.coalesce(_number(b), F.lit(1))
        swap = r["shape"].isin(*EITHER_WAY) & (month > 12)
        hour, minute, second = _time_of_day(r)
        at = F.try_make_timestamp(year, F.when(swap, day).otherwise(month),
                                  F.when(swap, month).otherwise(day), hour, minute, second)
        return F.timestamp_micros(F.unix_micros(at) - _offset_micros(r["zone"]))

    shapes = SHAPES | {s: (3, 2, 1) if day_first else (3, 1, 2) for s in EITHER_WAY}
    places = F.create_map(*[x for s, p in shapes.items()
                            for x in (F.lit(s), F.array(*map(F.lit, p)))])
    return _bind(F.try_element_at(places, r["shape"]),
                 lambda p: F.when(p.isNotNull(), built(p)))


def _by_shape(z: Column, day_first: bool) -> Column:
    """The timestamp of a lower-case value."""
    found = TIME_RE + ZONE_RE
    date = F.trim(F.regexp_replace(F.regexp_replace(z, found, " "), NOISE_RE, " "))
    split = F.struct(F.split(F.regexp_extract(z, found, 1), "[:.,]").alias("time"),
                     F.regexp_extract(z, found, 2).alias("half"),
                     F.regexp_extract(z, found, 3).alias("zone"),
                     F.split(date, r"[\s/.\-]+").alias("tokens"))
    return _bind(split, lambda r: _bind(
        F.struct(r["time"].alias("time"), r["half"].alias("half"), r["zone"].alias("zone"),
                 r["tokens"].alias("tokens"),
                 F.array_join(F.transform(r["tokens"], _kind), "").alias("shape")),
        lambda x: _made(x, day_first)))


def parse_timestamp(c: Column, day_first: bool = False, epoch_unit: str | None = None) -> Column:
    """Parse a string column into a UTC timestamp; null where neither form fits.

    * ``epoch_unit`` in {"s", "ms", "us"} reads integer strings as epoch offsets, before all else;
    * ISO-like values next (a four-digit year must come first, so a bare time never turns into
      today);
    * then the grammar. Two numbers beside a year are month and day, or day and month with
      ``day_first``, unless the month would be above twelve.
    Naive values are taken as UTC (the session time zone is UTC); values with an offset are
    converted to UTC.
    """
    s = F.trim(c.cast("string"))
    candidates = []
    if epoch_unit:
        fn = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[epoch_unit]
        candidates.append(F.when(s.rlike(EPOCH_RE), fn(s.try_cast("long"))))
    candidates.append(F.when(s.rlike(ISO_RE), F.try_to_timestamp(s)))
    z = F.regexp_replace(F.lower(s), WEEKDAY_RE, "")
    candidates.append(_bind(z, lambda v: _bind(
        F.when(v.rlike(COMPACT_RE), F.regexp_replace(F.regexp_replace(
            v, COMPACT_RE, "$1-$2-$3 $4:$5:$6"), " ::$", ""))
        .otherwise(F.regexp_replace(v, BARE_HOUR_RE, "$1:00 $2m")),
        lambda w: _by_shape(w, day_first))))
    return F.coalesce(*candidates)
