"""Platform inference from a post URL, as ordered substring rules (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Platform rules in the reference's order (substring of the lower-cased URL).
PLATFORM_RULES = [
    ("TikTok", ["tiktok.com"]),
    ("Facebook", ["facebook.com", "fb.watch"]),
    ("X", ["twitter.com", "x.com"]),
    ("YouTube", ["youtube.com", "youtu.be"]),
    ("Instagram", ["instagram.com"]),
    ("Telegram", ["telegram.me", "t.me"]),
]
MEDIA = "Media"
UNKNOWN = "Unknown"
PLATFORMS = [p for p, _ in PLATFORM_RULES] + [MEDIA, UNKNOWN]


def infer_platform(url: Column) -> Column:
    """Platform label for a URL column.

    A null URL, or one not starting with lower-case ``http`` (checked before lower-casing),
    is ``Unknown``; then the first matching substring rule wins; any other ``https://`` URL is
    ``Media``; anything else is ``Unknown``.
    """
    low = F.lower(url)
    expr = None
    for label, needles in PLATFORM_RULES:
        cond = None
        for n in needles:
            c = low.contains(n)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = expr.when(low.startswith("https://"), F.lit(MEDIA)).otherwise(F.lit(UNKNOWN))
    return F.when(url.isNull() | ~url.startswith("http"), F.lit(UNKNOWN)).otherwise(expr)
