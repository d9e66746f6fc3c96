"""Text column expressions: cleaning, retweet stripping, hashtags, tokens, snippets.

All built on JVM-side regex functions so they stay inside whole-stage codegen. The character
classes below spell out Python's Unicode ``\\s`` / ``\\S`` / ``\\w`` explicitly, because bare
``\\s``/``\\w`` are ASCII-only in both Java regex and RE2. The same strings are reused by the
DuckDB oracle SQL, so both engines see identical patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes and cleaning patterns (semantics of the reference's regexes).
WS = r"[\t\n\x0B\f\r \x1c-\x1f\x85\p{Z}]"     # Python str \s
NWS = r"[^\t\n\x0B\f\r \x1c-\x1f\x85\p{Z}]"   # Python str \S
WORD = r"[\p{L}\p{N}_]"                        # Python str \w

QT_FIRST_LINE = r"^(QT[^;\n]*);[^\n]*"         # cut a leading QT line at its first ';'
URL_RE = rf"http{NWS}+|www{NWS}+"              # links, case-sensitive
ESCAPED_BREAK_RE = r"\\n|\\r|\\t"              # the two-character sequences \n \r \t
RT_MENTION_RE = rf"rt @{NWS}+"                 # lower-case only, no word boundary
QT_MENTION_RE = rf"qt @{NWS}+"
WS_RUN_RE = rf"{WS}+"
RETWEET_PREFIX_RE = rf"(?i)^rt{WS}+@{WORD}+:{WS}*"
EDGE_WS_RE = rf"^{WS}+|{WS}+$"
HASHTAG_RE = rf"#{WORD}+"
TOKEN_RE = rf"{WORD}{{2,}}"                    # maximal runs of >= 2 word characters
MENTION_RE = rf"@({WORD}+)"
RETWEET_FROM_RE = rf"(?i)^{WS}*rt{WS}+@({WORD}+)"
# Literal strings that the reference treats as missing when it stringifies a column.
NAN_LITERAL = "nan"

SNIPPET_CHARS = 150
SNIPPET_SUFFIX = "..."


def is_nonblank(c: Column) -> Column:
    """True when the string holds at least one non-whitespace character (null -> null)."""
    return c.rlike(NWS)


def strip_ws(c: Column) -> Column:
    """Unicode-aware strip (Spark ``trim`` removes only U+0020)."""
    return F.regexp_replace(c, EDGE_WS_RE, "")


def clean_text(c: Column) -> Column:
    """The seven cleaning steps, in order; hashtags are kept. Null -> ''.

    A step searches only texts with what it cannot match without. The steps before it take such
    characters away but add none, and a link's ``http`` is not made by cutting a line short.
    """
    def where(found: Column, t: Column, *steps: tuple[str, str]) -> Column:
        out = t
        for pattern, put in steps:
            out = F.regexp_replace(out, pattern, put)
        return F.when(found, out).otherwise(t)

    c = F.coalesce(c, F.lit(""))
    t = where(c.startswith("QT"), c, (QT_FIRST_LINE, "$1"))
    t = where(c.contains("http") | c.contains("www"), t, (URL_RE, ""))
    t = where(c.contains("\\"), t, (ESCAPED_BREAK_RE, " "))
    t = where(c.contains("@"), t, (RT_MENTION_RE, ""), (QT_MENTION_RE, ""))
    t = F.lower(t)
    t = F.regexp_replace(t, WS_RUN_RE, " ")
    return F.trim(t)


def strip_retweet(c: Column) -> Column:
    """Remove one leading ``RT @user:`` (any case) and strip. Null -> ''."""
    return strip_ws(F.regexp_replace(F.coalesce(c, F.lit("")), RETWEET_PREFIX_RE, ""))


def hashtags(c: Column) -> Column:
    """All ``#word`` occurrences, lower-cased, duplicates and order kept."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HASHTAG_RE), 0),
                       lambda x: F.lower(x))


def tokens(c: Column) -> Column:
    """Word tokens as the TF-IDF vectoriser sees them: lower-cased runs of >= 2 word chars."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_RE), 0)


def handle(c: Column) -> Column:
    """The form in which accounts are compared: lower case, no leading ``@``."""
    return F.lower(F.regexp_replace(strip_ws(c), "^@", ""))


def mentions(c: Column) -> Column:
    """Distinct ``@handle``s of a raw text, lower-cased, in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MENTION_RE), 1)
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def listed_handles(c: Column) -> Column:
    """Distinct handles of a comma- or space-separated list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[,\s]+"), handle)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def retweet_from(c: Column) -> Column:
    """The account a raw text retweets (leading ``RT @user``, any case), else null."""
    found = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), RETWEET_FROM_RE, 1))
    return F.when(found != "", found)


def snippet(c: Column, n: int = SNIPPET_CHARS) -> Column:
    """First ``n`` characters, plus ``...`` when the text is longer."""
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit(SNIPPET_SUFFIX))) \
        .otherwise(c)


def nan_to_null(c: Column) -> Column:
    """A stringified missing value (``'nan'``) becomes null, as in the reference's ``replace``."""
    return F.when(c == F.lit(NAN_LITERAL), F.lit(None).cast("string")).otherwise(c)
