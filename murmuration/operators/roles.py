"""Column-role resolution: which source column plays text / Influencer / Timestamp / URL / Outlet.

The reference decides roles from column names plus one property of the data ("is the column
blank in every row?"), under the row filters it applies before each check. Here every row gets a
mask with one bit per condition and candidate column, rows are grouped by mask, and all combinations
of text, time and URL column are answered from the distinct masks, in **one** job; the driver then
picks names from a handful of booleans. No data reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.functions.text import is_nonblank, nan_to_null
from murmuration.functions.timestamps import parse_timestamp

# Alias lists, in the reference's priority order. ``user_name``/``timestamp`` are
# the names the reference's README documents; they are appended as last-priority aliases.
TEXT_ALIASES = ["text", "Hit Sentence", "Opening Text", "Headline", "message", "title", "content",
                "description", "Body", "FullText"]
INFLUENCER_ALIASES = ["Influencer", "author", "username", "user", "authorMeta/name", "creator",
                      "authorname", "Source", "media_name", "user_name"]
OUTLET_ALIASES = ["media_name", "channeltitle", "source"]
TIMESTAMP_ALIASES = ["Date", "createTimeISO", "published_date", "pubDate", "created_at",
                     "Alternate Date Format", "publish_date", "timestamp"]
URL_ALIASES = ["URL", "url", "webVideoUrl", "link", "post_url", "media_url", "urls"]
# Default selections of the reference's column-mapping widgets.
ROLE_DEFAULT_NAMES = {"text": "text", "influencer": "Influencer", "timestamp": "Timestamp",
                      "url": "URL", "outlet": "Outlet"}
UNKNOWN_USER = "Unknown_User"


class NoDataError(RuntimeError):
    """Raised where the reference stops because a stage has no rows left."""

    def __init__(self, stage: str):
        super().__init__(f"no data after {stage}")
        self.stage = stage


def strip_names(df: DataFrame) -> DataFrame:
    """Trim whitespace around column names; refuse if two names collide afterwards."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) != len(names):
        dup = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"column names collide after stripping: {dup}")
    return df.toDF(*names) if names != df.columns else df


def default_index(name: str, options: list[str]) -> str | None:
    """Exact name match, else the first case-insensitive match, else None."""
    if name in options:
        return name
    low = [o.lower() for o in options]
    return options[low.index(name.lower())] if name.lower() in low else None


def column_roles(columns: list[str]) -> dict[str, str | None]:
    """Default role -> column choice from the column names alone."""
    return {role: default_index(n, columns) for role, n in ROLE_DEFAULT_NAMES.items()}


def _first_physical(columns: list[str], name: str) -> str | None:
    low = [c.lower() for c in columns]
    return columns[low.index(name.lower())] if name.lower() in low else None


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _str(name: str) -> Column:
    return _col(name).cast("string")


def _nonblank_or_null(name: str) -> Column:
    """The reference stringifies a null to 'nan', so a null row is *not* blank."""
    s = _str(name)
    return s.isNull() | is_nonblank(s)


def _valid_text(name: str) -> Column:
    s = nan_to_null(_str(name))
    return s.isNotNull() & is_nonblank(s)


@dataclass
class Roles:
    text: str | None = None
    influencer: str | None = None
    outlet_for_influencer: str | None = None
    timestamp: str | None = None
    url: str | None = None
    outlet: str | None = None
    platform_mode: str = "unknown"  # "keep" | "infer" | "unknown"
    notes: list[str] = field(default_factory=list)


class _Masks:
    """Conditions on a row as bits of a few longs. ``of`` groups the rows by their mask, so each
    condition is evaluated once a row, and any combination of them on the few distinct masks."""

    BITS = 62

    def __init__(self):
        self.conditions: list[Column] = []

    def bit(self, condition: Column) -> Column:
        """The condition as a test of the mask."""
        word, k = divmod(len(self.conditions), self.BITS)
        self.conditions.append(F.coalesce(condition, F.lit(False)))
        return F.col(f"m{word}").bitwiseAND(F.lit(1 << k).cast("long")) != 0

    def of(self, df: DataFrame) -> DataFrame:
        words = []
        for lo in range(0, len(self.conditions), self.BITS):
            mask = F.lit(0).cast("long")
            for k, c in enumerate(self.conditions[lo:lo + self.BITS]):
                mask = mask.bitwiseOR(F.when(c, F.lit(1 << k).cast("long"))
                                      .otherwise(F.lit(0).cast("long")))
            words.append(mask.alias(f"m{len(words)}"))
        return df.select(*words).groupBy(*[f"m{k}" for k in range(len(words))]) \
            .agg(F.count(F.lit(1)).alias("rows"))


def _candidates(columns: list[str], user_col: str | None, aliases: list[str]) -> list[str]:
    out = []
    if user_col and user_col in columns:
        out.append(user_col)
    for a in aliases:
        c = _first_physical(columns, a)
        if c is not None and c not in out:
            out.append(c)
    return out


def _pick(flags: dict, key_fn, columns: list[str], user_col: str | None, aliases: list[str]):
    if user_col and user_col in columns and flags.get(key_fn(user_col)):
        return user_col
    for a in aliases:
        c = _first_physical(columns, a)
        if c is not None and flags.get(key_fn(c)):
            return c
    return None


def resolve_roles(df: DataFrame, text_col: str | None = None, influencer_col: str | None = None,
                  timestamp_col: str | None = None, url_col: str | None = None,
                  outlet_col: str | None = None, day_first: bool = False,
                  epoch_unit: str | None = None) -> Roles:
    """Resolve roles with one aggregate job (see module docstring)."""
    cols = df.columns
    if timestamp_col is None:
        timestamp_col = default_index("Timestamp", cols)
    if text_col is None:
        text_col = default_index("text", cols)
    if influencer_col is None:
        influencer_col = default_index("Influencer", cols)
    if url_col is None:
        url_col = default_index("URL", cols)
    text_c = _candidates(cols, text_col, TEXT_ALIASES)
    infl_c = _candidates(cols, influencer_col, INFLUENCER_ALIASES)
    outl_c = _candidates(cols, outlet_col, OUTLET_ALIASES)
    ts_c = _candidates(cols, timestamp_col, TIMESTAMP_ALIASES)
    url_c = _candidates(cols, url_col, URL_ALIASES)
    has_platform = "Platform" in cols

    masks = _Masks()
    tests, keys = [], []

    def add(key: str, *bits: Column):
        keys.append(key)
        held = bits[0]
        for x in bits[1:]:
            held = held & x
        tests.append(F.max(held.cast("int")).alias(f"f{len(keys) - 1}"))

    filled = {c: masks.bit(_nonblank_or_null(c))
              for c in dict.fromkeys(text_c + infl_c + outl_c + ts_c + url_c)}
    parsed = {s: masks.bit(parse_timestamp(_col(s), day_first, epoch_unit).isNotNull())
              for s in ts_c}
    linked = {u: masks.bit(nan_to_null(_str(u)).isNotNull()) for u in url_c}
    if has_platform:
        plat_any = masks.bit(_col("Platform").isNotNull())
        plat_filled = masks.bit(_nonblank_or_null("Platform"))
    for t in text_c:
        vt = masks.bit(_valid_text(t))
        add(f"text|{t}", filled[t])
        for c in dict.fromkeys(infl_c + outl_c + ts_c):
            add(f"after_text|{t}|{c}", vt, filled[c])
        for s in ts_c:
            for u in url_c:
                add(f"after_ts|{t}|{s}|{u}", vt, parsed[s], filled[u])
                add(f"url_any|{t}|{s}|{u}", vt, parsed[s], linked[u])
            if has_platform:
                add(f"plat_any|{t}|{s}", vt, parsed[s], plat_any)
                add(f"plat_nonblank|{t}|{s}", vt, parsed[s], plat_filled)
    flags = {}
    if tests:
        row = masks.of(df).agg(*tests).collect()[0]
        flags = {k: bool(row[i]) for i, k in enumerate(keys)}

    r = Roles(outlet=outlet_col if outlet_col in cols else None)
    r.text = _pick(flags, lambda c: f"text|{c}", cols, text_col, TEXT_ALIASES)
    if r.text is None:
        r.notes.append("no text column: every row is dropped")
        return r
    t = r.text
    r.influencer = _pick(flags, lambda c: f"after_text|{t}|{c}", cols, influencer_col,
                         INFLUENCER_ALIASES)
    if r.influencer is None:
        r.outlet_for_influencer = _pick(flags, lambda c: f"after_text|{t}|{c}", cols, outlet_col,
                                        OUTLET_ALIASES)
    r.timestamp = _pick(flags, lambda c: f"after_text|{t}|{c}", cols, timestamp_col,
                        TIMESTAMP_ALIASES)
    if r.timestamp is None:
        r.notes.append("no timestamp column: every row is dropped")
        return r
    s = r.timestamp
    r.url = _pick(flags, lambda c: f"after_ts|{t}|{s}|{c}", cols, url_col, URL_ALIASES)
    url_any = bool(r.url) and flags.get(f"url_any|{t}|{s}|{r.url}", False)
    if has_platform and flags.get(f"plat_any|{t}|{s}"):
        if flags.get(f"plat_nonblank|{t}|{s}"):
            r.platform_mode = "keep"
        else:
            r.platform_mode = "infer" if url_any else "unknown"
    else:
        r.platform_mode = "infer" if url_any else "unknown"
    return r
