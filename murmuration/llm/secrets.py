"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the base kinds (assignments, access keys, long hex) and ``generic`` tokens: 24 or
more of ``[A-Za-z0-9+/_-]`` with a digit, an upper-case and a lower-case letter. Every
candidate's value is hashed, and per hash the distinct repositories and owners holding it are
counted over the whole corpus. A value held by ``example_owners`` or more owners, or in
``example_repos`` or more repositories of however few owners, is a widely copied example; any
other value looks live. A repository belongs to its owner: one id under two owners is two. Base spans are always reported; a generic
span only if it looks live and overlaps no base span.

Positions come from splitting a text at the matches: a match starts where the lengths of all
parts and matches before it end. They are code points, end exclusive.

Null text counts as empty; a null owner or repository is one of its own. Repeated rows are
scanned like any other. Texts without a match cost one regular-expression pass a kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import nonnull_text, written

# The patterns of the kinds, in the order they are listed.
KINDS = ("assign", "access", "hex", "generic")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ACCESS = "AKIA[A-Z0-9]{16,}"          # = AKIA[A-Z0-9]+ of 20 or more: runs are maximal
HEX = "[0-9a-f]{24,}"                 # = [0-9a-f]+ of 24 or more
GENERIC = "[A-Za-z0-9+/_-]{24,}"
MIN_VALUE = 6


def any_case(word: str) -> str:
    """ASCII letters in either case; (?i) would also match some non-ASCII letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = ("(?:" + "|".join(map(any_case, KEYWORDS))
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def find_spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: array of (start, kind number, end, value)."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    start = F.struct(F.lit(0).cast("long").alias("at"),
                     F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
                     .alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["between"])
        end = begin + F.length(x["whole"])
        one = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                       end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["found"], F.array(one)).alias("found"))

    # the part after the last match has no match of its own
    rows = F.filter(F.arrays_zip(between.alias("between"), whole.alias("whole"),
                                 value.alias("value")), lambda x: x["whole"].isNotNull())
    found = F.aggregate(rows, start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), found).otherwise(start["found"])


def candidates(text: Column) -> tuple[Column, Column]:
    """Base spans and generic spans of a text."""
    assign = F.filter(find_spans(text, ASSIGN, "assign", 1),
                      lambda x: F.length(x["value"]) >= MIN_VALUE)
    base = F.concat(assign, find_spans(text, ACCESS, "access"), find_spans(text, HEX, "hex"))
    generic = F.filter(find_spans(text, GENERIC, "generic"),
                       lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Z]")
                       & x["value"].rlike("[a-z]"))
    return base, generic


def ownership(found: DataFrame) -> DataFrame:
    """``(digest, owners, repos)`` from rows of (digest, owner, repo): distinct counts by
    repeated grouping, each with map-side partial aggregation, so a hot value costs one row
    per owner and task."""
    per_repo = found.select("digest", "owner", "repo").distinct()
    per_owner = per_repo.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"),
                                           F.sum("repos").alias("repos"))


def _join_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"),
        x["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         owner_col: str = "source", repo_col: str = "doc_id",
         example_owners: int = 3, example_repos: int = 10) -> DataFrame:
    """One row per document: id, ``base`` and ``added`` spans (arrays of start, kind, end, live,
    and the value's owners and repos), and ``live`` / ``examples``, the spans by verdict of
    their value."""
    text = nonnull_text(text_col)
    base, generic = candidates(text)
    found = written(docs.select(F.col(id_col).alias("_id"), F.col(owner_col).alias("owner"),
                                F.col(repo_col).alias("repo"), base.alias("base"),
                                generic.alias("generic"))
                    .withColumn("generic", F.filter("generic", lambda g: ~F.exists(
                        F.col("base"), lambda b: (g["start"] < b["end"])
                        & (b["start"] < g["end"]))))
                    .withColumn("_row", F.monotonically_increasing_id()))
    one = (found.select("_row", "owner", "repo",
                        F.explode(F.concat("base", "generic")).alias("span"))
           .select("_row", "owner", "repo", F.sha2("span.value", 256).alias("digest"),
                   F.struct("span.start", "span.kind", "span.end").alias("span")))
    judged = one.join(ownership(one), "digest").withColumn(
        "live", (F.col("owners") < example_owners) & (F.col("repos") < example_repos))
    spans = F.collect_list(F.struct("span.*", "live", "owners", "repos"))   # of one document
    per_row = judged.groupBy("_row").agg(spans.alias("spans"))
    is_base = [F.filter(F.col("spans"), c) for c in (
        lambda x: x["kind"] < 3, lambda x: (x["kind"] == 3) & x["live"],
        lambda x: x["live"], lambda x: ~x["live"])]
    named = dict(zip(("base", "added", "live", "examples"), is_base, strict=True))
    return (found.select("_row", "_id").join(per_row, "_row", "left")
            .withColumn("spans", F.coalesce("spans", F.array().cast(
                "array<struct<start:bigint,kind:int,end:bigint,live:boolean,owners:bigint,"
                "repos:bigint>>")))
            .select(F.col("_id").alias(id_col), *[c.alias(n) for n, c in named.items()]))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of a scan."""
    def count(kind: int) -> Column:
        return (F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
                .alias(f"n_{KINDS[kind]}"))

    return scanned.select(
        id_col, *map(count, range(3)), F.sha2(_join_spans(F.col("base")).cast("binary"), 256)
        .alias("base_sha256"),
        _join_spans(F.concat("base", "added")).alias("spans"),
        _join_spans(F.col("live")).alias("live_spans"),
        _join_spans(F.col("examples")).alias("example_spans"))


def _sql_spans(pattern: str, kind: int, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""(SELECT doc, {kind} AS kind, k,
        list_sum(list_transform(parts[:k], lambda x: length(x)))
          + coalesce(list_sum(list_transform(hits[:k - 1], lambda x: length(x))), 0) AS a,
        length(hits[k]) AS n, vals[k] AS value
      FROM (SELECT doc, string_split_regex(t, '{p}') AS parts,
              regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS vals,
              unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS k FROM texts)
      WHERE {keep})"""


def oracle(example_owners: int = 3) -> str:
    """DuckDB SQL with the same result over ``documents``."""
    kinds = [_sql_spans(ASSIGN, 0, 1, f"length(vals[k]) >= {MIN_VALUE}"),
             _sql_spans(ACCESS, 1, 0, "true"), _sql_spans(HEX, 2, 0, "true")]
    base = " UNION ALL ".join(f"SELECT * FROM {x}" for x in kinds)
    generic = _sql_spans(GENERIC, 3, 0, " AND ".join(
        f"regexp_matches(vals[k], '{c}')" for c in ("[0-9]", "[A-Z]", "[a-z]")))
    name = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'generic' END"
    joined = f"string_agg({name} || ':' || a || ':' || (a + n), ',' ORDER BY a, kind)"
    none = "coalesce({}, '')"

    def agg(where: str) -> str:
        return none.format(f"{joined} FILTER (WHERE {where})")

    return f"""
    WITH texts AS (SELECT row_number() OVER () AS doc, doc_id, source, coalesce(text, '') AS t
                   FROM documents),
    base AS ({base}),
    added AS (SELECT g.* FROM {generic} g WHERE NOT EXISTS (SELECT 1 FROM base b
              WHERE b.doc = g.doc AND b.a < g.a + g.n AND g.a < b.a + b.n)),
    spans AS (SELECT * FROM base UNION ALL SELECT * FROM added),
    owners AS (SELECT value, count(DISTINCT coalesce('s' || source, 'none')) AS owners
               FROM spans JOIN texts USING (doc) GROUP BY value),
    judged AS (SELECT s.*, owners < {example_owners} AS live FROM spans s JOIN owners USING (value)),
    per_doc AS (SELECT doc, count(*) FILTER (WHERE kind = 0) AS n_assign,
        count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
        {agg("kind < 3")} AS base, {agg("kind < 3 OR live")} AS spans,
        {agg("live")} AS live_spans, {agg("NOT live")} AS example_spans
      FROM judged GROUP BY doc)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
        coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
        {none.format('spans')} AS spans, {none.format('live_spans')} AS live_spans,
        {none.format('example_spans')} AS example_spans
    FROM texts LEFT JOIN per_doc USING (doc)"""
