"""SQL text shared by the DuckDB oracle queries.

These build the same semantics as the Spark operators from the same fixed pattern strings, but
as plain SQL (DuckDB dialect, RE2 regex), so the oracle is an independent engine run over the same
parquet tables.
"""

from __future__ import annotations

from murmuration.functions import text as T
from murmuration.functions.platform import MEDIA, PLATFORM_RULES, UNKNOWN
from murmuration.functions.stopwords import default_stop_words
from murmuration.sources.fixtures import RAW_POSTS_SQL


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def nan_null(x: str) -> str:
    return f"CASE WHEN {x} = 'nan' THEN NULL ELSE {x} END"


def nonblank(x: str) -> str:
    return f"regexp_matches({x}, {q(T.NWS)})"


def clean_text(x: str) -> str:
    t = f"coalesce({x}, '')"
    t = f"regexp_replace({t}, {q(T.QT_FIRST_LINE)}, '\\1')"
    t = f"regexp_replace({t}, {q(T.URL_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {q(T.ESCAPED_BREAK_RE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(T.RT_MENTION_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {q(T.QT_MENTION_RE)}, '', 'g')"
    t = f"lower({t})"
    t = f"regexp_replace({t}, {q(T.WS_RUN_RE)}, ' ', 'g')"
    return f"trim({t})"


def strip_retweet(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), {q(T.RETWEET_PREFIX_RE)}, '')"
    return f"regexp_replace({t}, {q(T.EDGE_WS_RE)}, '', 'g')"


def platform(url: str) -> str:
    parts = [f"CASE WHEN {url} IS NULL OR NOT starts_with({url}, 'http') THEN {q(UNKNOWN)}"]
    for label, needles in PLATFORM_RULES:
        cond = " OR ".join(f"contains(lower({url}), {q(n)})" for n in needles)
        parts.append(f"WHEN {cond} THEN {q(label)}")
    parts.append(f"WHEN starts_with(lower({url}), 'https://') THEN {q(MEDIA)} ELSE {q(UNKNOWN)} END")
    return " ".join(parts)


def snippet(x: str, n: int = T.SNIPPET_CHARS) -> str:
    return f"CASE WHEN length({x}) > {n} THEN substring({x}, 1, {n}) || '...' ELSE {x} END"


def hashtags(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), {q(T.HASHTAG_RE)}), lambda h: lower(h))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {q(T.TOKEN_RE)})"


def stop_words_list() -> str:
    return "[" + ", ".join(q(w) for w in default_stop_words()) + "]"


# Canonical posts over the fixture. Roles are the fixture's (content/author/created_at/link);
# created_at is always 'yyyy-MM-dd HH:mm:ss', so a plain cast parses it; links exist, so the
# platform is inferred from the URL.
def posts_cte(raw: str) -> str:
    return f"""
raw_posts AS ({raw}),
staged AS (
  SELECT DISTINCT post_id,
    {nan_null('content')} AS text_raw,
    coalesce({nan_null('author')}, 'Unknown_User') AS Influencer,
    TRY_CAST(created_at AS TIMESTAMP) AS "Timestamp",
    {nan_null('link')} AS URL
  FROM raw_posts
),
posts0 AS (
  SELECT post_id, text_raw, {clean_text('text_raw')} AS text, Influencer, "Timestamp", URL,
         {platform('URL')} AS Platform
  FROM staged
  WHERE text_raw IS NOT NULL AND {nonblank('text_raw')} AND "Timestamp" IS NOT NULL
),
posts AS (
  SELECT post_id, text_raw, text, {strip_retweet('text')} AS original_text, Influencer,
         "Timestamp", URL, Platform
  FROM posts0
)"""


POSTS_CTE = posts_cte(RAW_POSTS_SQL)


def with_posts(body: str, extra_ctes: str = "", recursive: bool = False,
               raw: str = RAW_POSTS_SQL) -> str:
    """``WITH [RECURSIVE] <posts CTEs>[, extra] <body>`` over the raw posts of ``raw``."""
    ctes = posts_cte(raw) + ((",\n" + extra_ctes) if extra_ctes else "")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def tfidf_ctes(n: str, inp: str, vocab: int | None, threshold: float | None) -> str:
    """CTEs ``{n}_tf, {n}_vocab, {n}_vec`` (and ``{n}_pairs`` at ``threshold``): brute-force
    TF-IDF and all-pairs cosine over post ids (post order = post_id on the fixture)."""
    stop = stop_words_list()
    ctes = f"""
{n}_toks AS (SELECT post_id, unnest({tokens('original_text')}) AS term FROM {inp}),
{n}_tf AS (SELECT post_id, term, count(*) AS tf FROM {n}_toks
           WHERE NOT list_contains({stop}, term) GROUP BY post_id, term),
{n}_vocab AS (SELECT term, count(*) AS df, sum(tf) AS total FROM {n}_tf GROUP BY term
              {"" if vocab is None else f"ORDER BY total DESC, term LIMIT {vocab}"}),
{n}_n AS (SELECT count(*) AS n FROM {inp}),
{n}_raw AS (SELECT t.post_id, t.term, t.tf * (ln((1 + c.n) / (1 + v.df)) + 1) AS w
            FROM {n}_tf t JOIN {n}_vocab v ON v.term = t.term CROSS JOIN {n}_n c),
{n}_vec AS (SELECT post_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY post_id)) AS w
            FROM {n}_raw)"""
    if threshold is not None:
        ctes += f""",
{n}_pairs AS (SELECT a.post_id AS id1, b.post_id AS id2, sum(a.w * b.w) AS sim
              FROM {n}_vec a JOIN {n}_vec b ON a.term = b.term AND a.post_id < b.post_id
              GROUP BY a.post_id, b.post_id HAVING sum(a.w * b.w) >= {threshold})"""
    return ctes


def platforms_involved(p1: str, p2: str) -> str:
    return (f"array_to_string(list_sort(list_distinct(list_filter([{p1}, {p2}], "
            f"lambda x: x IS NOT NULL AND {nonblank('x')}))), ', ')")


def first_k_sql(table: str, group: str, value: str, order: str, k: int, out: str) -> str:
    """SELECT group, '<first k distinct values by order>[...]' AS out FROM table."""
    return f"""SELECT {group}, string_agg({value}, ', ' ORDER BY o)
        || CASE WHEN max(nd) > {k} THEN '...' ELSE '' END AS {out}
      FROM (SELECT {group}, {value}, o,
                   row_number() OVER (PARTITION BY {group} ORDER BY o) AS rn,
                   count(*) OVER (PARTITION BY {group}) AS nd
            FROM (SELECT {group}, {value}, min({order}) AS o FROM {table}
                  WHERE {value} IS NOT NULL GROUP BY {group}, {value}))
      WHERE rn <= {k} GROUP BY {group}"""
