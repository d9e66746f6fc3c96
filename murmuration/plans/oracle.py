"""DuckDB oracle SQL for the registered queries (same column names as the Spark results)."""

from __future__ import annotations

from murmuration.plans import catalog as C
from murmuration.sources.files import NA_TOKENS
from murmuration.plans.sqlparts import RAW_POSTS_SQL, hashtags, platform, q, with_posts

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# ---- A/B ------------------------------------------------------------------------------------
def _csv(column: str) -> str:
    return f"CASE WHEN {column} IN ({', '.join(map(q, NA_TOKENS))}) THEN NULL ELSE {column} END"


oracle("load_posts", "SELECT " + ", ".join(
    f"{_csv(c)} AS {c}" for c in ("doc_id", "text", "lang", "source", "n_chars"))
    + " FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM documents)")
oracle("union_posts", f"""WITH t AS (SELECT CAST(page_id AS VARCHAR) AS id, {_csv('url')} AS url,
  {_csv('html')} AS content FROM pages)
SELECT id, url, content, NULL AS role FROM t
UNION ALL SELECT CAST(conv_id AS VARCHAR), NULL, {_csv('text')}, {_csv('role')} FROM conversations""")
oracle("export_posts", RAW_POSTS_SQL)
oracle("union_dedupe", f"""WITH raw AS ({RAW_POSTS_SQL})
SELECT DISTINCT * FROM (
  SELECT post_id, author, created_at, content, link FROM raw
  UNION ALL SELECT post_id, author, created_at, content, link FROM raw
  UNION ALL SELECT post_id, author, created_at, content, NULL AS link FROM raw)""")
oracle("preprocess_posts", with_posts(
    'SELECT post_id, text, original_text, Influencer, "Timestamp", URL, Platform FROM posts'))
oracle("infer_platform", f"""SELECT id, kind, url, {platform('url')} AS platform FROM (
  SELECT post_id AS id, 'post' AS kind, link AS url FROM ({RAW_POSTS_SQL})
  UNION ALL SELECT page_id, 'page', url FROM pages)""")
oracle("parse_timestamps", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")

# ---- C --------------------------------------------------------------------------------------
oracle("filter_date_range", with_posts(
    f'SELECT post_id, Influencer, "Timestamp", Platform FROM posts '
    f"WHERE \"Timestamp\" >= TIMESTAMP '{C.FILTER_START}' "
    f"AND \"Timestamp\" < TIMESTAMP '{C.FILTER_END}' + INTERVAL 1 DAY"))
oracle("filter_platforms", with_posts(
    "SELECT post_id, Platform FROM posts WHERE Platform IN ("
    + ", ".join(q(p) for p in C.FILTER_PLATFORMS) + ")"))
oracle("date_bounds", with_posts(
    'SELECT CAST(min("Timestamp") AS DATE) AS min_date, CAST(max("Timestamp") AS DATE) AS max_date '
    "FROM posts"))
oracle("distinct_platforms", with_posts(
    "SELECT DISTINCT Platform FROM posts WHERE Platform IS NOT NULL"))

# ---- D --------------------------------------------------------------------------------------
oracle("sample_posts", with_posts(
    "SELECT post_id, Influencer, Platform, URL FROM posts ORDER BY post_id LIMIT 10"))
oracle("top_influencers", with_posts(
    "SELECT Influencer, count(*) AS posts FROM posts GROUP BY Influencer "
    "ORDER BY posts DESC, Influencer LIMIT 10"))
oracle("platform_counts", with_posts(
    "SELECT Platform, count(*) AS posts FROM posts WHERE Platform IS NOT NULL GROUP BY Platform"))
oracle("top_outlets", with_posts(
    "SELECT d.source AS Outlet, count(*) AS posts FROM posts p JOIN documents d "
    "ON d.doc_id = p.post_id WHERE d.source IS NOT NULL GROUP BY d.source "
    "ORDER BY posts DESC, Outlet LIMIT 10"))
oracle("extract_hashtags", with_posts(
    f"SELECT post_id, array_to_string({hashtags('text')}, ' ') AS hashtags FROM posts"))
oracle("top_hashtags", with_posts(
    f"SELECT hashtag, count(*) AS frequency FROM (SELECT unnest({hashtags('text')}) AS hashtag "
    "FROM posts WHERE Platform IS DISTINCT FROM 'Media') GROUP BY hashtag "
    "ORDER BY frequency DESC, hashtag LIMIT 10"))
oracle("daily_volume", with_posts(
    "SELECT CAST(d.day AS DATE) AS day, coalesce(c.posts, 0) AS posts FROM "
    "(SELECT unnest(generate_series(date_trunc('day', min(\"Timestamp\")), "
    "date_trunc('day', max(\"Timestamp\")), INTERVAL 1 DAY)) AS day FROM posts) d "
    "LEFT JOIN (SELECT date_trunc('day', \"Timestamp\") AS day, count(*) AS posts FROM posts "
    "GROUP BY 1) c ON c.day = d.day"))



# ---- E: TF-IDF, similar pairs, narratives ---------------------------------------------------
from murmuration.plans.sqlparts import (  # noqa: E402
    first_k_sql, nonblank, platforms_involved, snippet, tfidf_ctes)

SIM_IN = f"""sim_in AS (SELECT * FROM posts WHERE original_text IS NOT NULL AND Influencer IS NOT NULL
  AND "Timestamp" IS NOT NULL AND Platform IS NOT NULL AND {nonblank('original_text')})"""
SIM = SIM_IN + "," + tfidf_ctes("sim", "sim_in", C.SIM_VOCAB, C.SIM_THRESHOLD)
SP = f"""sp AS (SELECT a.post_id AS post_id1, b.post_id AS post_id2,
  a.original_text AS text1, a.Influencer AS influencer1, a.Platform AS platform1,
  a."Timestamp" AS time1, a.URL AS url1, b.original_text AS text2, b.Influencer AS influencer2,
  b.Platform AS platform2, b."Timestamp" AS time2, b.URL AS url2,
  round(round(p.sim, 9), 3) AS similarity, {snippet('a.original_text')} AS shared_narrative,
  {platforms_involved('a.Platform', 'b.Platform')} AS platforms_involved
  FROM sim_pairs p JOIN sim_in a ON a.post_id = p.id1 JOIN sim_in b ON b.post_id = p.id2)"""
NARR = SP + f""",
narr_infl AS ({first_k_sql('sp', 'shared_narrative', 'influencer1', 'post_id1', 5,
                           'influencers_involved')}),
narr_plat AS (SELECT shared_narrative,
    array_to_string(list_sort(list_distinct(list(p))), ', ') AS platforms_involved
  FROM (SELECT shared_narrative, trim(unnest(string_split(platforms_involved, ','))) AS p FROM sp)
  WHERE p <> '' GROUP BY shared_narrative),
narr AS (SELECT c.shared_narrative, c.share_count, i.influencers_involved,
    coalesce(pl.platforms_involved, '') AS platforms_involved
  FROM (SELECT shared_narrative, count(*) AS share_count FROM sp GROUP BY shared_narrative) c
  LEFT JOIN narr_infl i ON i.shared_narrative = c.shared_narrative
  LEFT JOIN narr_plat pl ON pl.shared_narrative = c.shared_narrative)"""


def _anchor(c: str) -> str:
    esc = c
    for ch, rep in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                    ("'", "&#x27;")):
        esc = f"replace({esc}, {q(ch)}, {q(rep)})"
    return (f"CASE WHEN {c} IS NULL THEN '' ELSE '<a href=\"' || {esc} || "
            f"'\" target=\"_blank\">' || {esc} || '</a>' END")


oracle("tokenize", with_posts(
    "SELECT s.post_id, CAST(coalesce(sum(t.tf), 0) AS BIGINT) AS n_tokens, count(t.tf) AS n_terms "
    "FROM sim_in s LEFT JOIN sim_tf t ON t.post_id = s.post_id GROUP BY s.post_id", SIM))
oracle("vocabulary", with_posts("SELECT term, df, CAST(total AS BIGINT) AS total FROM sim_vocab", SIM))
oracle("tfidf", with_posts("SELECT post_id, term, round(w, 6) AS w FROM sim_vec", SIM))
oracle("similarity_input", with_posts(
    "SELECT post_id, original_text, Influencer, Platform FROM sim_in", SIM_IN))
# pairs of different texts by their first posts; copies are counted, not paired
REP = SP + """,
sim_text AS (SELECT original_text, min(post_id) AS rep, count(*) AS copies FROM sim_in
             GROUP BY original_text),
rep_pairs AS (SELECT sp.*, a.copies AS copies1, b.copies AS copies2 FROM sp
  JOIN sim_text a ON a.rep = sp.post_id1 JOIN sim_text b ON b.rep = sp.post_id2)"""
oracle("similar_pairs", with_posts("SELECT * FROM rep_pairs", SIM + "," + REP))
oracle("text_members", with_posts("""
SELECT s.post_id, t.rep AS text_post_id, t.copies, coalesce(n.n, 0) AS similar_texts
FROM sim_in s JOIN sim_text t ON t.original_text = s.original_text
LEFT JOIN (SELECT r, count(*) AS n FROM (SELECT post_id1 AS r FROM rep_pairs
  UNION ALL SELECT post_id2 FROM rep_pairs) GROUP BY r) n ON n.r = t.rep""", SIM + "," + REP))
oracle("narrative_summary", with_posts("SELECT * FROM narr", SIM + "," + NARR))
oracle("top_narratives", with_posts(
    "SELECT * FROM narr ORDER BY share_count DESC, shared_narrative LIMIT 10", SIM + "," + NARR))
oracle("pair_links", with_posts(
    "SELECT post_id1, post_id2, text1, influencer1, platform1, time1, "
    f"{_anchor('url1')} AS url1, text2, influencer2, platform2, time2, {_anchor('url2')} AS url2, "
    "similarity FROM rep_pairs", SIM + "," + REP))
oracle("high_risk_influencers", with_posts(
    "SELECT Influencer, count(*) AS coordination_instances FROM (SELECT influencer1 AS Influencer "
    "FROM sp UNION ALL SELECT influencer2 FROM sp) GROUP BY Influencer HAVING count(*) >= 3",
    SIM + "," + SP))

# ---- F: clustering --------------------------------------------------------------------------
CLU_IN = f"clu_in AS (SELECT * FROM posts WHERE text IS NOT NULL AND {nonblank('text')})"
CLU = CLU_IN + "," + tfidf_ctes("clu", "clu_in", None, 0.7) + """,
clu_edges AS (SELECT id1 AS a, id2 AS b FROM clu_pairs UNION ALL SELECT id2, id1 FROM clu_pairs),
reach(node, comp) AS (SELECT a, a FROM clu_edges
                      UNION SELECT e.b, r.comp FROM reach r JOIN clu_edges e ON e.a = r.node),
comp AS (SELECT node, min(comp) AS comp FROM reach GROUP BY node),
lab AS (SELECT comp, dense_rank() OVER (ORDER BY comp) - 1 AS cluster
        FROM (SELECT DISTINCT comp FROM comp)),
clustered AS (SELECT c.*, coalesce(l.cluster, -1) AS cluster FROM clu_in c
              LEFT JOIN comp m ON m.node = c.post_id LEFT JOIN lab l ON l.comp = m.comp)"""

oracle("neighbor_graph", with_posts(
    "SELECT c.post_id, count(e.b) AS neighbors FROM clu_in c LEFT JOIN clu_edges e "
    "ON e.a = c.post_id GROUP BY c.post_id", CLU, recursive=True))
oracle("cluster_posts", with_posts("SELECT post_id, cluster FROM clustered", CLU,
                                   recursive=True))
oracle("cluster_sizes", with_posts(
    "SELECT cluster, count(*) AS posts FROM clustered GROUP BY cluster", CLU, recursive=True))
oracle("cluster_summary", with_posts(
    "SELECT b.cluster, b.num_posts, b.num_influencers, e.example_influencers, "
    "coalesce(p.platforms, '') AS platforms FROM "
    "(SELECT cluster, count(*) AS num_posts, count(DISTINCT Influencer) AS num_influencers "
    " FROM clustered WHERE cluster <> -1 GROUP BY cluster) b "
    f"JOIN ({first_k_sql('(SELECT * FROM clustered WHERE cluster <> -1)', 'cluster', 'Influencer', 'post_id', 3, 'example_influencers')}) e "
    "ON e.cluster = b.cluster LEFT JOIN (SELECT cluster, array_to_string(list_sort(list_distinct("
    "list(Platform))), ', ') AS platforms FROM clustered WHERE cluster <> -1 AND Platform IS NOT NULL "
    "GROUP BY cluster) p ON p.cluster = b.cluster", CLU, recursive=True))
oracle("cluster_members", with_posts(
    'SELECT post_id, Influencer, Platform, text, "Timestamp", cluster FROM clustered', CLU,
    recursive=True))

# ---- G: account network ---------------------------------------------------------------------


def _net(subset: str) -> str:
    return CLU + f""",
top AS (SELECT cluster, count(*) AS posts FROM clustered WHERE cluster <> -1 GROUP BY cluster
        ORDER BY posts DESC, cluster LIMIT {C.N_CLUSTERS}),
before AS (SELECT * FROM clustered WHERE Influencer IN
             (SELECT DISTINCT Influencer FROM clustered WHERE cluster IN (SELECT cluster FROM top))
           OR NOT EXISTS (SELECT 1 FROM top)),
subset AS ({subset}),
ca AS (SELECT cluster, Influencer, count(*) AS n FROM subset
       WHERE cluster <> -1 AND Influencer IS NOT NULL AND cluster IN
         (SELECT cluster FROM subset WHERE cluster <> -1 GROUP BY cluster HAVING count(*) >= 2)
       GROUP BY cluster, Influencer),
nb AS (SELECT Influencer, count(*) AS posts, arg_max(cluster, post_id) AS cluster FROM subset
       WHERE Influencer IS NOT NULL GROUP BY Influencer),
np AS (SELECT Influencer, Platform FROM (SELECT Influencer, Platform, count(*) AS c FROM subset
       WHERE Platform IS NOT NULL GROUP BY Influencer, Platform)
       QUALIFY row_number() OVER (PARTITION BY Influencer ORDER BY c DESC, Platform) = 1),
nodes AS (SELECT nb.Influencer AS influencer, coalesce(np.Platform, 'Unknown') AS platform,
            nb.cluster, nb.posts,
            round(CASE WHEN max(nb.posts) OVER () = min(nb.posts) OVER () THEN 17.5
                  ELSE 10 + 15.0 * (nb.posts - min(nb.posts) OVER ())
                       / (max(nb.posts) OVER () - min(nb.posts) OVER ()) END, 6) AS node_size,
            dense_rank() OVER (ORDER BY nb.cluster) - 1 AS color_index
          FROM nb LEFT JOIN np ON np.Influencer = nb.Influencer)"""

NET = _net(f"""SELECT * FROM before WHERE Influencer IN
             (SELECT Influencer FROM before GROUP BY Influencer
              ORDER BY count(*) DESC, Influencer LIMIT {C.MAX_ACCOUNTS})""")
ALL_NET = _net("SELECT * FROM clustered")

oracle("top_clusters", with_posts("SELECT * FROM top", NET, recursive=True))
oracle("posts_of_top_clusters", with_posts("SELECT post_id, Influencer, cluster FROM before", NET,
                                           recursive=True))
oracle("top_active_subset", with_posts("SELECT post_id, Influencer, cluster FROM subset", NET,
                                       recursive=True))
oracle("co_cluster_edges", with_posts(
    "SELECT a.Influencer AS src, b.Influencer AS dst, count(*) AS weight FROM ca a JOIN ca b "
    "ON a.cluster = b.cluster AND a.Influencer < b.Influencer GROUP BY 1, 2", NET, recursive=True))
oracle("co_cluster_edges_by_post", with_posts(
    "SELECT src, dst, CAST(weight AS BIGINT) AS weight FROM (SELECT a.Influencer AS src, b.Influencer AS dst, "
    "sum(CASE WHEN a.Influencer = b.Influencer THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END) "
    "AS weight FROM ca a JOIN ca b ON a.cluster = b.cluster AND a.Influencer <= b.Influencer "
    "GROUP BY 1, 2) WHERE weight > 0", NET, recursive=True))
oracle("graph_nodes", with_posts("SELECT * FROM nodes", ALL_NET, recursive=True))
oracle("account_clusters", with_posts(
    "SELECT cluster, Influencer AS influencer, n AS posts, "
    "count(*) OVER (PARTITION BY cluster) - 1 AS co_accounts FROM ca", ALL_NET, recursive=True))
ACCOUNT_CLASSES = ALL_NET + """,
acct AS (SELECT Influencer, list_sort(list(struct_pack(cluster := cluster, n := n))) AS s
         FROM ca GROUP BY Influencer),
cls AS (SELECT s, min(Influencer) AS ex, count(*) AS m, len(s) AS k FROM acct GROUP BY s),
cls_ca AS (SELECT ex, unnest(s).cluster AS cluster, unnest(s).n AS n FROM cls)"""
oracle("account_classes", with_posts(
    "SELECT Influencer AS influencer, ex AS example, k AS clusters FROM acct JOIN cls USING (s)",
    ACCOUNT_CLASSES, recursive=True))
oracle("shared_cluster_pairs", with_posts(f"""
SELECT x.account1, x.account2, a.m AS accounts1, b.m AS accounts2, weight, post_pairs,
       a.m * b.m AS account_pairs
FROM (SELECT p.ex AS account1, q.ex AS account2, count(*) AS weight,
             CAST(sum(p.n * q.n) AS BIGINT) AS post_pairs
      FROM cls_ca p JOIN cls_ca q ON p.cluster = q.cluster AND p.ex < q.ex GROUP BY 1, 2) x
JOIN cls a ON a.ex = account1 JOIN cls b ON b.ex = account2
WHERE weight >= {C.MIN_SHARED_CLUSTERS}
UNION ALL
SELECT ex, ex, m, m, k, (SELECT CAST(sum(n * n) AS BIGINT) FROM cls_ca c WHERE c.ex = cls.ex),
       m * (m - 1) // 2 FROM cls WHERE m >= 2 AND k >= {C.MIN_SHARED_CLUSTERS}""",
    ACCOUNT_CLASSES, recursive=True))
oracle("graph_coverage", with_posts(
    "SELECT (SELECT count(*) FROM nodes) AS nodes_shown, "
    "(SELECT count(DISTINCT Influencer) FROM clustered) AS total_influencers", NET, recursive=True))

# ---- H: embeddings --------------------------------------------------------------------------
from murmuration.plans.sqlparts import tokens as tok_sql  # noqa: E402

EMB = f"""etok AS (SELECT post_id, unnest({tok_sql('original_text')}) AS t FROM posts),
ecnt AS (SELECT post_id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {C.EMBED_DIM} AS dim,
         count(*) AS n FROM etok GROUP BY 1, 2)"""
oracle("embed_text", with_posts(
    "SELECT post_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY post_id)), 6) AS value "
    "FROM ecnt", EMB))
oracle("normalize_vectors", """
SELECT vec_id, dim, value FROM (
  SELECT vec_id, i - 1 AS dim,
         round(CAST(embedding[i] AS DOUBLE) / sqrt(list_sum(list_transform(embedding,
               lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS value
  FROM embeddings, range(1, len(embedding) + 1) r(i)) WHERE value <> 0""")
oracle("vector_cosine", """
SELECT a.vec_id AS vec_id1, b.vec_id AS vec_id2,
       round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
             lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
             / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
                * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6)
       AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")

oracle("semantic_search", f"""
WITH u AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / n) AS v FROM (
    SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding,
      lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings) WHERE n > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.v, c.v), 9) AS score
  FROM u q JOIN u c ON q.vec_id % {C.SEARCH_EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored) WHERE rank <= {C.SEARCH_K}""")
oracle("semantic_search_posts", with_posts(f"""
SELECT query_id, rank, post_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, post_id) AS rank FROM (
    SELECT q.post_id AS query_id, c.post_id, round(coalesce(sum(x.value * y.value), 0), 9) AS score
    FROM (SELECT DISTINCT post_id FROM ecnt WHERE post_id % {C.SEARCH_EVERY} = 0) q
    JOIN (SELECT DISTINCT post_id FROM ecnt) c ON c.post_id <> q.post_id
    JOIN unit x ON x.post_id = q.post_id
    LEFT JOIN unit y ON y.post_id = c.post_id AND y.dim = x.dim
    GROUP BY ALL)) WHERE rank <= {C.SEARCH_K}""", EMB + """,
unit AS (SELECT post_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY post_id)) AS value FROM ecnt)"""))

# ---- I: README signals ----------------------------------------------------------------------
from murmuration.plans.sqlparts import stop_words_list  # noqa: E402
from murmuration.sources.fixtures import EVENT_POSTS_SQL  # noqa: E402


def with_event_posts(body: str) -> str:
    return with_posts(body, raw=EVENT_POSTS_SQL)


oracle("top_shared_urls", with_event_posts(
    "SELECT URL, count(*) AS posts, count(DISTINCT Influencer) AS accounts FROM posts "
    "WHERE URL IS NOT NULL GROUP BY URL ORDER BY posts DESC, URL LIMIT 10"))
oracle("posting_spikes", with_event_posts("""
SELECT day, posts, round(m, 6) AS baseline_mean, round(s, 6) AS baseline_std,
       coalesce(h >= 3 AND posts > m + 2 * s, false) AS is_spike
FROM (SELECT day, posts,
        avg(posts) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m,
        stddev_pop(posts) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s,
        count(posts) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS h
      FROM (SELECT CAST(d.day AS DATE) AS day, coalesce(c.posts, 0) AS posts FROM
        (SELECT unnest(generate_series(date_trunc('day', min("Timestamp")),
                date_trunc('day', max("Timestamp")), INTERVAL 1 DAY)) AS day FROM posts) d
        LEFT JOIN (SELECT date_trunc('day', "Timestamp") AS day, count(*) AS posts FROM posts
                   GROUP BY 1) c ON c.day = d.day))"""))
oracle("repeated_url_sharing", with_event_posts(
    'SELECT Influencer, URL, count(*) AS posts, min("Timestamp") AS first_time, '
    'max("Timestamp") AS last_time FROM posts WHERE URL IS NOT NULL GROUP BY Influencer, URL '
    "HAVING count(*) >= 2"))
oracle("platform_spikes", with_event_posts("""
SELECT Platform, day, posts, round(m, 6) AS baseline_mean, round(s, 6) AS baseline_std,
       coalesce(h >= 3 AND posts > m + 2 * s, false) AS is_spike
FROM (SELECT Platform, day, posts, avg(posts) OVER w AS m, stddev_pop(posts) OVER w AS s,
             count(posts) OVER w AS h
      FROM (SELECT d.Platform, CAST(d.day AS DATE) AS day, coalesce(c.posts, 0) AS posts FROM
        (SELECT Platform, unnest(generate_series(date_trunc('day', min("Timestamp")),
                date_trunc('day', max("Timestamp")), INTERVAL 1 DAY)) AS day FROM posts
         WHERE Platform IS NOT NULL GROUP BY Platform) d
        LEFT JOIN (SELECT Platform, date_trunc('day', "Timestamp") AS day, count(*) AS posts
                   FROM posts GROUP BY 1, 2) c ON c.day = d.day AND c.Platform = d.Platform)
      WINDOW w AS (PARTITION BY Platform ORDER BY day
                   ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"""))
oracle("repeated_text_sharing", with_event_posts(
    "SELECT Influencer, original_text AS text, count(*) AS posts, "
    'min("Timestamp") AS first_time, max("Timestamp") AS last_time FROM posts '
    "WHERE trim(original_text) <> '' GROUP BY Influencer, original_text HAVING count(*) >= 2"))
oracle("rapid_co_sharing", with_event_posts(f"""
SELECT URL, CAST(burst AS BIGINT) AS burst, count(*) AS posts,
       count(DISTINCT Influencer) AS accounts, min("Timestamp") AS first_time,
       max("Timestamp") AS last_time
FROM (SELECT *, sum(starts) OVER (PARTITION BY URL ORDER BY "Timestamp", post_id
                                  ROWS UNBOUNDED PRECEDING) AS burst
      FROM (SELECT URL, Influencer, "Timestamp", post_id, CASE WHEN "Timestamp" - lag("Timestamp")
              OVER (PARTITION BY URL ORDER BY "Timestamp", post_id)
              <= INTERVAL {int(C.RAPID_WINDOW_HOURS * 3600)} SECOND THEN 0 ELSE 1 END AS starts
            FROM posts WHERE URL IS NOT NULL))
GROUP BY URL, burst HAVING count(DISTINCT Influencer) >= 2"""))


oracle("co_share_edges", with_event_posts(f"""
SELECT a.Influencer AS account1, b.Influencer AS account2, count(DISTINCT a.URL) AS urls
FROM posts a JOIN posts b ON a.URL = b.URL AND a.Influencer < b.Influencer
  AND abs(epoch_us(a."Timestamp") - epoch_us(b."Timestamp")) <= {int(C.RAPID_WINDOW_HOURS * 3.6e9)}
GROUP BY 1, 2 HAVING count(DISTINCT a.URL) >= {C.MIN_CO_SHARED_URLS}"""))


def _classes_sql(sets: str) -> str:
    """CTEs: ``sets`` (account, item), ``acct`` with each account's set, ``g`` one row a set."""
    return f"""
sets AS ({sets}),
acct AS (SELECT account, list_sort(list(item)) AS s FROM sets GROUP BY account),
g AS (SELECT s, min(account) AS ex, count(*) AS n, len(s) AS items FROM acct GROUP BY s)"""


def _overlap_sql(sets: str, t: float) -> tuple[str, str]:
    return f"""
SELECT a.ex AS example1, b.ex AS example2, a.items AS items1, b.items AS items2,
       a.n AS accounts1, b.n AS accounts2, shared,
       round(shared / (a.items + b.items - shared), 6) AS jaccard, a.n * b.n AS account_pairs
FROM (SELECT a.ex AS x1, b.ex AS x2, count(*) AS shared FROM gi a JOIN gi b
      ON a.item = b.item AND a.ex < b.ex GROUP BY 1, 2)
JOIN g a ON a.ex = x1 JOIN g b ON b.ex = x2
WHERE shared / (a.items + b.items - shared) >= {t}
UNION ALL
SELECT ex, ex, items, items, n, n, items, 1.0, n * (n - 1) // 2 FROM g WHERE n >= 2""", \
        _classes_sql(sets) + ", gi AS (SELECT ex, unnest(s) AS item FROM g)"


def _members_sql(sets: str) -> tuple[str, str]:
    return ("SELECT account, ex AS example, items FROM acct JOIN g USING (s)", _classes_sql(sets))


HASHTAG_SETS = f"SELECT DISTINCT Influencer AS account, unnest({hashtags('text')}) AS item FROM posts"
CONTENT_SETS = (
    f"SELECT DISTINCT account, item FROM (SELECT Influencer AS account, "
    f"unnest({tok_sql('original_text')}) AS item FROM posts) "
    f"WHERE NOT list_contains({stop_words_list()}, item)")
oracle("hashtag_overlap", with_posts(*_overlap_sql(HASHTAG_SETS, C.HASHTAG_JACCARD)))
oracle("hashtag_members", with_posts(*_members_sql(HASHTAG_SETS)))
oracle("content_overlap", with_posts(*_overlap_sql(CONTENT_SETS, C.CONTENT_JACCARD)))
oracle("content_members", with_posts(*_members_sql(CONTENT_SETS)))
# Handles and retweet markers of the raw text, written without the operators' patterns.
HANDLE = "[[:word:]\\p{L}\\p{N}]+"
oracle("mention_edges", with_event_posts(
    "SELECT src, dst, count(*) AS posts FROM (SELECT post_id, lower(Influencer) AS src, "
    f"unnest(list_distinct(list_transform(regexp_extract_all(text_raw, '@({HANDLE})', 1), "
    "lambda h: lower(h)))) AS dst FROM posts) GROUP BY src, dst"))
oracle("retweet_edges", with_event_posts(
    "SELECT src, dst, count(*) AS posts FROM (SELECT lower(Influencer) AS src, "
    f"lower(regexp_extract(text_raw, '^[Rr][Tt] @({HANDLE})', 1)) AS dst FROM posts) "
    "WHERE dst <> '' GROUP BY src, dst"))
oracle("account_cadence", with_event_posts("""
SELECT Influencer, count(*) AS posts, count(DISTINCT CAST("Timestamp" AS DATE)) AS active_days,
       round(count(*) / count(DISTINCT CAST("Timestamp" AS DATE)), 6) AS posts_per_day,
       round(min(gap), 3) AS min_gap_s, round(avg(gap), 3) AS mean_gap_s,
       round(median(gap), 3) AS median_gap_s,
       round(1 - count(DISTINCT original_text) / count(*), 6) AS dup_text_share
FROM (SELECT *, date_diff('microsecond',
        lag("Timestamp") OVER (PARTITION BY Influencer ORDER BY "Timestamp", post_id),
        "Timestamp") / 1e6 AS gap FROM posts)
GROUP BY Influencer"""))
