"""Merkle manifest of a table: per row its leaf digest, its group's subroot, the root and a proof.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests enter as hex text. A leaf is H
of a row's fields, each ``-`` if null, else ``<UTF-8 bytes>:<value>``. Inside a group the leaves
ascend by id; while several nodes remain, every ``ARITY`` consecutive ones become their H (a last
run may be shorter, also a single node). Groups' subroots, in the order of the group values, make
a tree of the same kind, whose top is the root.

A row's rank in its group is written in base ``ARITY``. Rows are dealt once by (group, block), a
block being the rows that agree in all but the last ``DIGITS`` digits; inside a block the digit
columns are grouped away one after the other, each grouping nesting the structs below it, without
another exchange. A block's nested struct holds its tree of at most ARITY ** DIGITS rows; blocks'
digests are the rows of the next tree, and so on until a group has one block. Proofs are written
on the way back: each block gets the path above it by one more grouping, and transforms and
explodes carry it down the nested structs, adding the siblings of each level. No table is joined
with another for it, no task holds more than a few blocks, and a group may hold any number of
rows.

Order and ties: null groups and null ids come first; rows with equal ids ascend by leaf digest;
rows equal in all fields have equal digests, so their order does not show. An empty table gives no
rows. Null and empty texts differ (``-`` and ``0:``); a text of any length is one digest of 64
characters after the first step. Columns other than the named fields do not take part, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmuration.llm.common import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
DIGITS = 3        # a block: at most 8 ** 3 rows


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """The leaf digest of a row of values."""
    return digest(*[field(v) for v in values])


def fold(start: Column, path: Column) -> Column:
    """The top digest that ``start`` leads to with the siblings of ``path``."""
    return F.aggregate(path, start, lambda h, p: digest(p["left"], h, p["right"]))


def siblings_digest(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def _ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``_rank`` of each row in its group (from 0) and ``_n``, the group's rows. Rows are
    range-partitioned, so a group may span many tasks."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [group, *order]
    placed = written(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                     .withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    pieces = (placed.groupBy(F.col(group).alias("_g"), part.alias("_p"))
              .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_m")))
    # one row per group and partition it spans
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_g", "_p", F.sum("_m").over(whole).alias("_n"),
                           (F.coalesce(F.sum("_m").over(before), F.lit(0)) - F.col("_first"))
                           .alias("_shift"))
    return (placed.join(pieces, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_p")))
            .withColumn("_rank", F.col("_at") + F.col("_shift"))
            .drop("_g", "_p", "_at", "_shift"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of ``(_group, _n, _rank, digest, data)`` nodes: ``(_group, _n, _block, digest,
    kids)``, kids nested ``DIGITS`` deep as ``(at, digest, kids)``, at the bottom with ``data``."""
    digits = [f"_d{k}" for k in range(DIGITS)]
    bits = ARITY_BITS * DIGITS
    cur = nodes.select(
        "_group", "_n", F.shiftright("_rank", bits).alias("_block"),
        *[F.shiftright("_rank", ARITY_BITS * k).bitwiseAND(ARITY - 1).cast("int").alias(d)
          for k, d in enumerate(digits)], "digest", F.col("data").alias("kids"))
    cur = cur.repartition("_group", "_block")
    for k, d in enumerate(digits):
        above = ["_group", "_n", "_block", *digits[k + 1:]]
        node = F.struct(F.col(d).alias("at"), "digest", "kids")
        cur = cur.groupBy(*above).agg(F.sort_array(F.collect_list(node)).alias("kids"))
        joined = digest(F.array_join(F.col("kids")["digest"], ""))
        cur = cur.withColumn("digest", F.when(F.col("_n") > ARITY ** k, joined)
                             .otherwise(F.col("kids")[0]["digest"]))
    return cur


def _child(k: int) -> Callable[[Column, Column], Column]:
    """A child of level ``k``, with its own step put before the path of its parent."""
    kids = F.col("kids")

    def text(nodes: Column) -> Column:
        return F.array_join(F.transform(nodes, lambda y: y["digest"]), "")

    def child(x: Column, i: Column) -> Column:
        step = F.struct(text(F.slice(kids, F.lit(1), i)).alias("left"),
                        text(F.slice(kids, i + 2, F.lit(ARITY))).alias("right"))
        return F.struct(x["at"].alias("at"), x["kids"].alias("kids"),
                        F.when(F.col("_n") > ARITY ** k, F.concat(F.array(step), F.col("path")))
                        .otherwise(F.col("path")).alias("path"))

    return child


def _emit(blocks: DataFrame) -> DataFrame:
    """Rows ``(_group, _rank, data, path, top)`` of blocks that know the ``path`` above them."""
    cur = blocks.withColumn("_rank", F.col("_block"))
    for k in reversed(range(DIGITS)):
        cur = (cur.withColumn("_kid", F.explode(F.transform("kids", _child(k))))
               .select("_group", "_n", "top",
                       (F.shiftleft("_rank", ARITY_BITS) + F.col("_kid.at")).alias("_rank"),
                       F.col("_kid.kids").alias("kids"), F.col("_kid.path").alias("path")))
    return cur.select("_group", "_rank", F.col("kids").alias("data"), "path", "top")


PATH_TYPE = "array<struct<left:string,right:string>>"


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The block tables from ``(_group, _n, _rank, digest, data)`` nodes up: the digests of one
    are the nodes of the next; the last has one block per group."""
    rounds, size = [], ARITY ** DIGITS
    while True:
        blocks = written(_blocks(nodes))
        rounds.append(blocks)
        if (blocks.agg(F.max("_n")).first()[0] or 0) <= size:
            return rounds
        nodes = blocks.select("_group", F.ceil(F.col("_n") / size).cast("long").alias("_n"),
                              F.col("_block").alias("_rank"), "digest", F.lit(0).alias("data"))


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``(_group, _rank, data, path, top)`` of the lowest nodes, given the ``path`` and ``top`` of
    the last table's blocks. Blocks meet the paths above them by one grouping of both."""
    for k, blocks in reversed(list(enumerate(rounds))):
        both = blocks.drop("digest").unionByName(above, allowMissingColumns=True)
        known = both.groupBy("_group", "_block").agg(
            *[F.first(c, ignorenulls=True).alias(c) for c in ("_n", "kids", "path", "top")])
        nodes = _emit(known)
        above = nodes.select("_group", F.col("_rank").alias("_block"), "path", "top")
    return nodes


def _all_groups(subroots: DataFrame) -> DataFrame:
    """``(_group, path, top)``: each group's path to the root, and its subroot and the root."""
    nodes = _ranked(subroots.select(F.lit(0).alias("_group"), F.col("_group").alias("_value"),
                                    "digest"), "_group", ["_value"])
    rounds = _climb(nodes.select("_group", "_n", "_rank", "digest",
                                 F.struct("_value", "digest").alias("data")))
    over = _descend(rounds, rounds[-1].select(
        "_group", "_block", F.array().cast(PATH_TYPE).alias("path"), F.col("digest").alias("top")))
    return over.select(F.col("data._value").alias("_group"), "path",
                       F.struct(F.col("data.digest").alias("subroot"), F.col("top").alias("root"))
                       .alias("top"))


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id",
             group_col: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, leaf, subroot, root and proof (from the leaf up, per
    level the siblings to the ``left`` and ``right`` as hex text), plus the ``carry`` columns,
    which are computed from the row."""
    extra = list((carry or {}).items())
    rows = written(docs.select(
        F.col(group_col).alias("_group"), F.col(id_col).alias("_id"),
        leaf([F.col(c) for c in fields]).alias("digest"),
        F.struct(F.lit(0), *[c.alias(f"c{k}") for k, (_, c) in enumerate(extra)]).alias("_more")))
    # rows equal in id and leaf, however many, can still be dealt to several tasks
    ranked = _ranked(rows.withColumn("_row", F.monotonically_increasing_id()), "_group",
                     ["_id", "digest", "_row"])
    rounds = _climb(ranked.select("_group", "_n", "_rank", "digest",
                                  F.struct("_id", "digest", "_more").alias("data")))
    over = _all_groups(rounds[-1].select("_group", "digest"))
    nodes = _descend(rounds, over.withColumn("_block", F.lit(0).cast("long")))
    return nodes.select(
        F.col("data._id").alias(id_col), F.col("data.digest").alias("leaf"),
        F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"),
        F.col("path").alias("proof"),
        *[F.col(f"data._more.c{k}").alias(name) for k, (name, _) in enumerate(extra)])


def verified(start: Column, proof: Column, root: Column) -> Column:
    """Whether a leaf digest leads to the root by its proof."""
    return fold(start, proof) == root


def oracle() -> str:
    """DuckDB SQL for ``op13_merkle``. The crc32 of the decimal id is computed bit by bit."""
    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END"

    def row(text: str) -> str:
        cols = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(enc(f"({c})") for c in cols) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ("xor(4294967295, list_reduce([ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],"
           " lambda c, b: list_reduce(range(8), lambda v, i:"
           " xor(v >> 1, (v & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT))")
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {row('text')} AS leaf,
         CASE WHEN {crc} % 3 = 0 THEN {row(lowered)} ELSE {row('text')} END AS claimed
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(lvl, lang, r, n, digest) AS (
  SELECT 0, lang, r, n, leaf FROM ranked
  UNION ALL
  SELECT lvl + 1, lang, r // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY r))
  FROM nodes WHERE n > 1 GROUP BY lvl, lang, r // 8, n),
subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r,
         count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lvl, r, n, digest) AS (
  SELECT 0, r, n, digest FROM subroots
  UNION ALL
  SELECT lvl + 1, r // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY r))
  FROM tops WHERE n > 1 GROUP BY lvl, r // 8, n),
sides AS (
  SELECT lvl, lang, r, n,
    coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, lang, n, r // 8 ORDER BY r
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, lang, n, r // 8 ORDER BY r
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT lvl, 'g' || coalesce('=' || lang, '') AS lang, r, n, digest FROM nodes
        UNION ALL SELECT lvl, 'r', r, n, digest FROM tops)),
climb(doc_id, lang, leaf, tree, lvl, r, n, h, proof) AS (
  SELECT doc_id, lang, leaf, 'g' || coalesce('=' || lang, ''), 0, r, n, claimed, '' FROM ranked
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf,
         CASE WHEN c.n > 1 THEN c.tree ELSE 'r' END,
         CASE WHEN c.n > 1 THEN c.lvl + 1 ELSE 0 END,
         CASE WHEN c.n > 1 THEN c.r // 8 ELSE s.r END,
         CASE WHEN c.n > 1 THEN (c.n + 7) // 8 ELSE s.n END,
         CASE WHEN c.n > 1 THEN sha256(d.before || c.h || d.after) ELSE c.h END,
         CASE WHEN c.n > 1 THEN c.proof || d.before || d.after ELSE c.proof END
  FROM climb c JOIN sides d ON d.lang = c.tree AND d.lvl = c.lvl AND d.r = c.r
  LEFT JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang
  WHERE c.n > 1 OR c.tree <> 'r')
SELECT c.doc_id, c.leaf, s.digest AS subroot, t.digest AS root,
       sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.digest AS verified
FROM climb c JOIN tops t ON t.n = 1 JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang
WHERE c.tree = 'r' AND c.n = 1"""
