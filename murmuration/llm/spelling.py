"""Spelling variant groups: words one edit apart, each led to its most frequent neighbour.

Words are runs of letters of whole texts, lower-cased (A-Z only) and counted over the corpus;
each task counts its own rows first, so a frequent word crosses the network once a task. Two words
are near if one inserted, deleted or replaced code point makes them equal. A replaced letter moves
one unit between two letter counts and an inserted one adds a unit, so near words' letter-count
vectors have a squared distance of two (equal lengths) or one (lengths one apart).

Blocked Gram matrices find them. The letters are dealt into a few groups of about equal use, and
a word's *cell* is its number of letters in each group: near words lie in one cell, in cells of
equal length that differ by one unit moved, or in cells of adjacent lengths that differ by one
unit. Cells are cut into blocks of about ``BLOCK`` words; each block meets the blocks of its
neighbouring cells, each pair of cells from one side only. A block pair is one NumPy product of
letter-count matrices: |x|^2 + |y|^2 - 2 x.y gives all squared distances, pairs above two are
dropped, and the remaining ones are verified by comparing code points, also in NumPy. The number
of letter groups follows the vocabulary, so that cells stay near the size of a block; it changes
no result.

A word's form is its near word of largest count if that is at least ``factor`` times its own count
(ties: the smallest in code-point order); its root is where the forms lead. Counts grow by
``factor`` a step, so chains are short and pointer doubling ends after a bounded number of rounds.

Null texts hold no words; a null id counts as the empty text. Texts of any length are read whole
(the runs of one text are held in memory at a time). Repeated rows count again. An empty table
gives no rows. Columns other than the two named do not take part, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import written

TYPO_EVERY = 199
MIN_LETTERS = 6
MIN_COUNT = 5
FACTOR = 5
BLOCK = 512
HELD_WORDS = 200_000      # distinct words a task counts before it hands them on
# One letter in UTF-8 after ASCII lower-casing: a-z or U+00C0 to U+00FF.
LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_letters: int = MIN_LETTERS, typo_every: int | None = TYPO_EVERY) -> DataFrame:
    """``(word, n)`` of all words of ``min_letters`` or more. Where ``typo_every`` divides the
    crc32 of ``<id>:<word>``, the word loses the letter at crc32 % length."""
    runs = re.compile(LETTER + rb"{%d,}" % min_letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()).cast(pa.string()),
                 pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                     strict=True):
                    seed = zlib.crc32(f"{key}:".encode())
                    for word, n in Counter(runs.findall(text.encode().lower())).items():
                        h = zlib.crc32(word, seed)
                        if typo_every and h % typo_every == 0:
                            letters = word.decode()
                            at = h % len(letters)
                            word = (letters[:at] + letters[at + 1:]).encode()
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield handed()
        yield handed()

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.where(F.col(text_col).isNotNull()).select(key.alias("k"),
                                                          F.col(text_col).alias("t"))
    counted = rows.mapInArrow(run, "word string, n long")
    return (counted.where(F.length("word") >= min_letters)
            .groupBy("word").agg(F.sum("n").alias("n")))


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The letters in use, dealt into ``groups`` strings of about equal use. The letters are those
    of a fixed class, so the driver gets a short list."""
    used = (words.select(F.explode(F.split("word", "")).alias("c")).where(F.col("c") != "")
            .groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect())
    out, load = [""] * groups, [0] * groups
    for r in sorted(used, key=lambda r: (-r["n"], r["c"])):
        k = load.index(min(load))
        out[k] += r["c"]
        load[k] += r["n"]
    return out


def group_count(words: int, letters: float, block: int = BLOCK) -> int:
    """Letter groups that give cells of about a block: C(letters + g - 1, g - 1) cells a length."""
    length = max(2, round(letters))
    g = 2
    while g < 12 and 4 * math.comb(length + g - 1, g - 1) * block < words:
        g += 1
    return g


def _moved(cell: Column, down: int, up: int | None = None) -> Column:
    """The cell with a unit less in group ``down`` and one more in ``up``."""
    out = F.transform(cell, lambda x, k: F.when(k == down, x - 1).otherwise(x))
    if up is None:
        return out
    return F.transform(out, lambda x, k: F.when(k == up, x + 1).otherwise(x))


def word_blocks(words: DataFrame, groups: list[str], block: int = BLOCK) -> DataFrame:
    """``(cell, part, words, ns)``: the words of each cell in blocks of about ``block``."""
    whole = F.length("word")
    cell = F.array(*[(whole - F.length(F.translate("word", g, ""))).cast("int") for g in groups])
    celled = words.select("word", "n", cell.alias("cell"))
    parts = (celled.groupBy("cell").agg(F.count(F.lit(1)).alias("_m"))
             .select("cell", F.ceil(F.col("_m") / block).alias("_parts")))
    return (celled.join(parts, "cell")
            .withColumn("part", F.pmod(F.xxhash64("word"), F.col("_parts")).cast("int"))
            .groupBy("cell", "part")
            .agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("rows"))
            .select("cell", "part", F.col("rows.word").alias("words"), F.col("rows.n").alias("ns")))


def _codes(words: pa.Array) -> np.ndarray:
    """Words of one length as rows of code points."""
    names = words.to_pylist()
    return np.array(names, dtype=f"U{len(names[0])}").view("<u4").reshape(len(names), -1)


def _letter_counts(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    counts = np.zeros((len(codes), len(letters)), dtype=np.float32)
    rows = np.arange(len(codes))
    for column in np.searchsorted(letters, codes).T:
        counts[rows, column] += 1
    return counts


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of code points ``a`` become those of ``b`` by one replaced or deleted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = b.shape[1]
    head = np.logical_and.accumulate(a[:, :n] == b, axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def near_in_blocks(a: pa.Array, b: pa.Array, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the near words of two blocks (``same``: of one block with itself); words of
    ``a`` are as long as those of ``b`` or one letter longer."""
    left, right = _codes(a), _codes(b)
    letters = np.unique(np.concatenate([left.ravel(), right.ravel()]))
    x, y = _letter_counts(left, letters), _letter_counts(right, letters)
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero(square < 2.5)       # exact: small whole numbers in float32
    if same:
        i, j = i[i < j], j[i < j]
    kept = one_edit(left[i], right[j])
    return i[kept], j[kept]


def near_pairs(words: DataFrame, block: int = BLOCK, groups: int | None = None) -> DataFrame:
    """``(word, n, near, near_n)`` both ways for every two near words of ``(word, n)``; ``words``
    is read several times and should be a written table."""
    if groups is None:
        size = words.agg(F.count(F.lit(1)), F.avg(F.length("word"))).first()
        groups = group_count(size[0], size[1] or 2.0, block)
    blocks = written(word_blocks(words, letter_groups(words, groups), block))
    cell = F.col("cell")
    meets = [cell, *[_moved(cell, k) for k in range(groups)],
             *[_moved(cell, k, m) for k in range(groups) for m in range(k + 1, groups)]]
    sends = blocks.select(F.explode(F.array(*meets)).alias("to"), cell.alias("own"),
                          F.col("part").alias("p"), F.col("words").alias("a"),
                          F.col("ns").alias("a_n"))
    same = F.col("own") == cell
    pairs = (sends.join(blocks, F.col("to") == cell)
             .where(~same | (F.col("p") <= F.col("part")))
             .select("a", "a_n", F.col("words").alias("b"), F.col("ns").alias("b_n"),
                     (same & (F.col("p") == F.col("part"))).alias("same")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, a_n, b, b_n, itself in zip(*batch.columns, strict=True):
                i, j = near_in_blocks(a.values, b.values, itself.as_py())
                if not len(i):
                    continue
                i, j = pa.array(i), pa.array(j)
                x, y = a.values.take(i), b.values.take(j)
                x_n, y_n = a_n.values.take(i), b_n.values.take(j)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([x, y]), pa.concat_arrays([x_n, y_n]),
                     pa.concat_arrays([y, x]), pa.concat_arrays([y_n, x_n])],
                    names=["word", "n", "near", "near_n"])

    return pairs.mapInArrow(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """``(word, root)`` for ``(word, form)`` rows whose chains are below 2 ** ``rounds`` long."""
    at = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        on = at.select(F.col("word").alias("_w"), F.col("root").alias("_further"))
        at = written(at.join(on, F.col("root") == F.col("_w"), "left")
                     .select("word", F.coalesce("_further", "root").alias("root")))
    return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             min_count: int = MIN_COUNT, factor: int = FACTOR,
             min_letters: int = MIN_LETTERS, typo_every: int | None = TYPO_EVERY) -> DataFrame:
    """One row per word of at least ``min_count``: word, n, n_near, form, form_n, root."""
    words = written(count_words(docs, id_col, text_col, min_letters, typo_every)
                    .where(F.col("n") >= min_count))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    near = (near_pairs(words).groupBy("word")
            .agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("n_near"), best.alias("best")))
    strong = -F.col("best.n") >= factor * F.col("n")
    near = written(near.select("word", "n_near", F.when(strong, F.col("best.word")).alias("form"),
                               F.when(strong, -F.col("best.n")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(most, factor)))      # the longest possible chain
    root = roots(near.where(F.col("form").isNotNull()), math.ceil(math.log2(steps + 1)))
    return (words.join(near, "word", "left").join(root, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    "form", "form_n", F.coalesce("root", "word").alias("root")))


def oracle() -> str:
    """DuckDB SQL for ``op11_spelling``: near words meet where one letter is left out. The crc32 is
    computed from its table, which is computed from its polynomial."""
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), b) AS v
    FROM range(256) r(b))),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(unnest(regexp_extract_all(text,
    '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM documents WHERE text IS NOT NULL),
per AS (SELECT k, w, count(*) AS c FROM runs WHERE length(w) >= {MIN_LETTERS} GROUP BY k, w),
coded AS (
  SELECT w, c, length(w) AS m, hex(encode(k || ':' || w)) AS x FROM per),
hashed AS (
  SELECT w, c, m, xor(4294967295, list_reduce(
    list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1]), 4294967295)) AS h
  FROM coded, crc),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT c, CASE WHEN h % {TYPO_EVERY} = 0 THEN substr(w, 1, h % m) || substr(w, h % m + 2)
                   ELSE w END AS word FROM hashed)
  WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
holes AS (
  SELECT word, k, substr(word, 1, k - 1) || substr(word, k + 1) AS hole
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other FROM holes a JOIN holes b
    ON a.hole = b.hole AND a.k = b.k AND a.word <> b.word
  UNION SELECT DISTINCT h.word, w.word FROM holes h JOIN words w ON w.word = h.hole
  UNION SELECT DISTINCT w.word, h.word FROM holes h JOIN words w ON w.word = h.hole),
best AS (
  SELECT near.word, any_value(w.n) AS n, count(*) AS n_near,
         arg_min(other, struct_pack(a := -o.n, b := other)) AS form, max(o.n) AS form_n
  FROM near JOIN words w ON w.word = near.word JOIN words o ON o.word = other GROUP BY near.word),
forms AS (SELECT word, form, form_n FROM best WHERE form_n >= {FACTOR} * n),
climb(word, root) AS (
  SELECT word, form FROM forms
  UNION ALL SELECT c.word, f.form FROM climb c JOIN forms f ON f.word = c.root)
SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, f.form, f.form_n,
       coalesce(r.root, w.word) AS root
FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN forms f ON f.word = w.word
LEFT JOIN (SELECT word, root FROM climb WHERE root NOT IN (SELECT word FROM forms)) r
  ON r.word = w.word"""
