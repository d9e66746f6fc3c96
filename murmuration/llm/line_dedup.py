"""Line dedup by pairwise alignment of overlapping documents.

Every minimal run of consecutive non-blank lines that reaches ``min_words`` words is hashed (128
bits), from each line on and from each line back; a line of that many words is a run by itself.
A run in two or more documents links each later one to the earliest document that holds it, so
a run of k documents gives k - 1 links however frequent it is: no list of all holders and no
pairs among them. The lines of all runs that link a later document to one earlier document are
then aligned by patience diff: lines unique in both, longest increasing run of them, the same
again between the anchors. Maximal runs of aligned lines that are consecutive in both documents
are blocks; a block of ``min_words`` or more words is evidence (rarer than chance words such as
a one-word line) and is deleted from the later document. Runs that the alignment leaves, moved
or repeated ones, go as well. Blank lines do not count: lines are consecutive if only blank ones lie between.

Each line of a block that a document shares with any earlier one lies in a minimal run of that
block, and the run's earliest holder is linked: the result is that of aligning all pairs.

Documents are ordered by id (nulls last), then by a hash of their text. Rows with equal id and
text are one document here: all are edited alike, and none is later than the other. Null text
stays null and has no lines; a text whose lines all go becomes empty. Blank lines stay.
Other columns are passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmuration.llm.common import boxed, word_count, written

MIN_WORDS = 5


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``pairs`` (ascending in the first) that also ascends in the second."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            ends.append(n)
        else:
            tops[k], ends[k] = y, n
    out = []
    n = ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def patience(x: list, y: list) -> list[tuple[int, int]]:
    """Aligned index pairs of two lists of lines."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        nx, ny = Counter(x[a:b]), Counter(y[c:d])
        at = {line: k for k, line in enumerate(y[c:d], c) if ny[line] == 1}
        anchors = _increasing([(k, at[line]) for k, line in enumerate(x[a:b], a)
                               if nx[line] == 1 and line in at])
        if anchors:
            i, j = a, c
            for p, q in anchors:
                out.append((p, q))
                stack.append((i, p, j, q))
                i, j = p + 1, q + 1
            stack.append((i, b, j, d))
        elif nx.keys() & ny.keys():       # only repeated lines: next occurrence, in order
            spots: dict = {}
            for k in range(c, d):
                spots.setdefault(y[k], []).append(k)
            j = c
            for k in range(a, b):
                where = spots.get(x[k], [])
                n = bisect_left(where, j)
                if n < len(where):
                    out.append((k, where[n]))
                    j = where[n] + 1
    return sorted(out)


def aligned_blocks(later: list[tuple[int, int, int]], earlier: list[tuple[int, int]],
                   min_words: int) -> list[int]:
    """Positions to delete. ``later``: (position, line, words), ``earlier``: (position, line).

    Blocks that the alignment leaves, since they moved or repeat, go by their shared runs.
    """
    later, earlier = sorted(later), sorted(earlier)
    return sorted({*_blocks(later, earlier, min_words),
                   *_shared_runs(later, earlier, min_words)})


def _shared_runs(later: list[tuple[int, int, int]], earlier: list[tuple[int, int]],
                 min_words: int) -> set[int]:
    """Positions in minimal runs (from a line on, or back from it) that ``earlier`` holds."""
    known: dict[int, set[tuple]] = {}

    def held(i: int, n: int) -> bool:
        if n not in known:
            known[n] = {tuple(x[1] for x in earlier[k:k + n])
                        for k in range(len(earlier) - n + 1)
                        if earlier[k + n - 1][0] - earlier[k][0] == n - 1}
        return tuple(x[1] for x in later[i:i + n]) in known[n]

    out: set[int] = set()
    for i in range(len(later)):
        for step in (1, -1):
            j, words = i, later[i][2]
            while words < min_words and 0 <= j + step < len(later) \
                    and later[j + step][0] == later[j][0] + step:
                j += step
                words += later[j][2]
            lo, hi = min(i, j), max(i, j)
            if words >= min_words and held(lo, hi - lo + 1):
                out.update(x[0] for x in later[lo:hi + 1])
    return out


def _blocks(later: list[tuple[int, int, int]], earlier: list[tuple[int, int]],
            min_words: int) -> list[int]:
    pairs = patience([x[1] for x in later], [x[1] for x in earlier])
    out: list[int] = []
    run: list[int] = []
    words, last = 0, None
    for i, j in [*pairs, (None, None)]:
        here = None if i is None else (later[i][0], earlier[j][0])
        if here is None or last is None or here != (last[0] + 1, last[1] + 1):
            if words >= min_words:
                out += run
            run, words = [], 0
        if here is not None:
            run.append(here[0])
            words += later[i][2]
        last = here
    return out


def _mask(links: list[dict], min_words: int) -> list[bool]:
    """Which lines of a later document go, from its links to earlier ones."""
    by_doc: dict[tuple, list[dict]] = {}
    for x in links:
        by_doc.setdefault(tuple(x["first"].values()), []).append(x)
    gone: set[int] = set()
    for group in by_doc.values():
        later: dict[int, tuple[int, int]] = {}
        earlier: dict[int, int] = {}
        raw: dict[int, int] = {}
        for x in group:
            for at in x["at"]:
                later.update(enumerate(zip(x["lines"], x["words"], strict=True), at["pos"]))
                raw.update(enumerate(at["raw"], at["pos"]))
            for q in x["base"]:
                earlier.update(enumerate(x["lines"], q))
        gone.update(raw[p] for p in aligned_blocks(
            [(p, *v) for p, v in later.items()], list(earlier.items()), min_words))
    mask = [False] * (max(gone, default=-1) + 1)
    for p in gone:
        mask[p] = True
    return mask


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _run_rows(batch: pa.RecordBatch, min_words: int) -> pa.RecordBatch:
    """A row per minimal run of consecutive lines: from each line on until ``min_words`` words,
    and from each line back, where that is another run. ``pos`` counts the non-blank lines,
    ``raw`` has each line's place among all."""
    lists = batch.column(1)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    raw, words, a, b = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
    n = len(raw)
    doc = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)[doc]
    begin = end - size[doc]
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])   # of the lines before
    i = np.arange(n)
    on = np.searchsorted(total, total[:-1] + min_words)
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    ahead = on <= end
    # a run back is new if it reaches min_words without its last line as well
    behind = (back >= begin) & (total[i] - total[np.maximum(back, 0)] >= min_words)
    start = np.concatenate([i[ahead], back[behind]])
    count = np.concatenate([(on - i)[ahead], (i + 1 - back)[behind]])
    h1, h2 = a[start].astype(np.uint64), b[start].astype(np.uint64)
    for k in range(1, int(count.max(initial=1))):
        more = count > k
        at = start[more] + k
        for h, line in ((h1, a), (h2, b)):
            x = (h[more] ^ (h[more] >> np.uint64(29))) * _MIX
            h[more] = (x ^ (x >> np.uint64(32))) + line[at].astype(np.uint64) * (_MIX ^ np.uint64(k << 1))
    offsets = np.concatenate([[0], np.cumsum(count)])
    each = np.repeat(start - offsets[:-1], count) + np.arange(offsets[-1])
    offsets = pa.array(offsets, pa.int32())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(doc[start])), pa.array((i - begin)[start], pa.int32()),
         pa.ListArray.from_arrays(offsets, pa.array(raw[each], pa.int32())),
         pa.ListArray.from_arrays(offsets, pa.array(words[each], pa.int32())),
         pa.ListArray.from_arrays(offsets, pa.array(a[each], pa.int64())),
         pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
        names=["doc", "pos", "raw", "words", "lines", "h1", "h2"])


def document_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Order of documents; no part of it is null."""
    kind = docs.schema[id_col].dataType
    return F.struct(F.col(id_col).isNull().alias("none"),
                    F.coalesce(F.col(id_col), F.lit("0").cast(kind)).alias("id"),
                    F.xxhash64(text_col).alias("hash"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, mask)``: per later document, which of its lines (from 0) are deleted."""
    def split(line: Column, pos: Column) -> Column:
        return F.struct(pos.alias("raw"), word_count(line).cast("int").alias("words"),
                        F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _run_rows(batch, min_words)

    held_lines = docs.where(F.col(text_col).isNotNull()).select(
        document_key(docs, id_col, text_col).alias("doc"),
        F.filter(F.transform(F.split(text_col, "\n", -1), split), lambda x: x["words"] > 0)
        .alias("lines"))
    kind = held_lines.schema["doc"].dataType.simpleString()
    lines = written(held_lines.mapInArrow(
        cut, f"doc {kind}, pos int, raw array<int>, words array<int>, lines array<bigint>, h1 bigint, h2 bigint"))
    shared = written(lines.groupBy("h1", "h2")
                     .agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                     .where("first < last").select("h1", "h2", "first"))
    # written before the join and before grouping, so that no aggregation shares the join's
    # partitioning and Spark can split the rows of a very frequent run
    found = written(lines.join(shared, ["h1", "h2"]))
    held = written(found.groupBy("h1", "h2", "first", "doc")    # a document's repeats of a run
                   .agg(F.sort_array(F.collect_set(F.struct("pos", "raw"))).alias("at"),
                        F.first("lines").alias("lines"), F.first("words").alias("words")))
    base = held.where("doc = first").select("h1", "h2", F.col("at.pos").alias("base"))
    links = (held.where("doc > first").join(base, ["h1", "h2"])
             .groupBy("doc").agg(F.collect_list(F.struct("first", "at", "base", "lines", "words"))
                                 .alias("links")))         # of one document's lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [_mask(x, min_words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(masks, pa.list_(pa.bool_()))], names=["doc", "mask"])

    return links.mapInArrow(run, f"doc {kind}, mask array<boolean>").where(F.size("mask") > 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS, mask_col: str | None = None) -> DataFrame:
    """``docs`` with the aligned common blocks deleted from the later documents' texts.

    ``mask_col`` names an extra column with the deleted lines' mask (null: none deleted).
    """
    gone = written(removed_lines(docs, id_col, text_col, min_words)) \
        .select(F.col("doc").alias("_doc"), F.col("mask").alias("_mask"))
    keyed = boxed(docs, _key=document_key(docs, id_col, text_col), _text=F.col(text_col))
    # shuffled hash: the few masks are the build side, and long texts need no sort
    out = keyed.join(gone.hint("shuffle_hash"), F.col("_key") == F.col("_doc"), "left")
    kept = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.coalesce(
        F.get(F.col("_mask"), i), F.lit(False))), "\n")
    text = F.when(F.col("_mask").isNull(), F.col("_text")).otherwise(kept)
    cols = [text.alias(c) if c == text_col else F.col(f"_in.`{c}`") for c in docs.columns]
    return out.select(*cols, *([F.col("_mask").alias(mask_col)] if mask_col else []))
