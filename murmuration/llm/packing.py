"""Best-fit packing of token pieces into sequences, with vector capacities.

A sequence has three capacities: tokens, documents (pieces) and attention cost (the sum of
squared piece lengths, the work of block-diagonal attention). Pieces are placed longest first;
among the open sequences that keep every constraint the one with the smallest weighted norm of
the residual vector is taken (``rule="norm"``), or the one with the largest weighted dot-product
of demand and residual (``rule="dot"``). With no feasible one a sequence is opened.

Pieces are dealt by a hash of their row number into chunks of a bounded number of rows, and
each chunk is packed in one task: only its last few sequences are not full, so the loss against
one global packing is below one sequence a chunk. Pieces that fill a sequence alone take part
like any other. Tasks get lengths only; ids stay behind unless asked for.

Null and empty texts are packed as their end id. A null document id is kept. Repeated rows are
separate pieces. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.common import boxed, written

CHUNK_ROWS = 8192


def best_fit(lengths: np.ndarray, capacity: Sequence[int], weights: Sequence[float],
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece. ``capacity``: tokens, documents, attention cost."""
    cap = np.asarray(capacity, dtype=np.int64)
    w = np.asarray(weights, dtype=np.float64)
    n = len(lengths)
    where, offset = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    tokens, docs, cost = (np.empty(n, dtype=np.int64) for _ in range(3))   # residuals, open bins
    name = np.empty(n, dtype=np.int64)
    opened = live = 0
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if n else 0
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1, size * size], dtype=np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {size} tokens is over a sequence's capacities")
        ok = (tokens[:live] >= size) & (docs[:live] >= 1) & (cost[:live] >= need[2])
        fits = np.flatnonzero(ok)
        if len(fits):
            left = (tokens[fits], docs[fits], cost[fits])
            if rule == "dot":
                score = -sum(w[k] * (need[k] / cap[k]) * (left[k] / cap[k]) for k in range(3))
            else:
                score = sum(w[k] * ((left[k] - need[k]) / cap[k]) ** 2 for k in range(3))
            j = int(fits[np.argmin(score)])
        else:
            j = live
            live += 1
            tokens[j], docs[j], cost[j], name[j] = *cap, opened
            opened += 1
        where[i], offset[i] = name[j], cap[0] - tokens[j]
        tokens[j] -= size
        docs[j] -= 1
        cost[j] -= need[2]
        if tokens[j] < least or docs[j] == 0 or cost[j] < least * least:
            live -= 1       # full: the last open bin takes its place
            tokens[j], docs[j], cost[j], name[j] = (tokens[live], docs[live], cost[live],
                                                    name[live])
    return where, offset


def _packer(capacity, weights, rule) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("_row", ignore_index=True)
        where, offset = best_fit(chunk["length"].to_numpy(), capacity, weights, rule)
        return chunk.assign(sequence_id=chunk["_chunk"].astype("int64") * (1 << 32) + where,
                            offset=offset).drop(columns="_chunk")

    return run


def pack(pieces: DataFrame, tokens: int = 1024, max_docs: int | None = None,
         max_cost: int | None = None, weights: Sequence[float] = (1.0, 0.01, 0.01),
         rule: str = "norm", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``pieces`` (any columns, with ``length``) plus ``sequence_id`` and ``offset``, in place of
    any columns of these names.

    ``max_docs`` and ``max_cost`` default to values no sequence of ``tokens`` tokens exceeds.
    """
    capacity = (tokens, max_docs or tokens, max_cost or tokens * tokens)
    rows = written(boxed(pieces.drop("sequence_id", "offset"), length=F.col("length"),
                         _row=F.monotonically_increasing_id()))
    chunks = max(1, -(-rows.count() // chunk_rows))
    dealt = (rows.select("_row", "length")
             .withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.lit(chunks)).cast("int")))
    placed = (dealt.groupBy("_chunk").applyInPandas(
        _packer(capacity, weights, rule),
        T.StructType([*dealt.drop("_chunk").schema.fields,
                      T.StructField("sequence_id", T.LongType()),
                      T.StructField("offset", T.LongType())])).drop("length"))
    return rows.join(placed, "_row").select("_in.*", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from rows with ``ids``: sequence_id, tokens, ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))   # at most one sequence
    return (packed.groupBy("sequence_id")
            .agg(F.sum("length").alias("tokens"), parts.alias("_parts"))
            .select("sequence_id", "tokens",
                    F.aggregate("_parts", F.lit(b"").cast("binary"),
                                lambda acc, x: F.concat(acc, x["ids"])).alias("ids")))
