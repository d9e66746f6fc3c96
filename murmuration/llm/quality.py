"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a fixed vector of transformed counts and shares. Training needs only the
per-class row count, sum and sum of products, which Spark aggregates over all labelled rows
(no sample); class covariances are shrunk towards the pooled one and the pooled diagonal, and
their Cholesky factors are computed once. A score is the logistic of the prior log-odds plus
the difference of the two log-densities, each from a Mahalanobis distance through the cached
factor.

Null text counts as empty; empty texts have a vector like any other and so a score. Without
training rows of one class its density is the other's, so the score is the prior. Labels that
are null are ignored; a document labelled several times has its smallest label. Repeated rows
get equal scores. A null id is in no fold (``held_out`` false) and has no label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmuration.llm.common import boxed, unboxed, written

FEATURES = ("log_bytes", "log_words", "word_bytes", "distinct_words", "commonest_word",
            "upper", "digits", "marks", "word_ends", "single_mark_words", "repeated_lines",
            "words_per_line", "capital_words", "compression")
PRIOR_ROWS = 1.0
_MARKS = np.zeros(256)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"-"]] = 1
_ENDED = re.compile(rb"[^\w\s.,'\"\x80-\xff-](?=\s|$)")
_LONE = re.compile(rb"(?:^|\s)[^\w\s\x80-\xff](?=\s|$)")
_CAPITAL = re.compile(rb"(?:^|\s)[A-Z]")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    n = len(text)
    words = text.split()
    k = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, digits = counts[65:91].sum(), counts[48:58].sum()
    letters = upper + counts[97:123].sum() + counts[128:].sum()
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    most = max(times.values(), default=0)
    share = lambda a, b: float(np.sqrt((a + 0.5) / (b + 1.0)))
    return [
        np.log1p(n), np.log1p(k), np.log1p(n / max(k, 1)),
        np.log((len(times) + 1.0) / (k + 1.0)), share(most, k),
        share(upper, letters), share(digits, n), share(float(counts @ _MARKS), n),
        share(len(_ENDED.findall(text)), k), share(len(_LONE.findall(text)), k),
        share(len(lines) - len(set(lines)), len(lines)), np.log1p(k / max(len(lines), 1)),
        share(len(_CAPITAL.findall(text)), k),
        np.log((len(zlib.compress(text, 1)) + 20.0) / (n + 20.0)),
    ]


def document_statistics(text: Column) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(x) for x in texts])

    return run(F.coalesce(text, F.lit("")).cast("binary"))


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % 3


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, inverse Cholesky factor and log-determinant of the covariance."""

    log_odds: float
    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    log_det: tuple[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - self.means[c]) @ self.whiten[c].T) ** 2).sum(axis=1)
                   - 0.5 * self.log_det[c] for c in (0, 1)]
        z = np.clip(self.log_odds + density[1] - density[0], -700, 700)
        return 1.0 / (1.0 + np.exp(-z))


def discriminant(n: np.ndarray, s: np.ndarray, ss: np.ndarray, to_pooled: float = 0.1,
                 to_diagonal: float = 0.05) -> Discriminant:
    """From the class counts, sums and sums of products."""
    d = s.shape[1]
    mean_all = s.sum(0) / max(n.sum(), 1.0)
    mean = [s[c] / n[c] if n[c] else mean_all for c in (0, 1)]
    scatter = [ss[c] - n[c] * np.outer(mean[c], mean[c]) if n[c] else np.zeros((d, d))
               for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / max(n.sum(), 1.0)
    means, whiten, log_det = [], [], []
    for c in (0, 1):
        other = 1 - c
        if not n[c] or not n[other]:      # one class only: equal densities
            cov, mu = pooled, mean_all
        else:
            # few rows of a class lean on the pooled covariance
            a = max(to_pooled, min(1.0, d / n[c]))
            cov, mu = (1 - a) * scatter[c] / n[c] + a * pooled, mean[c]
        cov = ((1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(pooled))
               + 1e-4 * np.eye(d))
        factor = np.linalg.cholesky(cov)
        means.append(mu)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2.0 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(float(np.log((n[1] + PRIOR_ROWS) / (n[0] + PRIOR_ROWS))), tuple(means),
                        tuple(whiten), tuple(log_det))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id",
        label_col: str = "quality") -> Discriminant:
    """Train on rows of ``stats`` (id, ``stats``) whose id is labelled and not held out."""
    d = len(FEATURES)
    marked = (labels.where(F.col(label_col).isin(0, 1) & (fold(F.col(id_col)) != 1))
              .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label")))
    rows = stats.join(marked, F.col(id_col) == F.col("_id")).select("label", "stats")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = np.stack(batch["stats"].to_numpy()) if len(batch) else np.zeros((0, d))
            for c in (0, 1):
                m = x[batch["label"].to_numpy() == c]
                n[c] += len(m)
                s[c] += m.sum(0)
                ss[c] += m.T @ m
        flat = np.concatenate([n, s.ravel(), ss.ravel()])
        yield pd.DataFrame({"k": np.arange(len(flat)), "v": flat})

    # one short row set per task, summed by Spark: 2 + 2d + 2d^2 numbers reach the driver
    got = (rows.mapInPandas(moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v"))
           .collect())
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in got:
        flat[r["k"]] = r["v"]
    return discriminant(flat[:2], flat[2:2 + 2 * d].reshape(2, d),
                        flat[2 + 2 * d:].reshape(2, d, d))


def score(stats: Column, model: Discriminant) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else [])

    return run(stats)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    stats = written(docs.select(F.col(id_col), document_statistics(F.col(text_col))
                                .alias("stats")))
    model = fit(stats, labels, id_col, label_col)
    return (stats.withColumn("score", score(F.col("stats"), model))
            .select(id_col, F.coalesce(fold(F.col(id_col)) == 1, F.lit(False)).alias("held_out"),
                    "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
              text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    stats = written(docs.select(F.col(id_col), document_statistics(F.col(text_col))
                                .alias("stats")))
    model = fit(stats, labels, id_col, label_col)
    # texts stay where they are: statistics are computed again rather than joined back
    return unboxed(boxed(docs, _score=score(document_statistics(F.col(text_col)), model))
                   .where("_score >= 0.5"))
