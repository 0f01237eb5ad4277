"""Text quality by regularised quadratic discriminant analysis of text statistics.

Each class gets a mean and a covariance of the transformed statistics; the covariance is
shrunk towards the pooled one and towards its own diagonal. A text's score is the posterior
of class 1: the difference of the two Gaussian log-densities, from Mahalanobis distances by
cached Cholesky factors, plus the log ratio of the classes.

Moments are summed over all labelled rows in Spark (counts, sums, products), so the fit has
no bound on labels and moves only a few hundred numbers to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import PrefixHash, batch_of, bucket_of, schema, slices, stored, utf8, words

SLICE = 1 << 22
STATISTICS = (
    "n_words", "word_bytes", "upper", "digits", "symbols", "bars", "shouts", "stops",
    "different_words", "repeated_words", "line_bytes", "different_lines", "wide",
)
ROWS = schema("doc_id bigint, stats array<double>")
MOMENTS = schema("label int, cell int, value double")
SCORED = schema("doc_id bigint, score double")


def _mask(text: bytes) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[[*text]] = True
    return mask


UPPER, DIGITS = _mask(bytes(range(65, 91))), _mask(b"0123456789")
SYMBOLS, BARS, SHOUTS, STOPS = _mask(b"#*$%&<>{}[]\\^~=_@+"), _mask(b"|"), _mask(b"!"), _mask(b".,;:?")
UPPER_WIDE = _mask(bytes(range(0x80, 0xA0)))  # second byte of most accented capitals


def statistics(texts: pa.Array) -> np.ndarray:
    """(text, statistic) matrix, transformed so that usual texts are about normal."""
    flat, at = utf8(texts)
    n = len(texts)
    sizes = np.diff(at)
    start, end, row = words(flat, at)
    n_words = np.bincount(row, minlength=n).astype(float)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    upper = UPPER[flat].copy()
    if len(flat) > 1:
        upper[1:] |= UPPER_WIDE[flat[1:]] & (flat[:-1] == 0xC3)
    letters = np.maximum(sizes - count(flat == 0x20), 1)
    prefix = PrefixHash(flat)

    def different(begin, stop, rows):
        key = prefix.of(begin, stop)
        rank = np.lexsort((key, rows))
        new = np.ones(len(key), bool)
        new[1:] = (key[rank][1:] != key[rank][:-1]) | (rows[rank][1:] != rows[rank][:-1])
        return np.bincount(rows[rank][new], minlength=n)

    # a word equal to the one before it
    again = np.zeros(len(start), bool)
    if len(start) > 1:
        h = prefix.of(start, end)
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    cut = np.zeros(len(flat) + 1, bool)
    cut[at] = True
    cut[:-1] |= flat == 0x0A
    edge = np.flatnonzero(cut)
    line_start, line_end = edge[:-1], edge[1:]
    line_start = line_start + (flat[np.minimum(line_start, max(len(flat) - 1, 0))] == 0x0A if len(flat) else 0)
    keep = line_end > line_start
    line_start, line_end = line_start[keep], line_end[keep]
    line_row = np.searchsorted(at, line_start, side="right") - 1
    lines = np.maximum(np.bincount(line_row, minlength=n), 1)
    some = np.maximum(n_words, 1)
    share = lambda x, y: np.log((x + 0.5) / (y + 1))
    return np.column_stack([
        np.log1p(n_words), np.log1p(np.bincount(row, end - start, minlength=n) / some),
        share(count(upper), letters), share(count(DIGITS[flat]), letters), share(count(SYMBOLS[flat]), some),
        share(count(BARS[flat]), some), share(count(SHOUTS[flat]), some), share(count(STOPS[flat]), some),
        np.log1p(some - different(start, end, row)) - np.log1p(some), share(np.bincount(row, again, minlength=n), some),
        np.log1p(sizes / lines), share(lines - np.minimum(different(line_start, line_end, line_row), lines), lines),
        share(count(flat >= 0x80), letters),
    ])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            yield batch_of(ROWS, batch.column("doc_id"), list(statistics(batch.column("text"))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(STATISTICS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 + len(STATISTICS)
    total = {0: np.zeros((size, size)), 1: np.zeros((size, size))}
    for batch in batches:
        x = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column("stats"))]) if batch.num_rows else np.zeros((0, size))
        label = batch.column("label").to_numpy()
        for k in total:
            total[k] += x[label == k].T @ x[label == k]
    cells = np.arange(size * size)
    for k, sums in total.items():
        yield batch_of(MOMENTS, np.full(len(cells), k), cells, sums.ravel())


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes; log of their ratio."""

    means: tuple
    factors: tuple
    log_determinants: tuple[float, float]
    log_ratio: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [
            -0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d
            for m, f, d in zip(self.means, self.factors, self.log_determinants)]
        gap = self.log_ratio + (density[1] - density[0] if density else np.zeros(len(x)))
        return 1 / (1 + np.exp(np.clip(-gap, -700, 700)))


def _shrunk(cov: np.ndarray, pooled: np.ndarray, n: float, towards_pooled: float, towards_diagonal: float):
    """Shrinkage after Friedman, stronger for a class of few rows; a small ridge keeps it positive."""
    share = max(towards_pooled, len(cov) / (n + len(cov)))
    mixed = (1 - share) * cov + share * pooled
    return (1 - towards_diagonal) * mixed + towards_diagonal * np.diag(np.diag(mixed)) + 1e-3 * np.eye(len(cov))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5,
        towards_pooled: float = 0.1, towards_diagonal: float = 0.1) -> Discriminant:
    """The discriminant of labelled rows whose id's crc32 modulo ``folds`` is not 0.

    ``stats`` is ``text_statistics``. With rows of one class only, or none, every text gets
    the smoothed share of class 1.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (bucket_of(F.col("doc_id"), folds) != 0))
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    parts = stats.join(usable, "doc_id").select("stats", "label").mapInArrow(_moments, MOMENTS)
    cells = parts.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect()
    size = 1 + len(STATISTICS)
    sums = np.zeros((2, size, size))
    for r in cells:
        sums[r["label"], r["cell"] // size, r["cell"] % size] = r["value"]
    n = sums[:, 0, 0]
    ratio = float(np.log((n[1] + 1) / (n[0] + 1)))
    if (n < 2).any():
        return Discriminant((), (), (), ratio)
    means = [s[0, 1:] / s[0, 0] for s in sums]
    covs = [s[1:, 1:] / s[0, 0] - np.outer(m, m) for s, m in zip(sums, means)]
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / n.sum()
    lower = [np.linalg.cholesky(_shrunk(c, pooled, k, towards_pooled, towards_diagonal)) for c, k in zip(covs, n)]
    return Discriminant(tuple(means), tuple(np.linalg.inv(f) for f in lower),
                        tuple(float(2 * np.log(np.diag(f)).sum()) for f in lower), ratio)


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of ``docs`` (doc_id, text); null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_statistics, ROWS)


def _scored(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(SCORED, batch.column("doc_id"), model.score(_matrix(batch.column("stats"))))
    return run


def score(stats: DataFrame, model: Discriminant, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``text_statistics``.

    Empty texts have statistics and a score like any other; null ids keep their rows;
    repeated rows score alike; an empty table gives an empty table.
    """
    return stats.mapInArrow(_scored(model), SCORED).select(
        "doc_id", (bucket_of(F.col("doc_id"), folds) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics are computed once, into a narrow table, for the fit and for all scores."""
    stats = stored(text_statistics(docs), "statistics")
    return score(stats, fit(stats, labels))
