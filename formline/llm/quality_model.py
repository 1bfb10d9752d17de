"""Text quality by a regularised quadratic discriminant over transformed document statistics.

Each text becomes ``FEATURES`` bounded or logarithmic statistics of its bytes, words and lines. Class sizes,
means and covariances are sums over all labelled training rows, added up by Spark. A class covariance is
shrunk towards the pooled one and the pooled variances; its Cholesky factor is computed once and kept in
the model. The score is the logistic of the difference of the Mahalanobis log-densities plus the log odds
of the classes, tempered by the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.llm.common import pick
from formline.llm.tokens import NOT_SPACE, bytes_of, slices, words

FEATURES = [
    "log_words", "log_word_bytes", "letters", "capitals", "digits", "stops", "symbols", "other_marks",
    "distinct_words", "top_repeat", "words_with_symbols", "capital_words", "log_line_words", "repeated_lines",
]
#: Shrinkage of a class covariance towards the pooled one, and of that towards its diagonal.
TO_POOLED, TO_DIAGONAL = 0.3, 0.1
#: Least variance of a statistic.
LEAST_VARIANCE = 1e-3
#: Most that one score may lean: log-density differences are divided by this.
TEMPER = 2.0

_KIND = np.full(256, 5, np.uint8)  # 0 letter, 1 capital, 2 digit, 3 stop, 4 symbol, 5 other mark, 6 white space
_KIND[97:123] = 0
_KIND[128:] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".,;:?'\"-"]] = 3
_KIND[[ord(c) for c in "#$%&*@^~|<>=+_{}[]\\/!"]] = 4
_KIND[[32, *range(9, 14)]] = 6


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return upto[bounds[1:]] - upto[bounds[:-1]]


def _repeats(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the most frequent one's count, per row."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))) if len(r) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate((new, [len(r)])))
    distinct, most = np.bincount(r[new], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(most, r[new], counts)
    return distinct, most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty or missing text has zeros but for ratios of nothing, 0."""
    data, bounds = bytes_of(column)
    return np.concatenate([_statistics(data, bounds[lo : hi + 1]) for lo, hi in slices(bounds)] or [np.zeros((0, len(FEATURES)))])


def _statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = len(bounds) - 1
    found = words(data, bounds, NOT_SPACE, lower=False)
    bounds, data = bounds - bounds[0], found.data
    kind = _KIND[data]
    per_kind = np.stack([_sums(kind == k, bounds) for k in range(6)], axis=1)
    inked = np.maximum(per_kind.sum(axis=1), 1)
    n_words = np.diff(found.first).astype(np.float64)
    some = np.maximum(n_words, 1)
    distinct, most = _repeats(found.rows, found.hashes, n)
    upto = np.concatenate(([0], np.cumsum(kind == 4)))
    with_symbol = (upto[found.ends] > upto[found.starts]).astype(np.float64)
    upto = np.concatenate(([0], np.cumsum(kind == 1)))
    shouting = (2 * (upto[found.ends] - upto[found.starts]) >= found.ends - found.starts).astype(np.float64)
    breaks = data == 10
    edges = np.unique(np.concatenate((np.flatnonzero(breaks) + 1, bounds[:-1][np.diff(bounds) > 0])))
    line_row = np.searchsorted(bounds, edges, "right") - 1
    edges, line_row = edges[edges < bounds[-1]], line_row[edges < bounds[-1]]
    of_line = np.searchsorted(edges, found.starts, "right") - 1
    with np.errstate(over="ignore"):
        within = np.arange(len(of_line)) - np.searchsorted(of_line, of_line) if len(of_line) else of_line
        line_hash = np.zeros(len(edges), np.uint64)
        np.add.at(line_hash, of_line, found.hashes * (2 * within.astype(np.uint64) + np.uint64(1)))
    line_words = np.bincount(of_line, minlength=len(edges))
    real = line_words > 0
    lines = np.maximum(np.bincount(line_row[real], minlength=n), 1)
    distinct_lines, _ = _repeats(line_row[real], line_hash[real], n)
    word_bytes = _sums((found.ends - found.starts), found.first)
    return np.stack([
        np.log1p(n_words), np.log1p(word_bytes / some), *(np.sqrt(per_kind[:, k] / inked) for k in range(6)),
        distinct / some, np.sqrt(most / some), np.sqrt(_sums(with_symbol, found.first) / some), np.sqrt(_sums(shouting, found.first) / some),
        np.log1p(n_words / lines), 1 - np.minimum(1, np.maximum(distinct_lines, n_words == 0) / lines),
    ], axis=1)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) of every row's whole text."""
    rows = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([rows.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch["text"])
            offsets = pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], names=["id", "x"])

    return rows.mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Per class (0, 1): log share, mean, Cholesky factor of the shrunk covariance and its log-determinant."""

    log_share: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Likelihood of class 1, 0 to 1."""
        if not len(x):
            return np.zeros(0)
        density = []
        for k in range(2):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            density.append(-0.5 * ((z * z).sum(axis=0) + self.log_dets[k]))
        lean = (density[1] - density[0]) / TEMPER + self.log_share[1] - self.log_share[0]
        return 1 / (1 + np.exp(-np.clip(lean, -60, 60)))


def fit(labelled: DataFrame) -> Discriminant:
    """From rows (label 0 or 1, x); rows without a label teach nothing. Repeated rows count as often.

    With no row of a class, that class takes the pooled distribution.
    """
    d = len(FEATURES)
    schema = "label int, n double, s array<double>, ss array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, d)
            y = batch["label"].to_numpy(zero_copy_only=False)
            for k in range(2):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(axis=0)
                ss[k] += own.T @ own
        yield pa.RecordBatch.from_pylist([{"label": k, "n": n[k], "s": s[k].tolist(), "ss": ss[k].reshape(-1).tolist()} for k in range(2)],
                                         schema=pa.schema([("label", pa.int32()), ("n", pa.float64()), ("s", pa.list_(pa.float64())), ("ss", pa.list_(pa.float64()))]))

    parts = labelled.filter("label is not null").select(F.col("label").cast("int").alias("label"), "x").mapInArrow(run, schema)
    total = parts.groupBy("label").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s"),
        F.array(*[F.sum(F.col("ss")[i]) for i in range(d * d)]).alias("ss"),
    ).collect()  # two rows
    n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in total:
        k = r["label"]
        n[k], s[k], ss[k] = r["n"], r["s"], np.array(r["ss"]).reshape(d, d)
    return from_sums(n, s, ss)


def from_sums(n: np.ndarray, s: np.ndarray, ss: np.ndarray) -> Discriminant:
    d = s.shape[1]
    whole = max(1.0, n.sum())
    means = np.stack([s[k] / n[k] if n[k] else s.sum(axis=0) / whole for k in range(2)])
    scatter = np.stack([ss[k] - n[k] * np.outer(means[k], means[k]) for k in range(2)])
    pooled = scatter.sum(axis=0) / whole
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled)) + LEAST_VARIANCE * np.eye(d)
    factors = np.stack([
        np.linalg.cholesky((1 - TO_POOLED) * (scatter[k] / max(1.0, n[k])) + TO_POOLED * pooled + LEAST_VARIANCE * np.eye(d)) for k in range(2)
    ])
    share = (n + 1) / (n.sum() + 2)
    return Discriminant(np.log(share), means, factors, 2 * np.log(np.stack([np.diag(f) for f in factors])).sum(axis=1))


def score(described: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row of ``features``."""
    schema = T.StructType([described.schema["id"], T.StructField("score", T.DoubleType())])
    values = vars(model)  # a few matrices of the number of features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Discriminant(**values)
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(own.score(x))], names=["id", "score"])

    return described.select("id", "x").mapInArrow(run, schema).withColumnRenamed("id", id_col)
