"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

A text is the set of its words, of the runs of 2 to ``NGRAM`` words and of the pairs of words with up to ``SKIP``
words between them, each hashed to ``BITS`` bits. Languages that inflect spread one word over many forms, so a
word also counts by its stems, its first bytes for each length in ``STEMS``. FTRL-proximal keeps a sum of shifted gradients and a sum
of squared gradients for each coordinate: its rate falls with its own gradients, and a coordinate whose sum
stays within ``L1`` weighs exactly nothing. What is left, a few hashes and weights, is small enough to
broadcast: 2^BITS of them at the very most.

``labelled`` draws at most ``LABELLED_ROWS`` labelled rows, those with the smallest hash of their id, so that they can
be broadcast to the texts, which are not shuffled. Labelled rows are dealt into shards of about ``SHARD_ROWS`` rows by
that hash. Each shard is learned by one task in an order fixed by the hash, ``EPOCHS`` times, and the shards' weights
are averaged, each shard counting by its rows; ``fit`` itself takes any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.llm.common import few_rows, pick
from formline.llm.tokens import ALPHANUMERIC, Words, bytes_of, mixed, slices, words
from formline.session import cut

BITS, NGRAM, SKIP = 24, 3, 2
STEMS = (4, 5, 6)
#: Rate and its offset, penalties on the sum and on the squares of the weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 0.1
EPOCHS = 3
SHARD_ROWS = 8192
#: Labelled rows that are learned from at most.
LABELLED_ROWS = 20_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def features_of(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all n-grams, skip-grams and stems, with repeats."""
    rows, hashes = [], []
    n = len(found.hashes)
    run = found.hashes
    for length in range(1, NGRAM + 1):
        if length > 1:
            run = mixed(run[: n - length + 1] * _PRIME + found.hashes[length - 1 :]) if n >= length else run[:0]
        rows.append(found.rows[: len(run)][(inside := found.rows[: len(run)] == found.rows[length - 1 : length - 1 + len(run)])])
        hashes.append(run[inside])
    for gap in range(2, SKIP + 2):
        count = max(0, n - gap)
        inside = found.rows[:count] == found.rows[gap:][:count]
        pair = mixed((found.hashes[:count] ^ np.uint64(gap)) * _PRIME + found.hashes[gap:][:count])
        rows.append(found.rows[:count][inside])
        hashes.append(pair[inside])
    lens = found.ends - found.starts
    begins = np.zeros(n, np.uint64)  # the first eight bytes, the first one highest
    for i in range(max(STEMS, default=0)):
        own = lens > i
        begins[own] |= found.data[found.starts[own] + i].astype(np.uint64) << np.uint64(8 * (7 - i))
    for length in STEMS:
        long = lens > length
        rows.append(found.rows[long])
        hashes.append(mixed((begins[long] >> np.uint64(64 - 8 * length) ^ np.uint64(length << 56)) * _PRIME))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int32)


def _each(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, row within, feature) of slices of a text column."""
    data, bounds = bytes_of(column)
    for lo, hi in slices(bounds):
        rows, features = features_of(words(data, bounds[lo : hi + 1], ALPHANUMERIC, lower=True))
        yield lo, hi, rows, features


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of the documents of at most ``most`` labels that are not missing, the same ones on every run."""
    known = pick(labels, id=id_col, label=label).filter("id is not null and label is not null")
    drawn = known.orderBy(F.xxhash64("id"), "id", "label").limit(most)
    return pick(docs, id=id_col, text=text_col).join(F.broadcast(drawn), "id")


def features(docs: DataFrame, label: str = "label", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, label, x array<int>) with the distinct features of every labelled row's whole text."""
    rows = pick(docs, id=id_col, text=text_col, label=label).filter("label is not null").withColumn("label", F.col("label").cast("int"))
    schema = T.StructType([rows.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches, 1024):
            for lo, hi, rows_, found in _each(batch["text"]):
                pairs = np.unique((rows_.astype(np.int64) << 32) | found)
                ends = np.searchsorted(pairs >> 32, np.arange(hi - lo + 1)).astype(np.int32)
                x = pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(lo, hi - lo), batch["label"].slice(lo, hi - lo), x], names=["id", "label", "x"])

    return rows.select("id", "text", "label").mapInArrow(run, schema)


def ftrl(x: list[np.ndarray], y: np.ndarray, size: int, epochs: int = 0) -> np.ndarray:
    """Weights of ``size`` coordinates, the last one the intercept, after ``epochs`` passes over the rows in order.

    The intercept is learned without the penalty on its size.
    """
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    penalty = np.full(size, L1)
    penalty[-1] = 0.0
    for _ in range(epochs or EPOCHS):
        for own, truth in zip(x, y):
            zi, ni = z[own], n[own]
            wi = np.where(np.abs(zi) <= penalty[own], 0.0, -(zi - np.sign(zi) * penalty[own]) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35)))
            g = p - truth
            z[own] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[own] = ni + g * g
    some = np.abs(z) > penalty
    w[some] = -(z[some] - np.sign(z[some]) * penalty[some]) / ((BETA + np.sqrt(n[some])) / ALPHA + L2)
    return w


def _learn(group: pa.Table) -> pa.Table:
    """Weights other than 0 of one shard, in the order of (hash, label, features) whatever order the rows come in."""
    lists, labels, keys = group["x"].combine_chunks(), group["label"].to_numpy(), group["h"].to_numpy()
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    used = np.unique(flat[bounds[0] : bounds[-1]])
    rows = [flat[bounds[i] : bounds[i + 1]] for i in range(len(labels))]
    order = sorted(range(len(labels)), key=lambda i: (keys[i], labels[i], rows[i].tobytes()))
    x = [np.append(np.searchsorted(used, rows[i]), len(used)) for i in order]
    w = ftrl(x, labels[order].astype(np.float64), len(used) + 1)
    kept = np.flatnonzero(w)
    names = np.append(used, -1)[kept].astype(np.int32)
    return pa.table({"feature": names, "weight": w[kept], "rows": np.full(len(kept), len(labels), np.int64)})


@dataclass
class Weights:
    """Sorted hashes with a weight, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        lean = np.full(len(column), self.intercept)
        wanted = np.zeros(1 << 16, bool)
        wanted[self.features & 0xFFFF] = True
        for lo, hi, rows, found in _each(column):
            near = wanted[found & 0xFFFF]
            rows, found = rows[near], found[near]
            at = np.searchsorted(self.features, found).clip(0, max(0, len(self.features) - 1))
            hit = self.features[at] == found if len(self.features) else np.zeros(len(found), bool)
            pairs = np.unique(rows[hit].astype(np.int64) * len(self.features) + at[hit]) if hit.any() else np.empty(0, np.int64)
            if len(pairs):
                lean[lo:hi] += np.bincount(pairs // len(self.features), self.weights[pairs % len(self.features)], hi - lo)
        return 1 / (1 + np.exp(-np.clip(lean, -35, 35)))


def fit(labelled: DataFrame) -> Weights:
    """From rows of ``features`` (id, label 0 or 1, x). Without any row every score is a half."""
    spark = labelled.sparkSession
    stored = cut(labelled.withColumn("h", F.xxhash64("id")))
    n = stored.count()
    shards = max(1, -(-n // SHARD_ROWS))
    dealt = stored.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    learned = dealt.select("shard", "h", "label", "x").groupBy("shard").applyInArrow(_learn, "feature int, weight double, rows long")
    mean = cut(learned.groupBy("feature").agg((F.sum(F.col("weight") * F.col("rows")) / max(1, n)).alias("weight")))
    got = mean.toPandas().sort_values("feature")  # 2^BITS + 1 rows at most; L1 leaves a small part of them
    apart = got["feature"].to_numpy() == -1
    own = got[~apart]
    return Weights(own["feature"].to_numpy(np.int32), own["weight"].to_numpy(np.float64), float(got["weight"][apart].sum()))


def score(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score from 0 to 1) of every row; a missing or empty text has the intercept's score. No other column counts."""
    rows = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # 12 bytes for each weight other than 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(**shared.value)
        for batch in few_rows(batches, 1024):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(own.score(batch["text"]))], names=["id", "score"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
