"""Language identification by interpolated Kneser-Ney character models, one per language.

Training counts the character n-grams of every training text: each partition combines its own counts, Spark
adds them up, and the lower orders' continuation counts, context totals and discounts follow from the table
of distinct n-grams by aggregation. The model keeps, per order, a sorted array of n-gram hashes with one
log-probability per language, and a sorted array of context hashes with one back-off weight per language.
Hashes have as many bits as keep the model below ``MODEL_BYTES`` (hash collisions merge n-grams), so what
is broadcast has a bound that depends on the number of languages only.

A text goes to the language of the lowest cross-entropy per character. The temperature of the scores and
each language's rejection threshold are calibrated on all training texts: tasks score them, Spark adds up the losses
and takes the quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from formline.llm.common import few_rows, pick
from formline.operators.quantiles import group_quantiles
from formline.session import cut

#: Characters of the longest n-gram; four 16-bit characters fill a 64-bit key.
ORDER = 4
#: Upper bound of the model arrays.
MODEL_BYTES = 192 << 20
#: Temperatures of the scores among which calibration chooses.
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
#: Share of a language's own texts that its rejection threshold accepts.
ACCEPTED = 0.995
#: Characters handled at a time, long texts aside.
SLICE_CHARS = 1 << 20
UNDETERMINED = "und"

_SPACE = 32


def _folding() -> np.ndarray:
    """Lower case of each 16-bit letter; everything else is a space."""
    table = np.full(1 << 16, _SPACE, np.uint16)
    for point in range(1 << 16):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else point
    return table


def letters(texts: list[str | None], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts and each text's bounds.

    Every run of other characters is one space; each text with letters begins and ends with one. Letters beyond
    16 bits are folded into the private area by their low bits.
    """
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lens = np.fromiter(map(len, points), np.int64, len(points)) + 2
    flat = np.zeros(int(lens.sum()), np.uint32)
    ends = np.cumsum(lens)
    for p, end in zip(points, ends.tolist()):
        flat[end - len(p) - 1 : end - 1] = p
    far = flat >= 1 << 16
    codes = fold[np.where(far, 0, flat)]
    for i in np.flatnonzero(far).tolist():
        codes[i] = 0xE000 + (int(flat[i]) & 0x0FFF) if chr(int(flat[i])).isalpha() else _SPACE
    space = codes == _SPACE
    begins = np.zeros(len(flat), bool)
    begins[ends - lens] = True
    keep = ~(space & np.concatenate(([False], space[:-1]))) | begins
    upto = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], upto[np.concatenate(([0], ends))]


def ngrams(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit key of the n-gram ending at each character but a text's first, and the text of each.

    Before a text's first space lie further spaces. A text without letters gives none.
    """
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    within = np.arange(len(codes)) - bounds[owner] if len(codes) else np.empty(0, np.int64)
    key = codes.astype(np.uint64)
    for back in range(1, ORDER):
        earlier = np.full(len(codes), _SPACE, np.uint64)
        earlier[back:] = codes[: len(codes) - back]
        earlier[within < back] = _SPACE
        key |= earlier << np.uint64(16 * back)
    chosen = (within > 0) & (np.diff(bounds) > 2)[owner] if len(codes) else np.empty(0, bool)
    return key[chosen], owner[chosen]


def hashed(key: np.ndarray, bits: int) -> np.ndarray:
    h = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.uint32)


def count_ngrams(train: DataFrame) -> DataFrame:
    """(lang, key, n) of the longest n-grams of all rows of ``train`` (lang, text)."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, held, size = _folding(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], schema=arrow)

        for batch in few_rows(batches, 2048):
            langs = np.array(batch["lang"].to_pylist(), object)
            texts = batch["text"].to_pylist()
            for lang in sorted(set(langs.tolist())):
                group, chars = [], 0
                mine = np.flatnonzero(langs == lang).tolist()
                for i in mine:
                    group.append(texts[i])
                    chars += len(texts[i] or "")
                    if chars >= SLICE_CHARS or i == mine[-1]:
                        key, _ = ngrams(*letters(group, fold))
                        keys, counts = np.unique(key, return_counts=True)
                        held.setdefault(lang, []).append((keys, counts))
                        size += len(keys)
                        group, chars = [], 0
            if size > 4_000_000:
                yield from flush()
                held, size = {}, 0
        yield from flush()

    return train.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "key").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Sorted hash arrays of all orders; ``grams[o]`` and ``backoff[o]`` have a row per hash, a column per language."""

    langs: list[str]
    bits: int
    gram_hashes: list[np.ndarray] = field(default_factory=list)
    grams: list[np.ndarray] = field(default_factory=list)
    context_hashes: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: float = -16.0
    temperature: float = 1.0
    limits: list[float] = field(default_factory=list)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Model of all rows with a language; rows without one, or without letters, teach nothing."""
    rows = pick(docs, lang=lang_col, text=text_col).filter("lang is not null and text is not null")
    grams = {ORDER: cut(count_ngrams(rows))}
    langs = sorted(r["lang"] for r in grams[ORDER].select("lang").distinct().collect())
    # per slot: a hash and a log-probability per language, for n-grams and for contexts of every order
    room = MODEL_BYTES // max(1, 2 * ORDER * (4 + 4 * len(langs)))
    bits = max(8, min(24, room.bit_length() - 1))
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer n-grams that end so
        low = F.col("key").bitwiseAND((1 << 16 * order) - 1)
        grams[order] = cut(grams[order + 1].groupBy("lang", low.alias("key")).agg(F.count(F.lit(1)).alias("n")))
    model = Model(langs, bits)
    lower: DataFrame | None = None
    for order in range(1, ORDER + 1):
        lower, contexts = _interpolated(grams[order], lower, order)
        lower = cut(lower)
        hashes, table = _fetch(lower.select("lang", "key", F.log("p").alias("x")), langs, bits, np.nan)
        model.gram_hashes.append(hashes)
        model.grams.append(table)
        hashes, table = _fetch(contexts.select("lang", "key", F.log("weight").alias("x")), langs, bits, 0.0)
        model.context_hashes.append(hashes)
        model.backoff.append(table)
    seen = np.array([[np.isfinite(x).sum()] for x in model.grams[0].T]) if langs else np.zeros((0, 1))
    model.floor = float(-np.log(max(2.0, seen.max(initial=1) * 16.0)))
    _calibrate(model, rows)
    return model


def _interpolated(grams: DataFrame, lower: DataFrame | None, order: int) -> tuple[DataFrame, DataFrame]:
    """(lang, key, p) of all seen n-grams of one order, and (lang, key, weight) of their contexts."""
    totals = grams.groupBy("lang").agg(
        F.sum((F.col("n") == 1).cast("double")).alias("n1"), F.sum((F.col("n") == 2).cast("double")).alias("n2")
    ).select("lang", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("discount"))
    held = F.shiftrightunsigned("key", 16)
    priced = grams.join(F.broadcast(totals), "lang").withColumn("context", held)  # a row for each language
    contexts = priced.groupBy("lang", "context").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"), F.first("discount").alias("d")
    ).withColumn("weight", F.greatest(F.col("d") * F.col("types") / F.col("total"), F.lit(1e-6)))
    joined = priced.join(contexts.select("lang", "context", "total", "weight"), ["lang", "context"])
    own = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
    if lower is None:
        types = Window.partitionBy("lang")
        p = own + F.col("weight") / (F.count(F.lit(1)).over(types) * 16)
        found = joined.select("lang", "key", p.alias("p"))
    else:
        short = F.col("key").bitwiseAND((1 << 16 * (order - 1)) - 1)
        below = lower.select("lang", F.col("key").alias("short"), F.col("p").alias("q"))
        found = joined.withColumn("short", short).join(below, ["lang", "short"]).select("lang", "key", (own + F.col("weight") * F.col("q")).alias("p"))
    return found, contexts.select("lang", F.col("context").alias("key"), "weight")


def _fetch(rows: DataFrame, langs: list[str], bits: int, empty: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and their values per language; at most 2 ** bits rows reach the driver."""
    place = {lang: i for i, lang in enumerate(langs)}
    schema = "slot long, lang string, x double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = hashed(b["key"].to_numpy(zero_copy_only=False).view(np.uint64), bits).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), b["lang"], b["x"]], names=["slot", "lang", "x"])

    merged = rows.select("key", "lang", "x").mapInArrow(run, schema).groupBy("slot", "lang").agg(F.max("x").alias("x"))
    found = merged.toArrow()
    slot, x = found["slot"].to_numpy(), found["x"].to_numpy()
    column = np.array([place[v] for v in found["lang"].to_pylist()], np.int64)
    hashes, at = np.unique(slot, return_inverse=True)
    table = np.full((len(hashes), len(langs)), empty, np.float32)
    table[at, column] = x
    return hashes.astype(np.uint32), table


def _find(hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(hashes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(hashes, wanted).clip(0, len(hashes) - 1)
    return at, hashes[at] == wanted


def log_probabilities(model: Model, keys: np.ndarray) -> np.ndarray:
    """Log-probability of the last character of each n-gram given those before, a column per language."""
    out = np.full((len(keys), len(model.langs)), np.nan, np.float32)
    carried = np.zeros_like(out)
    for order in range(ORDER, 0, -1):
        open_rows = np.flatnonzero(np.isnan(out).any(axis=1))
        if not len(open_rows):
            break
        key = keys[open_rows] & np.uint64((1 << 16 * order) - 1)
        at, hit = _find(model.gram_hashes[order - 1], hashed(key, model.bits))
        got = np.where(hit[:, None], model.grams[order - 1][at], np.nan) if len(model.grams[order - 1]) else np.full((len(key), len(model.langs)), np.nan)
        cells = out[open_rows]
        out[open_rows] = np.where(np.isnan(cells), got + carried[open_rows], cells)
        at, hit = _find(model.context_hashes[order - 1], hashed(key >> np.uint64(16), model.bits))
        if len(model.backoff[order - 1]):
            carried[open_rows] += np.where(hit[:, None], model.backoff[order - 1][at], 0.0).astype(np.float32)
    return np.where(np.isnan(out), carried + model.floor, out)


def cross_entropies(model: Model, texts: list[str | None], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character of each text in each language, and the number of characters scored."""
    sums, counts = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), np.int64)
    lo = 0
    while lo < len(texts):
        hi, chars = lo, 0
        while hi < len(texts) and (hi == lo or chars + len(texts[hi] or "") <= SLICE_CHARS):
            chars += len(texts[hi] or "")
            hi += 1
        keys, owner = ngrams(*letters(texts[lo:hi], fold))
        distinct, at = np.unique(keys, return_inverse=True)
        scores = log_probabilities(model, distinct)
        counts[lo:hi] = np.bincount(owner, minlength=hi - lo)
        for column in range(len(model.langs)):
            sums[lo:hi, column] = np.bincount(owner, weights=scores[at, column], minlength=hi - lo)
        lo = hi
    return -sums / np.maximum(counts, 1)[:, None], counts


def _posterior(entropy: np.ndarray, counts: np.ndarray, temperature: float) -> np.ndarray:
    z = -temperature * entropy * np.sqrt(counts)[:, None]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Temperature and limits from all training texts; a loss per temperature and a quantile per language are collected."""
    model.limits = [float("inf")] * len(model.langs)
    if not model.langs:
        return
    shared = rows.sparkSession.sparkContext.broadcast(vars(model) | {"limits": []})
    losses = [f"loss_{i}" for i in range(len(TEMPERATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, own = _folding(), Model(**shared.value)
        place = {lang: i for i, lang in enumerate(own.langs)}
        for batch in few_rows(batches):
            entropy, counts = cross_entropies(own, batch["text"].to_pylist(), fold)
            # a language that taught nothing has only texts without characters, which are dropped
            truth, each = np.array([place.get(v, 0) for v in batch["lang"].to_pylist()], np.int64), np.arange(len(counts))
            loss = [-np.log(np.maximum(_posterior(entropy, counts, t)[each, truth], 1e-12)) for t in TEMPERATURES]
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], pa.array(counts), pa.array(entropy[each, truth]), *map(pa.array, loss)], names=["lang", "n", "entropy", *losses])

    schema = "lang string, n long, entropy double, " + ", ".join(f"{c} double" for c in losses)
    scored = cut(rows.select("lang", "text").mapInArrow(run, schema).filter("n > 0"))
    mean = scored.agg(*[F.avg(c).alias(c) for c in losses]).first()
    if mean[losses[0]] is None:
        return
    model.temperature = TEMPERATURES[int(np.argmin([mean[c] for c in losses]))]
    for r in group_quantiles(scored, ["lang"], ["entropy"], [ACCEPTED]).collect():  # a row a language
        model.limits[model.langs.index(r["lang"])] = r["entropy__q"][0] * 1.05


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cross_entropy, rejected) for every row, from its whole text alone.

    ``und`` with score 0 where the text is missing or has no letter, or nothing was learned. ``rejected`` marks
    texts whose cross-entropy is above the threshold of their language, and undetermined ones. Equal
    cross-entropies go to the first language by name.
    """
    rows = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([
        rows.schema["id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
    ])
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # below MODEL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, own = _folding(), Model(**shared.value)
        for batch in few_rows(batches):
            entropy, counts = cross_entropies(own, batch["text"].to_pylist(), fold)
            known = (counts > 0) & bool(own.langs)
            best = entropy.argmin(axis=1) if own.langs else np.zeros(len(counts), np.int64)
            posterior = _posterior(entropy, counts, own.temperature) if own.langs else entropy
            each = np.arange(len(best))
            langs = [own.langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
            score = np.where(known, posterior[each, best], 0.0) if own.langs else np.zeros(len(best))
            value = entropy[each, best] if own.langs else np.zeros(len(best))
            limit = np.array(own.limits)[best] if own.langs else value
            yield pa.RecordBatch.from_arrays([
                batch["id"], pa.array(langs, pa.string()), pa.array(score, pa.float64()),
                pa.array(np.where(known, value, np.nan), pa.float64(), from_pandas=True), pa.array(~known | (value > limit), pa.bool_()),
            ], names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
