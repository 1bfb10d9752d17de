"""Benchmark decontamination by a distributed positional inverted index of the training texts.

The index is split by documents: a shard keeps, for some whole documents, the sorted term hashes of their
words and each term's positions. It is built by one pass without a shuffle and stored. Benchmark phrases
come in blocks of a bounded size; a shard looks up the positions of a phrase's rarest term (rarest over the
whole index), adjusts them by the term's offset, and keeps those that the lists of the phrase's other terms
share, the rarer first. With a slop, a term may lie that many words off its place (proximity match).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from formline.llm.common import pick
from formline.llm.tokens import ALPHANUMERIC, bytes_of, slices, words
from formline.session import cut

#: Text bytes of a shard, long documents aside.
SHARD_BYTES = 2 << 20
#: Benchmark text bytes that are searched for at a time; more items come in more blocks.
BLOCK_BYTES = 8 << 20
#: Phrases ranked at a time.
STEP = 100_000
#: Row groups of the stored index: a reader holds one at a time, whatever the size of its files.
ROW_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}
#: Words between the documents of a shard, so that no match reaches over; also the largest slop.
GAP = 64


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per shard: ids, n_words and first position of its documents, terms, counts and positions.

    A missing or empty text has no words but keeps its document. Ids may repeat.
    """
    rows = pick(docs, id=id_col, text=text_col)
    many = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("n_words", many), T.StructField("begins", many),
        T.StructField("terms", many), T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, bounds = bytes_of(batch["text"])
            for lo, hi in slices(bounds, SHARD_BYTES):
                found = words(data, bounds[lo : hi + 1], ALPHANUMERIC, lower=True)
                n_words = np.diff(found.first)
                begins = found.first[:-1] + GAP * np.arange(hi - lo)
                positions = np.arange(len(found.rows)) + GAP * found.rows
                order = np.argsort(found.hashes.view(np.int64), kind="stable")
                terms, counts = np.unique(found.hashes.view(np.int64), return_counts=True)
                cells = [batch["id"].slice(lo, hi - lo), n_words, begins, terms, counts, positions[order]]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())] + [
                    pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, f.type.value_type))
                    for c, f in zip(cells, list(arrow)[1:])
                ], names=arrow.names)
                shard += 1

    return rows.mapInArrow(run, schema)


class Phrases:
    """Windows of a block of benchmark items as slices of the block's words; distinct windows once."""

    def __init__(self, items: list[tuple], window: int):
        ids, texts = [i for i, _ in items], pa.array([t for _, t in items], pa.string())
        found = words(*bytes_of(texts), ALPHANUMERIC, lower=True)
        self.vocabulary, stream = np.unique(found.hashes.view(np.int64), return_inverse=True)
        self.ids, self.width, self.stream = ids, window, stream.astype(np.int32)
        n_words = np.diff(found.first)
        windows = np.where(n_words > 0, np.maximum(1, n_words - window + 1), 0)
        item = np.repeat(np.arange(len(ids)), windows)
        start = found.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        lens = np.minimum(window, n_words[item])
        rows = np.full((len(item), window), -1, np.int32)
        for j in range(window):
            rows[lens > j, j] = self.stream[start[lens > j] + j]
        _, at, which = np.unique(rows.view(np.dtype((np.void, rows.itemsize * window))).ravel(), return_index=True, return_inverse=True)
        self.start, self.lens = start[at], lens[at]
        pairs = np.unique(which * np.int64(max(1, len(ids))) + item)
        self.pairs = np.stack(np.divmod(pairs, max(1, len(ids))), axis=1)
        self.order = np.tile(np.arange(window, dtype=np.int8), (len(at), 1))

    def rank(self, counts: np.ndarray) -> None:
        """Offsets of each phrase, rarest term first (ties: earlier), by counts of the vocabulary over the whole index."""
        for lo in range(0, len(self.start), STEP):
            own, lens = slice(lo, lo + STEP), self.lens[lo : lo + STEP]
            rarity = np.where(np.arange(self.width) < lens[:, None], counts[self._words(own)], np.iinfo(np.int64).max)
            self.order[own] = np.argsort(rarity, axis=1, kind="stable")

    def _words(self, phrases: slice | np.ndarray) -> np.ndarray:
        """Places in the vocabulary of the phrases' words; beyond a phrase's end they mean nothing."""
        return self.stream[(self.start[phrases][:, None] + np.arange(self.width)).clip(max=len(self.stream) - 1)]

    def matches(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every match in a shard."""
        if not len(self.lens) or not len(terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        begin = np.cumsum(counts) - counts
        span = np.int64(int(positions.max()) + 2 * GAP + 2 * self.width)
        found = np.searchsorted(terms, self.vocabulary).clip(0, len(terms) - 1)
        missing = np.concatenate(([0], np.cumsum((terms[found] != self.vocabulary)[self.stream])))
        # only phrases whose words the shard has
        own = np.flatnonzero(missing[self.start + self.lens] == missing[self.start])
        at, order, lens = found[self._words(own)], self.order[own], self.lens[own]
        each = np.arange(len(own))
        rarest = at[each, order[:, 0]]
        size = counts[rarest]
        phrase = np.repeat(each, size)
        within = np.arange(len(phrase)) - np.repeat(np.cumsum(size) - size, size)
        start = positions[begin[rarest[phrase]] + within].astype(np.int64) - order[phrase, 0]
        keys = np.repeat(np.arange(len(terms), dtype=np.int64), counts) * span + positions
        for turn in range(1, self.width):
            if not len(phrase):
                break
            offset = order[phrase, turn]
            due = turn < lens[phrase]
            wanted = at[phrase, offset] * span + start + offset
            place = np.searchsorted(keys, wanted - slop).clip(0, len(keys) - 1)
            hit = (keys[place] >= wanted - slop) & (keys[place] <= wanted + slop)
            phrase, start = phrase[hit | ~due], start[hit | ~due]
        return own[phrase], start


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks whose texts have about ``block_bytes`` bytes, each fetched by itself."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for b in range(n):
        yield [(r["id"], r["text"]) for r in items.filter(part == b).select("id", "text").collect()]


def search(index: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Matches of every benchmark phrase of ``window`` words, one row per document of the index.

    (id, n_words, n_hit, items, spans): ``items`` are the ids of items with a match, ``spans`` the merged
    [first word, last word + 1] ranges that matches cover, over all blocks of the benchmark by union. An item
    of fewer words is one phrase; an item without words, or missing text, has none.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be below {GAP}")
    spark = index.sparkSession
    items = pick(benchmark, id=item_id, text=item_text)
    id_type, item_type = index.schema["ids"].dataType.elementType, items.schema["id"].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("id", id_type), T.StructField("n_words", T.LongType()),
        T.StructField("items", T.ArrayType(item_type)), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ])
    arrow = to_arrow_schema(schema)

    def searched(phrases) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Phrases.__new__(Phrases)
            block.__dict__.update(phrases.value)
            for batch in batches:
                for i in range(len(batch)):
                    n_words, begins, terms, counts, positions = (
                        batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("n_words", "begins", "terms", "counts", "positions")
                    )
                    phrase, start = block.matches(terms, counts.astype(np.int64), positions, slop)
                    out_items: list[list] = [[] for _ in n_words]
                    spans: list[list] = [[] for _ in n_words]
                    if len(phrase):
                        lo, hi = start - slop, start + block.lens[phrase] + slop
                        order = np.argsort(lo, kind="stable")
                        doc = np.searchsorted(begins, start, "right") - 1
                        for k in order.tolist():
                            d = int(doc[k])
                            a, b = max(0, int(lo[k] - begins[d])), min(int(n_words[d]), int(hi[k] - begins[d]))
                            if spans[d] and a <= spans[d][-1][1]:
                                spans[d][-1][1] = max(b, spans[d][-1][1])
                            else:
                                spans[d].append([a, b])
                        hits = np.unique(doc * np.int64(len(block.lens)) + phrase)
                        doc, phrase = np.divmod(hits, len(block.lens))
                        first = np.searchsorted(block.pairs[:, 0], phrase)
                        many = np.searchsorted(block.pairs[:, 0], phrase, "right") - first
                        place = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                        for d, item in zip(*np.divmod(np.unique(np.repeat(doc, many) * np.int64(len(block.ids)) + block.pairs[place, 1]), len(block.ids))):
                            out_items[d].append(item)
                    named = [[block.ids[x] for x in own] for own in out_items]
                    shard = pa.array([batch["shard"][i].as_py()] * len(n_words), pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        shard, pa.array(range(len(n_words)), pa.int32()), batch["ids"][i].values, pa.array(n_words, pa.int64()), pa.array(named, arrow.field("items").type),
                        pa.array(spans, arrow.field("spans").type),
                    ], names=arrow.names)

        return index.mapInArrow(run, schema)

    parts = []
    for block in _blocks(items, BLOCK_BYTES):
        phrases = Phrases(block, window)
        shared = spark.sparkContext.broadcast(phrases.vocabulary)  # bounded by BLOCK_BYTES
        phrases.rank(_term_counts(index, shared))
        parts.append(searched(spark.sparkContext.broadcast(vars(phrases))))
    if len(parts) == 1:
        return parts[0].select("id", "n_words", F.array_distinct("items").alias("items"), "spans", _covered("spans").alias("n_hit"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # a document is a place in its shard; blocks of the benchmark are folded, one row for each
    numbered = every.groupBy("shard", "row", "id", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    return numbered.select("id", "n_words", "items", "spans", _covered("spans").alias("n_hit"))


def _covered(spans: str):
    """Words that sorted, perhaps overlapping spans cover."""
    step = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s[1] - F.greatest(acc["end"], s[0]))).alias("n"), F.greatest(acc["end"], s[1]).alias("end")
        ),
    )
    return step["n"]


def _term_counts(index: DataFrame, vocabulary) -> np.ndarray:
    """Occurrences, over the whole index, of the terms of one block of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = vocabulary.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                terms, counts = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("terms", "counts"))
                if len(terms) and len(wanted):
                    at = np.searchsorted(terms, wanted).clip(0, len(terms) - 1)
                    total += np.where(terms[at] == wanted, counts[at], 0)
        seen = np.flatnonzero(total)
        for lo in range(0, len(seen), STEP):
            yield pa.RecordBatch.from_arrays([pa.array(seen[lo : lo + STEP]), pa.array(total[seen[lo : lo + STEP]])], names=["place", "n"])

    partial = index.select("terms", "counts").mapInArrow(run, "place long, n long")
    found = partial.groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # two numbers a term of the block
    out = np.zeros(len(vocabulary.value), np.int64)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Builds and stores the index, then searches it: ``search``'s rows with the id column's own name."""
    return search(cut(build_index(docs, id_col, text_col), ROW_GROUPS), benchmark, window, slop).withColumnRenamed("id", id_col)

