"""Substring deduplication by repeated-phrase automata.

1. Documents form blocks by ranges of their id. Every window of ``window`` words is hashed, each block's
   distinct hashes are shuffled by hash range, and a range confirms for each block which of its windows also
   occur in an earlier block.
2. Confirmed windows go back to their blocks. Runs of them, and of windows that earlier documents of the block
   have, are its recurring passages. A block compiles them into Aho-Corasick automata over word symbols, in shards
   of a bounded size, and streams all its documents through each to locate every occurrence that an earlier
   document owns.

A block holds a bounded number of bytes (a longer document alone), so automata stay small however many phrases
the corpus repeats; a phrase that is in every document costs one hash per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from formline.llm.common import pick, pieces
from formline.llm.tokens import NOT_SPACE, bytes_of, grams, slices, words

#: Stored bytes of the documents of a block. The first id of each block is held by the driver.
BLOCK_BYTES = 2 << 20
#: Stored bytes of documents per hash range.
RANGE_BYTES = 8 << 20
#: Words of the passages of one automaton, a longer passage aside.
SHARD_WORDS = 500_000
#: Window hashes that a task holds before it passes them on.
HELD = 4_000_000


def _pack(hashes: np.ndarray) -> bytes:
    """Sorted 64-bit hashes as compressed byte planes of their differences."""
    steps = np.diff(hashes, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def locate(
    texts: list[tuple[np.ndarray, int]], begins: np.ndarray, lens: np.ndarray, owners: np.ndarray, symbols: np.ndarray
) -> list[np.ndarray]:
    """Covered words of each text by occurrences of passages that an earlier text owns.

    texts: (word symbols, rank) each; passage p is ``lens[p]`` symbols from ``begins[p]`` on in ``symbols``, all of
    whose windows texts of rank ``owners[p]`` or less have. A word is written as two letters of alphabets that are
    apart, as an automaton's nodes look their edges up one by one.
    """
    covered = [np.zeros(len(own) + 1, np.int32) for own, _ in texts]
    upto = np.cumsum(lens) - lens
    lo = 0
    while lo < len(begins):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + SHARD_WORDS)))
        within = np.repeat(begins[lo:hi] - (upto[lo:hi] - upto[lo]), lens[lo:hi]) + np.arange(int(lens[lo:hi].sum()))
        used = np.unique(symbols[within])
        base = int(len(used) ** 0.5) + 1
        letters = np.ones((int(symbols.max()) + 1, 2), "<u2")  # 1 stands for all words of no passage
        letters[used, 0], letters[used, 1] = 2 + np.arange(len(used)) // base, 3 + base + np.arange(len(used)) % base
        machine = ahocorasick.Automaton()
        for a, n, owner in zip(begins[lo:hi].tolist(), lens[lo:hi].tolist(), owners[lo:hi].tolist()):
            passage = letters[symbols[a : a + n]].tobytes().decode("utf-16-le")
            known = machine.get(passage, None)
            if known is None or owner < known[1]:
                machine.add_word(passage, (n, owner))
        machine.make_automaton()
        for (own, rank), marks in zip(texts, covered):
            if len(own):
                for end, (n, owner) in machine.iter(letters[own].tobytes().decode("utf-16-le")):
                    if owner < rank:
                        marks[end // 2 - n + 1] += 1
                        marks[end // 2 + 1] -= 1
        lo = hi
    return [np.cumsum(marks[:-1]) > 0 for marks in covered]


def _first_ids(ids: DataFrame, blocks: int) -> np.ndarray:
    """First id of each block but the first: one number for each ``BLOCK_BYTES`` of input."""
    ranged = ids.filter("id is not null").repartitionByRange(blocks, "id").select("id", F.spark_partition_id().alias("block"))
    starts = sorted(r["first"] for r in ranged.groupBy("block").agg(F.min("id").alias("first")).collect())
    return np.array(starts[1:], np.int64)


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, n_words, n_removed): each text without the words of windows that a smaller id has.

    Words are runs of anything but white space; what is kept is joined by one space. Windows are judged on the
    input. A missing or empty text has no words. Rows with a missing id keep all words and own nothing; rows
    that repeat an id don't count as earlier than each other. Ids are integers.
    """
    rows = pick(docs, id=id_col, text=text_col)
    firsts = _first_ids(rows.select("id"), pieces(docs, BLOCK_BYTES))
    ranges = 1 << (pieces(docs, RANGE_BYTES) - 1).bit_length()
    top = np.uint64(64 - (ranges.bit_length() - 1))
    spark = docs.sparkSession
    limits = spark.sparkContext.broadcast(firsts)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                h = np.unique(np.concatenate(parts))
                cuts = np.searchsorted(h >> top, np.arange(ranges + 1, dtype=np.uint64))
                out = [(b, block, _pack(h[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["part", "block", "hashes"])

        for batch in batches:
            valid = batch["id"].is_valid().to_numpy(zero_copy_only=False)
            block = np.searchsorted(limits.value, batch["id"].fill_null(0).to_numpy(zero_copy_only=False), "right")
            data, bounds = bytes_of(batch["text"])
            for lo, hi in slices(bounds):
                found = words(data, bounds[lo : hi + 1], NOT_SPACE, lower=False)
                h, whole = grams(found.hashes, found.rows, window)
                row = found.rows[: len(h)] + lo
                whole = whole & valid[row]
                h, of = h[whole], block[row[whole]]
                for b in np.unique(of).tolist():
                    held.setdefault(b, []).append(h[of == b])
                size += len(h)
            if size > HELD:
                yield from flush()
                held, size = {}, 0
        if held:
            yield from flush()

    def confirm(group: pa.Table) -> pa.Table:
        """For each block its windows of this range that an earlier block has."""
        order = np.argsort(group["block"].to_numpy(), kind="stable")
        blocks, blobs = group["block"].to_numpy()[order], group["hashes"].to_pylist()
        parts = [_unpack(blobs[i]) for i in order.tolist()]
        h, of = np.concatenate(parts), np.repeat(blocks, [len(p) for p in parts])
        by = np.argsort(h, kind="stable")
        h, of = h[by], of[by]
        begins = np.concatenate(([True], h[1:] != h[:-1]))
        first = of[np.maximum.accumulate(np.where(begins, np.arange(len(h)), 0))]
        h, of = h[of > first], of[of > first]
        names, at = np.unique(of, return_inverse=True)
        out = [_pack(np.unique(h[at == i])) for i in range(len(names))]
        return pa.table({"block": pa.array(names, pa.int64()), "hashes": pa.array(out, pa.binary())})

    schema = T.StructType([rows.schema["id"], T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    arrow = to_arrow_schema(schema)

    def stream(own: pa.Table, confirmed: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        if not len(own):
            return arrow.empty_table()
        column = own["text"].chunk(0)
        known = np.unique(np.concatenate([_unpack(b) for b in confirmed["hashes"].to_pylist()] or [np.empty(0, np.uint64)]))
        ids = own["id"].chunk(0)
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        _, rank = np.unique(ids.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
        rank = np.where(valid, rank, -2)
        data, bounds = bytes_of(column)
        hashes, first = [], [0]
        for lo, hi in slices(bounds):
            found = words(data, bounds[lo : hi + 1], NOT_SPACE, lower=False)
            hashes.append(found.hashes)
            first += (found.first[1:] + first[-1]).tolist()
        every = np.concatenate(hashes)
        first = np.array(first)
        row = np.repeat(np.arange(len(own)), np.diff(first))
        h, same = grams(every, row, window)
        at = np.flatnonzero(same & valid[row[: len(h)]])
        h, of = h[at], rank[row[at]]
        distinct, group = np.unique(h, return_inverse=True)
        low = np.full(len(distinct), 1 << 60)
        np.minimum.at(low, group, of)
        owner = np.where(np.isin(distinct, known, assume_unique=True), -1, low)[group]
        repeated = np.flatnonzero(owner < of)
        covered = [np.zeros(n, bool) for n in np.diff(first).tolist()]
        if len(repeated):  # passages: longest runs of windows of one document that an earlier one has
            place, owner = at[repeated], owner[repeated]
            begins = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 1) | (np.diff(row[place]) != 0))))
            lens = np.diff(np.concatenate((begins, [len(place)]))) + window - 1
            _, symbols = np.unique(every, return_inverse=True)
            texts = [(symbols[a:b], int(r)) for a, b, r in zip(first[:-1].tolist(), first[1:].tolist(), rank.tolist())]
            covered = locate(texts, place[begins], lens, np.maximum.reduceat(owner, begins), symbols)
        kept, raw = [], data.tobytes()
        for (a, b), marks in zip(zip(bounds[:-1].tolist(), bounds[1:].tolist()), covered):
            kept.append(b" ".join(compress(raw[a:b].split(), (~marks).tolist())))
        return pa.table([
            ids.cast(arrow.field("id").type), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([len(c) for c in covered], pa.int64()),
            pa.array([int(c.sum()) for c in covered], pa.int64()),
        ], schema=arrow)

    @F.pandas_udf("long")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits.value, ids.to_numpy(), "right"))

    confirmed = rows.mapInArrow(windows, "part long, block long, hashes binary").groupBy("part").applyInArrow(confirm, "block long, hashes binary")
    spread = -1 - F.pmod(F.xxhash64("text"), F.lit(64))  # rows without id: no block of ranges
    placed = rows.withColumn("block", F.when(F.col("id").isNull(), spread).otherwise(block_of(F.coalesce(F.col("id"), F.lit(0)).cast("long"))))
    return placed.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(stream, schema).withColumnRenamed("id", id_col)
