"""Order MinHash fingerprints, sensitive to edit distance.

For each of ``SKETCHES`` hash functions the ``TUPLE`` minimal occurrence-numbered k-mers of a text are taken,
put back into text order, and hashed as a tuple. Two texts agree in an entry when they hold the same k-mers
in the same order, so block moves and edits both lower the share of equal entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from formline.llm.common import pick
from formline.session import cut

#: Code points of a k-mer, a power of two.
KMER = 8
#: Entries of a fingerprint, and hexadecimal digits of one.
SKETCHES, DIGITS = 64, 4
#: Minimal k-mers of one entry.
TUPLE = 2

#: Hash function i of a k-mer is its mixed hash minus rotation i, modulo 2**32: for any set each member is
#: equally likely to be minimal, and one sort serves all functions.
_ROTATIONS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 32, SKETCHES, dtype=np.uint64) << np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def _kmers(points: np.ndarray) -> np.ndarray:
    """Hash of the k-mer at each place; a shorter text is one k-mer, an empty one too."""
    if len(points) < KMER:
        short = np.uint32(len(points))
        for p in points:
            short = (short ^ p) * np.uint32(0x9E3779B1)
        return _mix(np.array([short], np.uint32))
    h, width, factor = _mix(points), 1, 0x01000193
    while width < KMER:  # the hash of 2w points from two of w
        h = h[:-width] * np.uint32(factor) + h[width:]
        factor, width = factor * factor % (1 << 32), 2 * width
    return _mix(h)


def sketch(text: str) -> str:
    """Fingerprint of one text as hexadecimal digits; equal texts have equal ones."""
    with np.errstate(over="ignore"):
        h = _kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"))
        order = np.sort((h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64))
        kmer, at = (order >> np.uint64(32)).astype(np.uint32), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        index = np.arange(len(kmer))
        begins = np.concatenate(([True], kmer[1:] != kmer[:-1]))
        occurrence = index - np.maximum.accumulate(np.where(begins, index, 0))
        x = _mix(kmer + occurrence.astype(np.uint32) * np.uint32(0x85EBCA6B))
        rank = np.sort((x.astype(np.uint64) << np.uint64(32)) | at.astype(np.uint64))
        first = np.searchsorted(rank, _ROTATIONS)  # minimal under x - rotation: the next on the ring
        least = min(TUPLE, len(x))
        places = (rank[(first + np.arange(least)[:, None]) % len(x)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        in_order = np.sort(places, axis=0)
        entry = np.full(SKETCHES, len(x) < TUPLE, np.uint32)
        for row in in_order:
            entry = _mix(entry * np.uint32(0x9E3779B1) + h[row])
    return (entry >> np.uint32(16)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of equal entries of two fingerprints, 0 to 1."""
    x, y = np.frombuffer(bytes.fromhex(a), ">u2"), np.frombuffer(bytes.fromhex(b), ">u2")
    return float((x == y).mean())


def likeness_column(a: Column, b: Column) -> Column:
    """``likeness`` of two fingerprint columns; null where one is missing."""
    same = [(F.substring(a, i * DIGITS + 1, DIGITS) == F.substring(b, i * DIGITS + 1, DIGITS)).cast("int") for i in range(SKETCHES)]
    return sum(same[1:], same[0]) / F.lit(float(SKETCHES))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of every row's whole text; a missing text counts as empty."""
    rows = pick(docs, id=id_col, text=text_col)
    schema = T.StructType([rows.schema["id"], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [sketch(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(prints, pa.string())], names=["id", "fingerprint"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compared(text: str, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    print_ = sketch(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return len(text), digest, own, print_, likeness(own, print_), likeness(own, next_print)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness; likeness to the next document's.

    The next document has the next smaller id (missing ids come last, ties go by the text's hash), and the
    smallest is followed by the largest; a single document is followed by itself. Texts are range-partitioned
    and sorted by id once, so a row's next document is its neighbour; only the first row of each partition
    waits for the last row of the partition before.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    result = [
        T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ]
    done = T.StructType([rows.schema["id"], *result])
    marked = T.StructType([*done.fields, T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())])
    done_arrow, marked_arrow = to_arrow_schema(done), to_arrow_schema(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), None
        waiting = [None] * 6
        for batch in batches:
            out = []
            for key, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                own = before[2] if before and before[1] == text else sketch(text)
                if before is None:
                    out.append((key, *waiting[:2], own, *waiting[:3], "first", part, text))
                else:
                    out.append((key, *_compared(text, own, *before[1:]), "done", part, None))
                before = key, text, own
            yield pa.RecordBatch.from_pylist([dict(zip(marked_arrow.names, r)) for r in out], schema=marked_arrow)
        if before:
            last = (before[0], *waiting[:2], before[2], *waiting[:3], "last", part, before[1])
            yield pa.RecordBatch.from_pylist([dict(zip(marked_arrow.names, last))], schema=marked_arrow)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r["id"], *_compared(r["text"], r["fingerprint"], r["next_text"], r["next_fingerprint"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(done_arrow.names, r)) for r in out], schema=done_arrow)

    found = cut(ordered.mapInArrow(run, marked))
    heads, tails = found.filter("kind = 'first'"), found.filter("kind = 'last'")
    everywhere = Window.partitionBy(F.lit(0))  # a number for each partition, no texts
    turns = heads.select("part").withColumn(
        "before", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(everywhere))
    )
    ends = tails.select(F.col("part").alias("before"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    waiting = heads.select("id", "text", "fingerprint", "part").join(turns, "part").join(ends, "before")
    finished = waiting.select("id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(finish, done)
    return found.filter("kind = 'done'").select(*done.names).unionByName(finished).withColumnRenamed("id", id_col)
