"""Jaccard similarity join over word n-grams by rare-first prefix filtering.

A document's set is its distinct n-gram hashes; documents of equal sets are one item. N-grams are ordered by
their frequency class, from a frequency table of fixed size that counts all n-grams of all documents, then by
hash. Two sets can only reach the threshold if they share one of the first few n-grams in that order, so items
meet on these prefix n-grams. The length filter and the positional filter drop pairs before they are paired
up; what is left is verified once a pair on the texts, after a suffix filter that bounds the overlap by counts
in ranges of the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from formline.llm.common import quoted
from formline.llm.linking import components, linked_groups
from formline.llm.tokens import NOT_SPACE, bytes_of, grams, mixed, slices, words
from formline.session import cut

#: Cells of the frequency table (a byte each), and slices it is summed in. More cells tell frequencies apart in
#: larger corpora; they only decide how many items meet, never the result.
TABLE_BITS, TABLE_SLICES = 26, 256
#: Ids up to which a set of ids is broadcast (8 bytes each); above, the join shuffles.
BROADCAST_IDS = 1 << 20
#: Hash ranges of the suffix filter, as bits.
SUFFIX_BITS = 4


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words has its whole sequence, one without words none."""
    data, bounds = bytes_of(column)
    for lo, hi in slices(bounds):
        found = words(data, bounds[lo : hi + 1], NOT_SPACE, lower=True)
        whole, _ = grams(found.hashes, found.rows, n)
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
            if b - a >= n:
                yield np.unique(whole[a : b - n + 1])
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for w in found.hashes[a:b]:
                    h = h * np.uint64(0x9E3779B97F4A7C15) + w
                yield mixed(h)
            else:
                yield np.empty(0, np.uint64)


def _item(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        h = mixed(np.array([mixed(shingles + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(shingles))]))
    return int(h.view(np.int64)[0])


def _describe(rows: DataFrame, n: int, id_type: T.DataType) -> tuple[DataFrame, bytes]:
    """(id, row, size, item) of every document, and the compressed frequency class of each cell of the table."""
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("row", T.LongType()), T.StructField("size", T.LongType()),
        T.StructField("item", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, np.uint8)  # counts up to 255 for each task
        for batch in batches:
            sizes, items = [], []
            for s in shingle_sets(batch["text"], n):
                cell = (s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                now = table[cell]
                table[cell] = now + (now < 255)
                sizes.append(len(s))
                items.append(_item(s) if len(s) else None)
            nothing = pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["row"], pa.array(sizes, pa.int64()), pa.array(items, pa.int64()), *nothing], schema=arrow)
        for part, cells in enumerate(np.split(table, TABLE_SLICES)):
            if cells.any():
                yield pa.RecordBatch.from_pylist([{"part": part, "counts": zstandard.compress(cells.tobytes(), 1)}], schema=arrow)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros((1 << TABLE_BITS) // TABLE_SLICES, np.int64)
        for blob in group["counts"].to_pylist():
            total += np.frombuffer(zstandard.decompress(blob), np.uint8)
        classes = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table({"part": group["part"].slice(0, 1), "classes": pa.array([zstandard.compress(classes.tobytes(), 1)], pa.binary())})

    found = cut(rows.mapInArrow(run, schema))
    summed = found.filter("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, classes binary")
    classes = np.zeros((TABLE_SLICES, (1 << TABLE_BITS) // TABLE_SLICES), np.uint8)
    for r in summed.collect():  # the table has a fixed size
        classes[r["part"]] = np.frombuffer(zstandard.decompress(r["classes"]), np.uint8)
    return found.filter("part is null").select("id", "row", "size", "item"), zstandard.compress(classes.tobytes(), 1)


def prefix_rows(rows: DataFrame, classes: bytes, n: int, percent: int) -> DataFrame:
    """(key, id, size, place) of the prefix n-grams of every distinct set of each task."""
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        order_of = np.frombuffer(zstandard.decompress(shared.value), np.uint8)
        for batch in batches:
            keys, ids, sizes, places = [], [], [], []
            for s in shingle_sets(batch["text"], n):
                item = _item(s) if len(s) else 0
                if not len(s) or item in seen:
                    continue
                seen.add(item)
                prefix = len(s) - (percent * len(s) + 99) // 100 + 1
                order = np.lexsort((s, order_of[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]))[:prefix]
                keys.append(s[order])
                ids.append(np.full(prefix, item))
                sizes.append(np.full(prefix, len(s)))
                places.append(np.arange(prefix))
            if keys:
                cells = [np.concatenate(keys).view(np.int64), *(np.concatenate(x).astype(np.int64) for x in (ids, sizes, places))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["key", "id", "size", "place"])

    return rows.select("text").mapInArrow(run, "key long, id long, size long, place long")


def _may_link(percent: int):
    def condition(a: str, b: str) -> Column:
        x, y, i, j = (F.col(f"{side}{c}") for c in ("size", "place") for side in (a, b))
        needed = F.ceil(percent * (x + y) / F.lit(100.0 + percent) - 1e-9)
        long_enough = 100 * F.least(x, y) >= percent * F.greatest(x, y)
        return long_enough & (1 + F.least(x - i - 1, y - j - 1) >= needed)

    return condition


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets, behind the suffix filter."""
    needed = -(-percent * (len(a) + len(b)) // (100 + percent))
    if min(len(a), len(b)) < needed:
        return False
    ranges = [np.bincount((s >> np.uint64(64 - SUFFIX_BITS)).astype(np.int64), minlength=1 << SUFFIX_BITS) for s in (a, b)]
    if np.minimum(*ranges).sum() < needed:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, rows: DataFrame, places: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs of items whose sets reach the threshold; only texts of items in ``pairs`` are moved."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct().join(places, "item"))
    chosen = wanted.select("row")
    chosen = F.broadcast(chosen) if wanted.count() <= BROADCAST_IDS else chosen
    texts = rows.join(chosen, "row", "left_semi").select("row", "text").join(wanted, "row").select("item", "text").dropDuplicates(["item"])
    texts = cut(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = shingle_sets(batch["text_a"], n), shingle_sets(batch["text_b"], n)
            linked = [similar(x, y, percent) for x, y in zip(left, right)]
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    with_a = pairs.join(texts.select(F.col("item").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("item").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, row, n_shingles, component_id, kept) of every row: the smallest id that links reach.

    Two texts link when 100 * common >= ``percent`` * union of their n-gram sets. A missing or empty text has no
    n-gram and links with nothing; its component is its own id. Repeated rows link as equal texts do. A missing
    id belongs to its group but is never the smallest. ``row`` is a hash of id and text, the same for rows that
    repeat; ``kept`` marks the row of a group that has the smallest id, or, among equal ids, the smallest hash.
    """
    rows = docs.select(quoted(id_col).alias("id"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("row"), quoted(text_col).alias("text"))
    described, classes = _describe(rows, n, docs.schema[id_col].dataType)
    items = described.filter("item is not null")
    places = items.groupBy("item").agg(F.min("row").alias("row"))
    links = linked_groups(
        prefix_rows(rows, classes, n, percent), ["size", "place"], _may_link(percent),
        lambda pairs: _verified(pairs, rows, places, n, percent),
    )
    group = components(links).withColumnRenamed("id", "item")
    head = F.min(F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("row").alias("row")))
    named = cut(items.groupBy("item").agg(head.alias("head")).join(group, "item", "left").withColumn("component", F.coalesce("component", "item")))
    heads = named.groupBy("component").agg(F.min("head").alias("head"))
    of_item = named.select("item", "component").join(heads, "component").select("item", "head")
    return described.join(of_item, "item", "left").select(
        F.col("id").alias(id_col), "row", F.col("size").alias("n_shingles"), F.coalesce("head.id", "id").alias("component_id"),
        F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("kept"),
    )
