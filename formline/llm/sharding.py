"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered in the order of id and text; the permutation sends number i of n to a place below n.
Shard and slot of a place are its remainder and quotient, so both can be computed from the number alone
and shard sizes differ by one row at most. Walking a cycle of the permutation of the next larger square
domain until a place below n comes up keeps it a permutation of exactly n rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import quoted
from formline.session import cut

ROUNDS = 6


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of ``numbers`` (each below ``n``) under the keyed permutation of 0 .. n-1."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, ROUNDS, dtype=np.uint64)
    out = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in keys:
            mixed = (right + key) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[Column], number: str = "row_number", total: str = "n_rows") -> DataFrame:
    """Global row numbers from 0 in ``order``, and the number of rows; equal rows take any order.

    Rows are range-partitioned and written once; the only thing that meets in one task is a count per
    partition.
    """
    index = F.monotonically_increasing_id()
    placed = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__part", F.shiftright(index, 33)).withColumn("__at", index.bitwiseAND((1 << 33) - 1))
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows")).select(
        F.col("__part").alias("__p"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
        F.sum("__rows").over(Window.partitionBy(F.lit(1))).alias(total),
    )
    joined = placed.join(F.broadcast(counts), F.col("__part") == F.col("__p"))  # one row for each partition
    return joined.withColumn(number, F.col("__at") + F.col("__before")).drop("__part", "__at", "__p", "__before")


def shard(
    docs: DataFrame, shards: int, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """Place of every row: id, size, text_crc32, shard and slot.

    ``size`` is the text's UTF-8 bytes plus ``overhead``; a missing text has no bytes. Rows with a missing
    id come first. Repeated rows get places of their own; an empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    raw = F.coalesce(quoted(text_col).cast("binary"), F.lit(b""))
    light = docs.select(
        quoted(id_col).alias("id"), (F.octet_length(raw) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    numbered = number_rows(light, [F.col("id").asc_nulls_first(), F.col("text_crc32"), F.col("size")])

    @F.pandas_udf("long")
    def place(number: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), int(n.iloc[0]), seed) if len(n) else number)

    return numbered.withColumn("place", place("row_number", "n_rows")).select(
        F.col("id").alias(id_col), "size", "text_crc32", (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"), "row_number",
    )
