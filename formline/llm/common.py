"""Helpers shared by the corpus operators: column picking, sizes and packed binary cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.session import plan_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash with helpers."""
    return df.select(*[quoted(source).alias(name) for name, source in columns.items()])


#: Planner sizes from here on mean that nothing is known about a source.
UNKNOWN_BYTES = 1 << 60


#: Pieces made of any table, however small.
LEAST_PIECES = 64


def pieces(df: DataFrame, each: int) -> int:
    """Number of pieces of about ``each`` bytes by the planner's size; results never depend on it.

    Where the planner knows no size, a few pieces for each partition.
    """
    size = plan_bytes(df)
    return max(LEAST_PIECES, -(-size // each) if size < UNKNOWN_BYTES else 4 * df.rdd.getNumPartitions())


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def remainder(id_column: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % of


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes."""
    raw = np.ascontiguousarray(values, dtype="<u4")
    return zstandard.compress(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").reshape(-1)


def pack_strings(values: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, values), "<u4", len(values))
    return zstandard.compress(np.uint32(len(values)).tobytes() + lens.tobytes() + b"".join(values), 3)


def unpack_strings(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 * (n + 1)
    starts = np.concatenate(([4 * (n + 1)], ends[:-1])) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
