"""Latest, best and first rows. ``row_number <= n`` lets Spark trim each group to n rows
before the shuffle, so a hot group costs no more than a cold one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.ordered import positions

_GROUP_LIMIT = 1000  # Spark trims groups before the shuffle up to this many rows


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """First n rows of each group in a total order."""
    if n >= _GROUP_LIMIT:
        return positions(df, keys, order, "__rn").filter(F.col("__rn") <= n).drop("__rn")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")


def dedup_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in an explicit order."""
    return first_rows(df, keys, order, 1)


def tail_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return first_rows(df, keys, [F.col(c).desc() for c in order], n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return tail_per_key(df, keys, order, 1)


def _by_metric(metric: str, ascending: bool, ties: Sequence[str]) -> list[Column]:
    lead = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return [lead, *[F.col(t).asc() for t in ties]]


def top_n_per_group(
    df: DataFrame, by: Sequence[str], metric: str, n: int, ties: Sequence[str], ascending: bool = False
) -> DataFrame:
    return first_rows(df, by, _by_metric(metric, ascending, ties), n)


def best_per_group(
    df: DataFrame, by: Sequence[str], metric: str, ties: Sequence[str], ascending: bool = True
) -> DataFrame:
    return top_n_per_group(df, by, metric, 1, ties, ascending)


def top_n(df: DataFrame, metric: str, n: int, ties: Sequence[str], ascending: bool = False) -> DataFrame:
    return df.orderBy(*_by_metric(metric, ascending, ties)).limit(n)


def sample_rows(df: DataFrame, max_rows: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows, the same ones however the data is partitioned."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(max_rows)
