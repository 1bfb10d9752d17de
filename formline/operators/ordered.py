"""Windows over ordered histories that survive hot groups.

A group small enough for one task is handled by an ordinary window: one exchange and one
sort per (keys, order). A hot group is laid out by range over its order, numbered exactly,
cut into equal chunks, and each chunk borrows the neighbouring rows its frames reach for.
Running totals add the totals of earlier chunks. No task ever holds a whole hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from formline.session import cut, plan_bytes, scale_policy

_BLOCK, _POS, _CHUNK, _TARGET, _ROWS = "__fl_block", "__fl_pos", "__fl_chunk", "__fl_target", "__fl_rows"

PROBE = "probe"  # look for hot groups; callers that know them pass a table or None

RUNNING = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Frames:
    """Columns to compute over an ordered history.

    bounded: functions of the ordered window; their row frames lie within [-back, ahead].
    running: (kind, column) from the first row to the current one; kind in RUNNING.
    suffix:  the same from the current row to the last one.
    whole:   aggregates of the whole group.
    """

    bounded: Mapping[str, Callable[[WindowSpec], Column]] = field(default_factory=dict)
    back: int = 0
    ahead: int = 0
    running: Mapping[str, tuple[str, Column]] = field(default_factory=dict)
    suffix: Mapping[str, tuple[str, Column]] = field(default_factory=dict)
    whole: Mapping[str, Column] = field(default_factory=dict)


def same_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality over key pairs: a NULL key is a group of its own."""
    return reduce(lambda a, b: a & b, (left[l].eqNullSafe(right[r]) for l, r in pairs))


def hot_groups(df: DataFrame, keys: Sequence[str], known: DataFrame | str | None = PROBE) -> DataFrame | None:
    """Groups with more rows than one task should take, with their row counts, or None.

    At most ``rows / group_rows`` groups can qualify, so the result is safe to broadcast.
    Which groups are treated as hot affects speed only, never results.
    """
    if not isinstance(known, str):
        return known
    policy = scale_policy(df.sparkSession)
    if plan_bytes(df) < policy.probe_bytes:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(_ROWS))
    hot = cut(counts.filter(F.col(_ROWS) > policy.group_rows))
    return None if hot.isEmpty() else hot


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of hot groups, all other rows)."""
    names = [(k, f"__hot_{i}") for i, k in enumerate(keys)]
    small = F.broadcast(hot.select(*[F.col(k).alias(h) for k, h in names]))
    match = same_keys(df, small, names)
    return df.join(small, match, "left_semi"), df.join(small, match, "left_anti")


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join a proven-small per-group table by null-safe keys."""
    names = [(k, f"__key_{i}") for i, k in enumerate(keys)]
    right = small
    for k, alias in names:
        right = right.withColumnRenamed(k, alias)
    joined = df.join(F.broadcast(right), same_keys(df, right, names), "left")
    return joined.drop(*[alias for _, alias in names])


def over_history(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], frames: Frames,
    hot: DataFrame | str | None = PROBE,
) -> DataFrame:
    """Add the columns of ``frames`` to every row; ``order`` must be total within a group.

    ``order`` may be empty when only whole-group columns are asked for.
    """
    hot = hot_groups(df, keys, hot)
    if hot is None:
        return _plain(df, keys, order, frames)
    big, small = split_hot(df, keys, hot)
    if not (frames.bounded or frames.running or frames.suffix):
        whole = big.groupBy(*keys).agg(*[agg.alias(name) for name, agg in frames.whole.items()])
        return _plain(small, keys, order, frames).unionByName(_attach(big, whole, keys))
    placed = _number(big, keys, order, hot)
    return _plain(small, keys, order, frames).unionByName(_chunked(placed, keys, frames))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """1-based position of each row in its group; ``keys`` may be empty (global position)."""
    if keys:
        return over_history(df, keys, order, Frames(running={name: ("count", F.lit(1))}))
    tagged = over_history(
        df.withColumn("__all", F.lit(1)), ["__all"], order, Frames(running={name: ("count", F.lit(1))})
    )
    return tagged.drop("__all")


def _plain(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], frames: Frames) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = {name: make(window) for name, make in frames.bounded.items()}
    out |= {name: RUNNING[kind](col).over(upto) for name, (kind, col) in frames.running.items()}
    out |= {name: RUNNING[kind](col).over(onward) for name, (kind, col) in frames.suffix.items()}
    out |= {name: agg.over(Window.partitionBy(*keys)) for name, agg in frames.whole.items()}
    return df.withColumns(out) if out else df


def _number(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], hot: DataFrame) -> DataFrame:
    """Exact row numbers for hot groups from range-partitioned blocks."""
    policy = scale_policy(df.sparkSession)
    total = hot.agg(F.sum(_ROWS)).first()[0]
    parts = max(2, -(-int(total) * 2 // policy.group_rows))
    placed = cut(df.repartitionByRange(parts, *keys, *order).withColumn(_BLOCK, F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, _BLOCK)
        .agg(F.count(F.lit(1)).alias(_ROWS))
        .withColumn("__fl_offset", F.coalesce(F.sum(_ROWS).over(earlier), F.lit(0)))
        .drop(_ROWS)
    )
    in_block = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    return (
        _attach(placed, offsets, [*keys, _BLOCK])
        .withColumn(_POS, F.col("__fl_offset") + F.row_number().over(in_block) - 1)
        .drop("__fl_offset", _BLOCK)
    )


def _chunked(placed: DataFrame, keys: Sequence[str], frames: Frames) -> DataFrame:
    policy = scale_policy(placed.sparkSession)
    size = max(policy.group_rows, 4 * (frames.back + frames.ahead + 1))
    slot = F.col(_POS) % size
    chunk = F.col(_CHUNK)
    base = placed.withColumn(_CHUNK, F.floor(F.col(_POS) / size))
    targets = [chunk]
    if frames.back:
        targets.append(F.when(slot >= size - frames.back, chunk + 1))
    if frames.ahead:
        targets.append(F.when((slot < frames.ahead) & (chunk > 0), chunk - 1))
    copies = base.withColumn(_TARGET, F.explode(F.filter(F.array(*targets), lambda t: t.isNotNull())))
    own = F.col(_TARGET) == chunk

    window = Window.partitionBy(*keys, _TARGET).orderBy(_POS)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = {name: make(window) for name, make in frames.bounded.items()}
    out |= {n: RUNNING[k](F.when(own, c)).over(upto) for n, (k, c) in frames.running.items()}
    out |= {n: RUNNING[k](F.when(own, c)).over(onward) for n, (k, c) in frames.suffix.items()}
    result = copies.withColumns(out).filter(own).drop(_TARGET, _POS) if out else base.drop(_POS)

    totals = {**frames.running, **{f"__fl_s_{n}": spec for n, spec in frames.suffix.items()}}
    if totals:
        result = _carry(result, base, keys, frames, totals)
    if frames.whole:
        whole = base.groupBy(*keys).agg(*[agg.alias(name) for name, agg in frames.whole.items()])
        result = _attach(result, whole, keys)
    return result.drop(_CHUNK)


def _carry(result: DataFrame, base: DataFrame, keys: Sequence[str], frames: Frames, totals: Mapping) -> DataFrame:
    """Fold the totals of the other chunks (one row per chunk of a hot group) into each row."""
    merge = {"sum": lambda a, b: F.coalesce(a + b, a, b), "min": F.least, "max": F.greatest}
    per_chunk = base.groupBy(*keys, _CHUNK).agg(*[RUNNING[k](c).alias(f"__fl_t_{n}") for n, (k, c) in totals.items()])
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(1, Window.unboundedFollowing)
    carried = {}
    for name, (kind, _) in totals.items():
        fold = F.sum if kind in ("sum", "count") else RUNNING[kind]
        frame = after if name.startswith("__fl_s_") else before
        carried[f"__fl_c_{name}"] = fold(f"__fl_t_{name}").over(frame)
    small = per_chunk.withColumns(carried).select(*keys, _CHUNK, *carried)
    joined = _attach(result, small, [*keys, _CHUNK])
    for name, (kind, _) in totals.items():
        target = name.removeprefix("__fl_s_")
        combine = merge["sum"] if kind in ("sum", "count") else merge[kind]
        joined = joined.withColumn(target, combine(F.col(target), F.col(f"__fl_c_{name}")))
    return joined.drop(*carried)
