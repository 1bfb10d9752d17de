"""Exact, linearly interpolated quantiles per group, at any group size.

Small groups use the built-in ``percentile``. For a hot group the wanted rank is bracketed
by a mergeable sketch and re-counted exactly until few enough values remain to be ranked;
each pass is a map-side aggregate, so no task holds the group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.ordered import PROBE, hot_groups, same_keys, split_hot
from formline.session import cut, scale_policy

_GRID = 256
_ACCURACY = 4096


def group_quantiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], fractions: Sequence[float],
    hot: DataFrame | str | None = PROBE,
) -> DataFrame:
    """One row per group (one row in all without keys) with ``<column>__q`` = array of quantiles.

    NULL values are ignored; a column without values gives NULL.
    """
    keyed = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    group = list(keys)
    if not group:
        keyed, group = keyed.withColumn("__all", F.lit(1)), ["__all"]
    hot = hot_groups(keyed, group, hot)
    wanted = F.array(*[F.lit(float(p)) for p in fractions])

    def plain(frame: DataFrame, by: Sequence[str]) -> DataFrame:
        return frame.groupBy(*by).agg(*[F.percentile(c, wanted).alias(f"{c}__q") for c in columns])

    if hot is None:
        return plain(keyed, keys)
    big, small = split_hot(keyed, group, hot)
    long = big.unpivot(group, list(columns), "__column", "__value").filter(F.col("__value").isNotNull())
    ranked = _refine(long, [*group, "__column"], fractions)
    wide = ranked.groupBy(*group).pivot("__column", list(columns)).agg(F.first("__q"))
    wide = wide.select(*group, *[F.col(f"`{c}`").alias(f"{c}__q") for c in columns])
    out = plain(small, group).unionByName(wide)
    return out if keys else out.drop("__all")


def global_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> dict[str, list | None]:
    """Quantiles of whole columns as driver scalars (one row is fetched)."""
    row = group_quantiles(df, [], columns, fractions).first()
    return {c: (row[f"{c}__q"] if row is not None else None) for c in columns}


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of ``right``, bounded by the number of hot groups, on null-safe keys."""
    names = [(k, f"__r_{i}") for i, k in enumerate(keys)]
    renamed = right
    for k, alias in names:
        renamed = renamed.withColumnRenamed(k, alias)
    return left.join(F.broadcast(renamed), same_keys(left, renamed, names)).drop(*[alias for _, alias in names])


def _refine(rows: DataFrame, keys: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Quantile arrays (``__q``) of hot groups given as (keys, ``__value``) rows without NULLs."""
    limit = scale_policy(rows.sparkSession).group_rows
    value, by = F.col("__value"), [*keys, "__i"]
    inside = (value >= F.col("__lo")) & (value <= F.col("__hi"))
    columns = [*by, "__rank", "__part", "__lo", "__hi", "__below", "__inside"]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(fractions)])
    spans = rows.groupBy(*keys).agg(
        F.count("__value").alias("__inside"), F.min("__value").alias("__lo"), F.max("__value").alias("__hi")
    )
    at = F.col("__w.p") * (F.col("__inside") - 1)
    state = cut(
        spans.withColumn("__w", F.explode(wanted))
        .withColumns({"__i": F.col("__w.i"), "__rank": F.floor(at) + 1, "__part": at - F.floor(at)})
        .withColumn("__below", F.lit(0).cast("long"))
        .select(*columns)
    )
    grid = F.array(*[F.lit(i / _GRID) for i in range(_GRID + 1)])
    cell = (F.col("__rank") - F.col("__below")) / F.col("__inside") * _GRID
    low = F.greatest(F.floor(cell) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil(cell) + 2, F.lit(_GRID)).cast("int")
    wide = (F.col("__inside") > limit) & (F.col("__lo") < F.col("__hi"))
    while True:
        unsettled = state.filter(wide)
        size = unsettled.agg(F.sum("__inside")).first()[0]
        if size is None:
            break
        sketch = (
            _on(rows, unsettled, keys).filter(inside).groupBy(*by)
            .agg(F.percentile_approx("__value", grid, _ACCURACY).alias("__g"))
        )
        narrowed = cut(
            _on(unsettled, sketch, by).select(
                *by, "__rank", "__part",
                F.when(low > 0, F.element_at("__g", low + 1)).otherwise(F.col("__lo")).alias("__lo"),
                F.when(high < _GRID, F.element_at("__g", high + 1)).otherwise(F.col("__hi")).alias("__hi"),
            )
        )
        counted = (
            _on(rows, narrowed, keys).groupBy(*by)
            .agg(F.count_if(value < F.col("__lo")).alias("__below"), F.count_if(inside).alias("__inside"))
        )
        fresh = _on(narrowed, counted, by).select(*columns)
        state = cut(state.filter(~wide).unionByName(fresh))
        left = state.filter(wide).agg(F.sum("__inside")).first()[0]
        if left is not None and left >= size:
            break  # heavy ties: the bracket cannot shrink further, and ties collapse when ranked
    upto = Window.partitionBy(*by).orderBy("__value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_least = [F.min(F.when(F.col("__cum") >= F.col("__rank") - F.col("__below") + k, value)) for k in (0, 1)]
    picked = (
        _on(rows, state, keys).filter(inside)
        .groupBy(*by, "__value", "__rank", "__part", "__below").agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__cum", F.sum("__c").over(upto))
        .groupBy(*by, "__part").agg(at_least[0].alias("__a"), at_least[1].alias("__b"))
    )
    between = F.col("__a") + F.col("__part") * (F.coalesce("__b", "__a") - F.col("__a"))
    pairs = F.array_sort(F.collect_list(F.struct("__i", between.alias("q"))))
    return picked.groupBy(*keys).agg(F.transform(pairs, lambda x: x["q"]).alias("__q"))
