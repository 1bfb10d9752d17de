"""Median fills, standardisation and sequence scaling with fitted statistics kept in the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.scalars import number
from formline.operators.frames import missing_flags
from formline.operators.joins import join_same
from formline.operators.ordered import hot_groups
from formline.operators.preprocess import TabularPreprocessor
from formline.operators.quantiles import global_quantiles, group_quantiles
from formline.session import cut


def fill_median(df: DataFrame, columns: Sequence[str], fit_where: Column | None = None) -> DataFrame:
    """NULL <- median of the fitting rows (all rows by default), 0 when nothing was observed.

    The medians, one row, are fetched and used as constants; one aggregate finds the columns that have gaps, and
    only these get one.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    clean = df.withColumns({c: number(c) for c in present})
    gaps = clean.agg(*[F.max(F.isnull(c)).alias(c) for c in present]).first()
    open_columns = [c for c in present if gaps[c]]
    if not open_columns:
        return clean
    medians = global_quantiles(clean if fit_where is None else clean.filter(fit_where), open_columns, [0.5])
    return clean.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c][0] if medians[c] else 0.0)) for c in open_columns})


def group_median_fill(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """NULL <- median of its group; what stays NULL <- global median of the filled column, then 0.

    The second step runs only for columns with a group that has no median.
    """
    clean = df.withColumns({c: number(c) for c in columns})
    hot = hot_groups(clean, [group])
    stats = group_quantiles(clean, [group], columns, [0.5], hot)
    # a NULL group has no median of its own
    own = {f"__g_{c}": F.when(F.col(group).isNotNull(), F.col(f"{c}__q")[0]) for c in columns}
    stats = cut(stats.select(group, *[q.alias(n) for n, q in own.items()]))
    gaps = stats.agg(*[F.max(F.isnull(f"__g_{c}").cast("int")).alias(c) for c in columns]).first()
    keyed = join_same(clean, stats, [group], hot)
    filled = keyed.withColumns({c: F.coalesce(c, f"__g_{c}") for c in columns}).drop(*own)
    return fill_median(filled, [c for c in columns if gaps[c] != 0])


def flag_and_fill(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    return group_median_fill(missing_flags(df, present), present, group)


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of ``<c>__mean`` and ``<c>__scale`` (population std, 1 where there is no spread)."""
    std = {c: F.stddev_pop(c) for c in columns}
    return df.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.when(std[c] > 0, std[c]).otherwise(1.0).alias(f"{c}__scale") for c in columns],
    )


def standardize(df: DataFrame, columns: Sequence[str], fit_where: Column | None = None, suffix: str = "_z") -> DataFrame:
    fit = scaler_stats(df if fit_where is None else df.filter(fit_where), columns).first()
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.lit(fit[f"{c}__mean"])) / F.lit(fit[f"{c}__scale"]) for c in columns
    })


def sequence_scaler(df: DataFrame, train: Column, scale_target: bool = False) -> DataFrame:
    """Scaler statistics of training windows as one persistable row.

    seq/static hold (mean, scale) per feature over all cells of the training rows; y is
    (0, 1) unless the target is scaled.
    """
    rows = df.filter(train)

    def fitted(name: str, cells: DataFrame) -> DataFrame:
        per = cells.groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
        scale = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
        entries = F.array_sort(F.collect_list(F.struct("pos", "mean", scale.alias("scale"))))
        return per.agg(entries.alias(name))

    seq = rows.select(F.explode("x_seq").alias("c")).select(F.posexplode("c").alias("pos", "v"))
    static = rows.select(F.posexplode("x_static").alias("pos", "v"))
    y_std = F.stddev_pop("y_delta")
    y = rows.agg(
        (F.avg("y_delta") if scale_target else F.lit(0.0)).alias("mean"),
        (F.when(y_std > 0, y_std).otherwise(1.0) if scale_target else F.lit(1.0)).alias("scale"),
    )
    out = fitted("seq", seq)
    return out.select(
        "seq",
        fitted("static", static).scalar().alias("static"),
        y.select(F.struct("mean", "scale")).scalar().alias("y"),
    )


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Scale windows, static context and target delta with saved statistics."""
    def scaled(cell: Column, stats: Column) -> Column:
        return F.zip_with(cell, stats, lambda v, s: ((v - s["mean"]) / s["scale"]).cast("float"))

    fit = scaler.first()

    def constants(entries) -> Column:
        return F.array(*[F.struct(F.lit(e["mean"]).alias("mean"), F.lit(e["scale"]).alias("scale")) for e in entries])

    return df.withColumns({
        "x_seq_scaled": F.transform("x_seq", lambda cell: scaled(cell, constants(fit["seq"]))),
        "x_static_scaled": scaled(F.col("x_static"), constants(fit["static"])),
        "y_delta_scaled": ((F.col("y_delta") - fit["y"]["mean"]) / fit["y"]["scale"]).cast("float"),
    })


def scale_sequences(df: DataFrame, train: Column, scale_target: bool = False) -> DataFrame:
    return apply_scaler(df, sequence_scaler(df, train, scale_target))


def inverse_scaler(df: DataFrame, scaler: DataFrame, prediction: str, baseline: str = "baseline") -> DataFrame:
    """Predicted scaled delta back on stat scale: baseline + mean + scale * delta."""
    fit = scaler.first()["y"]
    return df.withColumn("y_pred", F.col(baseline) + F.col(prediction) * fit["scale"] + fit["mean"])


def tabular_preprocessor(numeric: Sequence[str], categorical: Sequence[str], scale: bool = False) -> Pipeline:
    """Exact median imputation (+ scaling) and one-hot codes of filled categories; labels not learned have no code."""
    return Pipeline(stages=[TabularPreprocessor(numeric, categorical, "all" if scale else "none")])
