"""Feature analysis: correlations, mutual information and combined rankings."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.scalars import number, row_mean
from formline.operators.joins import lookup, merge_signal_tables
from formline.operators.ordered import Frames, over_history
from formline.operators.quantiles import global_quantiles
from formline.session import cut


def feature_pairs(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Complete (feature, x, y) pairs in long form."""
    cast = df.select(number(target).alias("__y"), *[number(c).alias(c) for c in features])
    return (
        cast.unpivot(["__y"], list(features), "feature", "x")
        .filter(F.col("x").isNotNull() & F.col("__y").isNotNull()).withColumnRenamed("__y", "y")
    )


def _corr(x: str, y: str) -> Column:
    """Pearson correlation, NULL for a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson_ranking(df: DataFrame, target: str, features: Sequence[str], min_rows: int = 50) -> DataFrame:
    """Correlation with the target per feature over complete pairs; constants are left out."""
    out = feature_pairs(df, target, features).groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), _corr("x", "y").alias("correlation"),
        (F.min("x") < F.max("x")).alias("varies"),
    )
    kept = out.filter((F.col("rows") >= min_rows) & F.col("varies")).drop("varies")
    return kept.withColumns({"target": F.lit(target), "abs_correlation": F.abs("correlation")})


def spearman(pairs: DataFrame, key: str) -> DataFrame:
    """Spearman correlation per key of long (key, x, y) pairs, ties ranked by their average.

    Equal pairs are counted first; ranks come from running counts over distinct values.
    """
    counted = cut(pairs.groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("n")))

    def ranks(axis: str) -> DataFrame:
        values = counted.groupBy(key, axis).agg(F.sum("n").alias("__c"))
        run = over_history(values, [key], [axis], Frames(running={"__cum": ("sum", F.col("__c"))}))
        rank = F.col("__cum") - (F.col("__c") - 1) / 2
        return run.select(key, axis, rank.alias(f"r{axis}"))

    both = lookup(lookup(counted, ranks("x"), [key, "x"]), ranks("y"), [key, "y"])
    # ranks are centred on their mean for stable sums
    n = F.col("n")
    mid = counted.groupBy(key).agg(((F.sum("n") + 1) / 2).alias("__mid"))
    centred = lookup(both, mid, [key]).withColumns({"rx": F.col("rx") - F.col("__mid"), "ry": F.col("ry") - F.col("__mid")})
    sums = centred.groupBy(key).agg(
        F.sum(n * F.col("rx") * F.col("ry")).alias("sxy"), F.sum(n * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(n * F.col("ry") * F.col("ry")).alias("syy"),
    )
    return sums.select(key, F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy"))).alias("spearman"))


def correlation_summary(df: DataFrame, target: str, features: Sequence[str], min_rows: int = 100) -> DataFrame:
    """Pearson, Spearman and their gap per feature."""
    pairs = feature_pairs(df, target, features)
    base = pairs.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), _corr("x", "y").alias("pearson"),
        ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("varies"),
    ).filter((F.col("rows") >= min_rows) & F.col("varies")).drop("varies")
    out = base.join(spearman(pairs, "feature"), "feature").withColumn("target", F.lit(target))
    out = out.withColumns({"abs_pearson": F.abs("pearson"), "abs_spearman": F.abs("spearman")})
    return out.withColumn("monotonic_minus_linear", F.col("abs_spearman") - F.col("abs_pearson"))


def _ranked_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(row, x): average ranks of every column over its own values, NaN where it has none, as one array a row."""
    numbered = cut(df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(features)])).withColumn("row", F.monotonically_increasing_id())
    cells = [F.struct(F.lit(i).alias("at"), F.col(f"c{i}").alias("x")) for i in range(len(features))]
    long = cut(numbered.select("row", F.explode(F.array(*cells)).alias("e")).select("row", "e.at", "e.x").filter("x is not null"))
    values = long.groupBy("at", "x").agg(F.count(F.lit(1)).alias("n"))
    run = over_history(values, ["at"], ["x"], Frames(running={"upto": ("sum", F.col("n"))}))
    ranks = run.select("at", "x", (F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    found = F.map_from_entries(F.collect_list(F.struct("at", "rank")))
    wide = lookup(long, ranks, ["at", "x"]).groupBy("row").agg(found.alias("m"))
    return wide.select("row", F.array(*[F.coalesce(F.col("m")[i], F.lit(float("nan"))) for i in range(len(features))]).alias("x"))


def rank_products(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, corr) of every two columns of ``x``: rows that both have, and the correlation of their values over those rows.

    Tasks add up products of columns by columns, a batch at a time; the driver sees a few numbers a pair of columns.
    """
    means = rows.agg(*[F.avg(F.nanvl(F.col("x")[i], F.lit(None))).alias(f"m{i}") for i in range(width)]).first()
    centre = np.array([means[f"m{i}"] or 0.0 for i in range(width)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, width, width))
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            has = (~np.isnan(x)).astype(float)
            x = np.where(has > 0, x - centre, 0.0)
            sums += np.stack((has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size).astype(np.int32)), pa.array(sums.ravel())], names=["at", "v"])

    got = rows.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
    if got.empty:
        return np.zeros((width, width)), np.full((width, width), np.nan)
    n, s, q, xy = got["v"].to_numpy().reshape(4, width, width)
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = q - s * s / n
        return n, (xy - s * s.T / n) / np.sqrt(spread * spread.T)


def redundant_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Feature pairs whose absolute Spearman correlation reaches the threshold.

    Each pair of columns is ranked over its own complete rows. Columns are ranked once, which is right for all
    pairs that miss the same rows; only pairs that miss different rows are ranked again, each by itself.
    """
    spark, width = df.sparkSession, len(features)
    ranked = cut(_ranked_rows(df, features))
    n, corr = rank_products(ranked, width)
    alike = [(i, j) for i, j in combinations(range(width), 2) if n[i, j] == n[i, i] == n[j, j]]
    made = [(features[i], features[j], float(abs(corr[i, j]))) for i, j in alike if abs(corr[i, j]) >= threshold]
    out = spark.createDataFrame(made, "feature_a string, feature_b string, abs_spearman_corr double")
    again = [(i, j) for i, j in combinations(range(width), 2) if n[i, j] > 0 and (i, j) not in set(alike)]
    if not again:
        return out
    used = sorted({i for pair in again for i in pair})
    cast = df.select(*[number(features[i]).alias(f"c{i}") for i in used])
    entries = [F.struct(F.lit(f"{i}|{j}").alias("pair"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y")) for i, j in again]
    long = cast.select(F.explode(F.array(*entries)).alias("e")).select("e.*").dropna()
    own = spearman(long, "pair").withColumn("abs_spearman_corr", F.abs("spearman")).filter(F.col("abs_spearman_corr") >= threshold)
    names = F.array(*[F.lit(f) for f in features])
    at = F.split("pair", r"\|")
    return out.unionByName(own.select(
        F.get(names, at[0].cast("int")).alias("feature_a"), F.get(names, at[1].cast("int")).alias("feature_b"), "abs_spearman_corr"))


def _binned(value: Column, edges: Sequence[float]) -> Column:
    """Number of inner bin edges below the value."""
    return sum(((value > e).cast("int") for e in edges), F.lit(0))


def mutual_information(
    df: DataFrame, target: str, features: Sequence[str], bins: int = 10, categorical: Sequence[str] = (),
    discrete_target: bool = False,
) -> DataFrame:
    """Plug-in mutual information (nats) on quantile bins of features and target."""
    inner = [i / bins for i in range(1, bins)]
    numeric = [f for f in features if f not in categorical]
    columns = [*numeric, *([] if discrete_target else [target])]
    clean = df.select(
        *[number(c).alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical],
        (F.col(target).cast("string") if discrete_target else number(target)).alias(target),
    ).dropna(subset=[target])
    edges = global_quantiles(clean, columns, inner) if columns else {}

    def code(c: str) -> Column:
        if c in categorical or (c == target and discrete_target):
            return F.col(c)
        return F.when(F.col(c).isNotNull(), _binned(F.col(c), edges[c] or []).cast("string"))

    coded = clean.select(code(target).alias("y"), *[code(c).alias(c) for c in features])
    long = coded.unpivot(["y"], list(features), "feature", "x").filter(F.col("x").isNotNull())
    joint = long.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    nx = joint.groupBy("feature", "x").agg(F.sum("n").alias("nx"))
    ny = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("total"))
    cells = joint.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(total, "feature")
    p = F.col("n") / F.col("total")
    gain = p * F.log(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))
    return cells.groupBy("feature").agg(F.sum(gain).alias("mutual_info")).withColumn("target", F.lit(target))


def signal_summary(frames: Sequence[DataFrame], scores: Sequence[str] = ("abs_spearman", "mutual_info", "importance_mean")) -> DataFrame:
    """Full-joined scores, each over its maximum, and their mean."""
    merged = merge_signal_tables(frames)
    present = [c for c in scores if c in merged.columns]
    top = merged.agg(*[F.max(c).alias(c) for c in present]).first()
    ranked = {f"rank_score_{c}": F.try_divide(F.col(c), F.lit(top[c])) for c in present}
    out = merged.withColumns(ranked)
    return out.withColumn("combined_signal_score", row_mean(list(ranked)))
