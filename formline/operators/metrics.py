"""Evaluation as single-pass aggregates; groups are keys, never loops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.config import STATS, STAT_TARGETS
from formline.functions.scalars import clamp, row_mean
from formline.operators.frames import long_by_stat
from formline.operators.joins import attach_test_metrics, join_same
from formline.operators.ordered import Frames, over_history
from formline.operators.quantiles import group_quantiles
from formline.operators.topk import best_per_group, first_rows


def regression_aggs(y: Column, e: Column, prefix: str = "") -> list[Column]:
    """MAE, RMSE and R2 of complete pairs; for constant truth R2 is 1 if perfect, else 0."""
    truth = F.when(e.isNotNull(), y)
    squared = (y - e) * (y - e)
    sse, sst = F.sum(squared), F.var_pop(truth) * F.count(truth)
    constant = F.min(truth) == F.max(truth)
    r2 = F.when(F.count(truth) == 0, None).when(constant, F.when(sse == 0, 1.0).otherwise(0.0)).otherwise(1 - sse / sst)
    return [
        F.avg(F.abs(y - e)).alias(f"{prefix}mae"), F.sqrt(F.avg(squared)).alias(f"{prefix}rmse"),
        r2.alias(f"{prefix}r2"),
    ]


def _group(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*by)


def regression_metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()) -> DataFrame:
    pairs = df.dropna(subset=[y, yhat])
    return _group(pairs, by).agg(F.count(F.lit(1)).alias("rows"), *regression_aggs(F.col(y), F.col(yhat)))


def evaluate_by_split(
    df: DataFrame, y: str, yhat: str, task: str, split: str = "split", splits: Sequence[str] = ("validation", "test")
) -> DataFrame:
    rows = regression_metrics(df.filter(F.col(split).isin(*splits)), y, yhat, [split])
    return rows.withColumn("task", F.lit(task))


def classification_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """F1, accuracy, Brier, precision, recall, positive rate and exact ROC-AUC.

    The AUC is a rank sum with ties counted half, over counts per distinct score.
    """
    keys = list(by)
    rows = df.dropna(subset=[y, p])
    if not keys:
        rows, keys = rows.withColumn("__all", F.lit(1)), ["__all"]
    truth, hit = F.col(y).cast("int"), (F.col(p) >= threshold).cast("int")
    n, tp, fp, fn = F.count(F.lit(1)), F.sum(truth * hit), F.sum((1 - truth) * hit), F.sum(truth * (1 - hit))
    zero = F.lit(0.0)
    base = rows.groupBy(*keys).agg(
        n.alias("rows"), F.avg(truth).alias("positive_rate"),
        F.avg((truth == hit).cast("double")).alias("accuracy"),
        F.avg((F.col(p) - truth) * (F.col(p) - truth)).alias("brier"),
        F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )
    scores = rows.groupBy(*keys, p).agg(F.sum(truth).alias("__pos"), F.sum(1 - truth).alias("__neg"))
    ranked = over_history(scores, keys, [p], Frames(running={"__upto": ("sum", F.col("__neg"))}))
    below = F.col("__upto") - F.col("__neg") / 2
    auc = ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("__pos") * below), F.sum("__pos") * F.sum("__neg")).alias("roc_auc")
    )
    return join_same(base, auc, keys, None).drop("__all")


def range_metrics(
    df: DataFrame, y: str = "actual", e: str = "expected", lo: str = "lower", hi: str = "upper",
    by: Sequence[str] = ("split", "stat"),
) -> DataFrame:
    """Regression metrics, inclusive coverage and mean width of complete rows."""
    rows = df.dropna(subset=[y, e, lo, hi])
    covered = F.col(y).between(F.col(lo), F.col(hi)).cast("double")
    return _group(rows, by).agg(
        F.count(F.lit(1)).alias("rows"), *regression_aggs(F.col(y), F.col(e)),
        F.avg(covered).alias("coverage_rate"), F.avg(F.col(hi) - F.col(lo)).alias("avg_range_width"),
    )


def evaluate_ranges(signals: DataFrame, targets: Mapping[str, str] = STAT_TARGETS, split: str = "split") -> DataFrame:
    """Range metrics per split and stat of the range signals."""
    long = long_by_stat(signals, [split], {
        s: {
            "actual": t, "expected": f"expected_next_5_{s}_avg", "lower": f"floor_next_5_{s}_avg",
            "upper": f"ceiling_next_5_{s}_avg",
        }
        for s, t in targets.items()
    })
    return range_metrics(long, by=[split, "stat"])


def salary_metrics(df: DataFrame, predicted: str, by: Sequence[str] = ("split",)) -> DataFrame:
    """Cap-share MAE, USD MAE, RMSE and R2 with predictions clipped at 0."""
    pred, share = clamp(F.col(predicted), 0, None), F.col("salary_cap_share")
    mae, rmse, r2 = regression_aggs(share, pred)
    return _group(df, by).agg(
        F.count(F.lit(1)).alias("rows"), mae.alias("cap_share_mae"),
        F.avg(F.abs(F.col("salary_usd") - pred * F.col("salary_cap_usd"))).alias("usd_mae"), rmse, r2,
    )


def segment_metrics(df: DataFrame, predicted: str, segment: str = "salary_segment", split: str = "split") -> DataFrame:
    return salary_metrics(df, predicted, [split, segment])


def interval_metrics(df: DataFrame, y: str, low: str, mid: str, high: str, by: Sequence[str] = ("split",)) -> DataFrame:
    """Coverage, mean and median width and mid-point MAE; crossed bounds are swapped."""
    lo, hi = F.least(low, high), F.greatest(low, high)
    rows = df.withColumn("__width", hi - lo)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(F.col(y) - F.col(mid))).alias("p50_mae"),
        F.avg(F.col(y).between(lo, hi).cast("double")).alias("interval_coverage"),
        F.avg("__width").alias("avg_interval_width"),
    )
    medians = group_quantiles(rows, by, ["__width"], [0.5])
    joined = join_same(out, medians, by, None)
    return joined.withColumn("median_interval_width", F.col("__width__q")[0]).drop("__width__q")


def similarity_diagnostics(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("similarity_score", "similarity_distance", "salary_cap_share_gap", "age_gap")],
    )


# --- parameter grids ----------------------------------------------------------------------
def trend_threshold_grid(
    df: DataFrame, grid: Mapping[str, Sequence[float]], targets: Mapping[str, str] = STAT_TARGETS,
    split_name: str = "validation", min_rate: float = 0.10,
) -> DataFrame:
    """Share of directional labels, hit rate and future deltas per stat and tolerance.

    Rows are first counted per (stat, number of tolerances exceeded, direction); the grid
    only ever meets that small table.
    """
    entries = []
    for stat, tolerances in grid.items():
        delta = F.col(f"{stat}_last_5_minus_season_avg").cast("double")
        future = F.col(targets[stat]) - F.col(f"{stat}_season_avg") if stat in targets else F.lit(None).cast("double")
        usable = delta.isNotNull() & future.isNotNull() if stat in targets else F.lit(True)
        exceeded = sum((F.coalesce((F.abs(delta) > t).cast("int"), F.lit(0)) for t in sorted(tolerances)), F.lit(0))
        entries.append(F.when(usable, F.struct(
            F.lit(stat).alias("stat"), exceeded.alias("exceeded"), F.signum(F.coalesce(delta, F.lit(0.0))).alias("direction"),
            future.alias("future"),
        )))
    rows = df.filter(F.col("split") == split_name).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    counted = rows.filter(F.col("stat").isNotNull()).groupBy("stat", "exceeded", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.count("future").alias("known"), F.sum("future").alias("future_sum"),
        F.count_if(F.signum("future") == F.col("direction")).alias("hits"),
    )
    steps = [(s, float(t), i + 1) for s, ts in grid.items() for i, t in enumerate(sorted(ts))]
    spark = df.sparkSession
    small = F.broadcast(spark.createDataFrame(steps, "stat string, tolerance double, step int"))
    joined = counted.join(small, "stat")
    moved = F.col("exceeded") >= F.col("step")
    label = F.when(moved & (F.col("direction") > 0), "improving").when(moved & (F.col("direction") < 0), "declining").otherwise("stable")

    def total(where: Column, c: str) -> Column:
        return F.sum(F.when(where, F.col(c)))

    joined = joined.withColumn("label", label)
    means = {
        f"future_delta_mean_{l}": F.try_divide(total(F.col("label") == l, "future_sum"), total(F.col("label") == l, "known"))
        for l in ("improving", "stable", "declining")
    }
    non_stable = F.coalesce(total(moved, "n"), F.lit(0)) / F.sum("n")
    return joined.groupBy("stat", "tolerance").agg(
        F.sum("n").alias("rows"), non_stable.alias("non_stable_rate"),
        F.when(F.sum("known") > 0, F.try_divide(total(moved, "hits"), total(moved, "n"))).alias("directional_hit_rate"),
        *[c.alias(n) for n, c in means.items()],
        (non_stable >= min_rate).alias("selection_eligible"),
    )


def select_trend_thresholds(grid: DataFrame) -> DataFrame:
    """Best tolerance per stat: eligible ones first, then hit rate, then directional share."""
    order = [
        F.col("selection_eligible").desc(), F.col("directional_hit_rate").desc_nulls_last(),
        F.col("non_stable_rate").desc(), F.col("tolerance").asc(),
    ]
    return first_rows(grid, ["stat"], order, 1)


def _stat_values(df: DataFrame, split_name: str, targets: Mapping[str, str], extra: Mapping[str, str]) -> DataFrame:
    source = {
        s: {"target": t, "season": f"{s}_season_avg", "ten": f"{s}_last_10", "five": f"{s}_last_5",
            **{k: v.format(s) for k, v in extra.items()}}
        for s, t in targets.items()
    }
    return long_by_stat(df.filter(F.col("split") == split_name), [], source).dropna()


def blend_weight_grid(
    df: DataFrame, weights: Sequence[tuple[float, float, float]], split_name: str = "validation",
    targets: Mapping[str, str] = STAT_TARGETS,
) -> DataFrame:
    """Mean over stats of MAE / population std of the target, per (season, last-10, last-5) weights.

    Each row meets the grid inside its own task; only (stat, weights) sums are shuffled.
    """
    rows = _stat_values(df, split_name, targets, {})
    grid = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(w, ("w_season", "w_ten", "w_five"))]) for w in weights])
    expanded = rows.select("*", F.explode(grid).alias("g")).select("*", "g.*")
    error = F.abs(
        F.col("target") - (F.col("w_season") * F.col("season") + F.col("w_ten") * F.col("ten") + F.col("w_five") * F.col("five"))
    )
    std = F.stddev_pop("target")
    per_stat = expanded.groupBy("stat", "w_season", "w_ten", "w_five").agg(
        (F.avg(error) / F.when(std > 0, std).otherwise(1.0)).alias("score")
    )
    return per_stat.groupBy("w_season", "w_ten", "w_five").agg(F.avg("score").alias("normalized_mae"))


def best_blend(grid: DataFrame) -> DataFrame:
    return grid.orderBy("normalized_mae", "w_season", "w_ten", "w_five").limit(1)


def volatility_multiplier_grid(
    df: DataFrame, weights: tuple[float, float, float], multipliers: Sequence[float], split_name: str = "validation",
    targets: Mapping[str, str] = STAT_TARGETS, coverage_target: float = 0.80,
) -> DataFrame:
    """Coverage and width per multiplier, averaged over stats; needs ``<stat>_sigma``."""
    rows = _stat_values(df, split_name, targets, {"sigma": "{}_sigma"})
    expected = weights[0] * F.col("season") + weights[1] * F.col("ten") + weights[2] * F.col("five")
    grid = F.array(*[F.lit(float(m)) for m in multipliers])
    expanded = rows.select("stat", "target", "sigma", expected.alias("e"), F.explode(grid).alias("multiplier"))
    reach = F.col("multiplier") * F.col("sigma")
    floor, ceiling = F.greatest(F.col("e") - reach, F.lit(0.0)), F.col("e") + reach
    per_stat = expanded.groupBy("stat", "multiplier").agg(
        F.avg(F.col("target").between(floor, ceiling).cast("double")).alias("c"), F.avg(ceiling - floor).alias("w")
    )
    out = per_stat.groupBy("multiplier").agg(F.avg("c").alias("coverage"), F.avg("w").alias("avg_width"))
    return out.withColumn("coverage_gap", F.abs(F.col("coverage") - coverage_target))


def best_multiplier(grid: DataFrame) -> DataFrame:
    return grid.orderBy("coverage_gap", "avg_width", "multiplier").limit(1)


# --- model comparison ---------------------------------------------------------------------
def model_selection(
    evaluations: DataFrame, metric: str, by: Sequence[str], identity: Sequence[str], metrics: Sequence[str],
    ascending: bool = True,
) -> DataFrame:
    """Best validation row per task with its test metrics attached."""
    ties = [c for c in identity if c not in by]
    chosen = best_per_group(evaluations.filter(F.col("split") == "validation"), by, metric, ties, ascending)
    return attach_test_metrics(chosen, evaluations, identity, metrics)


def composition_eval(
    df: DataFrame, horizon: int, minutes: Mapping[str, Column], rates: Mapping[str, str], split: str = "split"
) -> DataFrame:
    """Per-game output composed as rate x minutes / 36, per split and minutes estimator.

    ``rates`` maps a stat to its predicted per-36 column.
    """
    estimators = F.array(*[F.struct(F.lit(n).alias("minutes_estimator"), c.alias("minutes_pred")) for n, c in minutes.items()])
    rows = df.select("*", F.explode(estimators).alias("__e")).select("*", "__e.*").filter(F.col(split).isNotNull())
    truth = F.col(f"minutes_per_game_h{horizon}")
    aggs = [
        F.count(F.lit(1)).alias("rows"), *regression_aggs(truth, F.col("minutes_pred"), "minutes_"),
        F.count(F.when(F.col("minutes_pred").isNotNull(), truth)).alias("minutes_rows"),
    ]
    for stat, rate in rates.items():
        actual = F.col(f"{stat}_per_game_h{horizon}")
        composed = F.col(rate) * F.col("minutes_pred") / 36
        aggs += regression_aggs(actual, composed, f"{stat}_pg_")
        aggs.append(F.count(F.when(composed.isNotNull(), actual)).alias(f"{stat}_rows"))
    out = rows.groupBy(split, "minutes_estimator").agg(*aggs)
    return out.withColumns({"avg_pg_mae": row_mean([f"{s}_pg_mae" for s in rates]), "horizon": F.lit(horizon)})


def composition_selection(composition: DataFrame, split: str = "split") -> DataFrame:
    return best_per_group(composition.filter(F.col("avg_pg_mae").isNotNull()), ["horizon", split], "avg_pg_mae", ["minutes_estimator"])


def per_game_decision(
    composition: DataFrame, direct: DataFrame, stats: Sequence[str] = STATS, max_mae: float = 4.0, min_r2: float = 0.5,
    max_gap: float = 0.0, split: str = "split",
) -> DataFrame:
    """Use composed per-game output only where minutes are good enough and it is not worse than direct.

    ``direct`` has one row per model, (horizon, split, stat) and its ``mae``.
    """
    chosen = composition_selection(composition, split)
    best = best_per_group(direct, ["horizon", split, "stat"], "mae", ["model"])
    wide = best.groupBy("horizon", split).agg(*[F.max(F.when(F.col("stat") == s, F.col("mae"))).alias(f"direct_{s}_pg_mae") for s in stats])
    wide = wide.withColumn("direct_avg_pg_mae", row_mean([f"direct_{s}_pg_mae" for s in stats]))
    out = chosen.join(wide, ["horizon", split], "left")
    gap = F.col("avg_pg_mae") - F.col("direct_avg_pg_mae")
    passes = F.coalesce((F.col("minutes_mae") <= max_mae) & (F.col("minutes_r2") >= min_r2), F.lit(False))
    out = out.withColumns({"compose_minus_direct_avg_mae": gap, "minutes_passes_threshold": passes,
                           "compose_beats_direct": F.coalesce(gap <= max_gap, F.lit(False))})
    use = F.col("minutes_passes_threshold") & F.col("compose_beats_direct")
    out = out.withColumns({"use_per_game_output": use, "recommendation": F.when(use, "optional_per_game").otherwise("use_per36_only")})
    return out.withColumnsRenamed({"minutes_estimator": "recommended_minutes_estimator", "avg_pg_mae": "compose_avg_pg_mae"})
