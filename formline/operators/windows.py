"""Rolling, expanding, lagged and look-ahead columns over ordered histories."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from formline.operators.ordered import Frames, hot_groups, over_history
from formline.operators.quantiles import group_quantiles
from formline.operators.joins import join_same

Make = Callable[[WindowSpec], Column]


# --- frame makers -------------------------------------------------------------------------
def last_mean(value: str, n: int, least: int) -> Make:
    """Mean of the last n rows, NULL below ``least`` observed values."""

    def make(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame))

    return make


def last_std(value: str, n: int, least: int, ddof: int = 0) -> Make:
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp

    def make(w: WindowSpec) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.when(F.count(value).over(frame) >= least, spread(value).over(frame))

    return make


def next_mean(value: str, horizon: int) -> Make:
    """Mean of the next ``horizon`` rows, NULL unless all are there."""

    def make(w: WindowSpec) -> Column:
        frame = w.rowsBetween(1, horizon)
        return F.when(F.count(value).over(frame) == horizon, F.avg(value).over(frame))

    return make


def shifted(value: str, step: int) -> Make:
    """Value ``step`` rows back (negative: ahead)."""
    return lambda w: F.lag(value, step).over(w) if step >= 0 else F.lead(value, -step).over(w)


# --- operators ----------------------------------------------------------------------------
def rolling_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int,
    min_history: int | str = "window", name: str | None = None,
) -> DataFrame:
    least = n if min_history == "window" else int(min_history)
    frames = Frames(bounded={name or f"{value}_last_{n}": last_mean(value, n, least)}, back=n - 1)
    return over_history(df, keys, order, frames)


def expanding_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, min_history: int = 1,
    name: str | None = None,
) -> DataFrame:
    frames = Frames(running={"__sum": ("sum", F.col(value)), "__n": ("count", F.col(value))})
    out = over_history(df, keys, order, frames)
    mean = F.when(F.col("__n") >= max(min_history, 1), F.col("__sum") / F.col("__n"))
    return out.withColumn(name or f"{value}_to_date_avg", mean).drop("__sum", "__n")


def rolling_std(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], n: int = 10,
    min_periods: int = 5, ddof: int = 0,
) -> DataFrame:
    made = {f"{v}_rolling_std_{n}": last_std(v, n, min_periods, ddof) for v in values}
    return over_history(df, keys, order, Frames(bounded=made, back=n - 1))


def future_average(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, horizon: int = 5,
    name: str | None = None,
) -> DataFrame:
    made = {name or f"target_next_{horizon}_{value}_avg": next_mean(value, horizon)}
    return over_history(df, keys, order, Frames(bounded=made, ahead=horizon))


def form_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], stats: Sequence[str],
    targets: Sequence[str] = (), min_history: int | str = 5, horizon: int = 5,
) -> DataFrame:
    """Last-5, last-10 and to-date means, their differences, and next-games targets.

    All columns share one ordering, hence one exchange and one sort.
    """
    def least(n: int) -> int:
        return n if min_history == "window" else int(min_history)

    season_least = 1 if min_history == "window" else int(min_history)
    bounded: dict[str, Make] = {}
    running: dict[str, tuple[str, Column]] = {}
    for s in stats:
        bounded |= {f"{s}_last_{n}": last_mean(s, n, least(n)) for n in (5, 10)}
        running |= {f"__sum_{s}": ("sum", F.col(s)), f"__n_{s}": ("count", F.col(s))}
    bounded |= {f"target_next_{horizon}_{s}_avg": next_mean(s, horizon) for s in targets}
    out = over_history(df, keys, order, Frames(bounded, back=9, ahead=horizon if targets else 0, running=running))
    season = {
        f"{s}_season_avg": F.when(F.col(f"__n_{s}") >= season_least, F.col(f"__sum_{s}") / F.col(f"__n_{s}"))
        for s in stats
    }
    return form_deltas(out.withColumns(season).drop(*running), stats)


def form_deltas(df: DataFrame, stats: Sequence[str]) -> DataFrame:
    """last-5 and last-10 against the to-date mean, and against each other."""
    deltas = {}
    for s in stats:
        five, ten, season = (F.col(f"{s}_{x}") for x in ("last_5", "last_10", "season_avg"))
        deltas |= {
            f"{s}_last_5_minus_season_avg": five - season,
            f"{s}_last_10_minus_season_avg": ten - season,
            f"{s}_last_5_minus_last_10": five - ten,
        }
    return df.withColumns(deltas)


def rest_days(df: DataFrame, keys: Sequence[str], order: Sequence[str], date: str) -> DataFrame:
    """Whole days since the entity's previous row."""
    made = {"__before": shifted(date, 1)}
    out = over_history(df, keys, order, Frames(bounded=made, back=1))
    days = F.timestamp_diff("DAY", F.col("__before"), F.col(date)).cast("int")
    return out.withColumn("rest_days", days).drop("__before")


def lag_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], lags: int = 4
) -> DataFrame:
    """``<column>_lag_0`` (the row itself) to ``<column>_lag_<lags-1>``."""
    return trajectory(df, keys, order, columns, (), lags)


def trailing_slope(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], n: int = 3,
    min_points: int = 2,
) -> DataFrame:
    return trajectory(df, keys, order, (), columns, 1, n, min_points)


def trajectory(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], lag_columns: Sequence[str],
    slope_columns: Sequence[str], lags: int = 4, n: int = 3, min_points: int = 2,
) -> DataFrame:
    """Lags and trailing OLS slopes in one pass.

    A slope runs over the non-missing values of the last n rows, numbered consecutively;
    it does not change when all numbers shift, so a running count serves as index.
    """
    bounded: dict[str, Make] = {}
    for c in lag_columns:
        bounded |= {f"{c}_lag_{i}": shifted(c, i) for i in range(lags)}
    hot = hot_groups(df, keys)
    index = {f"__i_{c}": ("count", F.col(c)) for c in slope_columns}
    first = over_history(df, keys, order, Frames(bounded, back=lags - 1 if lag_columns else 0, running=index), hot)
    if not slope_columns:
        return first

    def slope(c: str) -> Make:
        def make(w: WindowSpec) -> Column:
            frame = w.rowsBetween(-(n - 1), 0)
            index = F.col(f"__i_{c}").cast("double")
            return F.when(F.count(c).over(frame) >= min_points, F.regr_slope(F.col(c).cast("double"), index).over(frame))

        return make

    slopes = {f"{c}_slope_{n}yr": slope(c) for c in slope_columns}
    out = over_history(first, keys, order, Frames(slopes, back=n - 1), hot)
    return out.drop(*[f"__i_{c}" for c in slope_columns])


def career_cumulative(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], games: str = "games_played",
    minutes: str = "total_minutes",
) -> DataFrame:
    running = {
        "career_games": ("sum", F.col(games)),
        "career_minutes": ("sum", F.col(minutes)),
        "years_in_league": ("count", F.lit(1)),
    }
    return over_history(df, keys, order, Frames(running=running))


def group_std(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Sample std of the whole group on each row, via a pre-aggregated join."""
    stats = df.groupBy(*keys).agg(F.stddev_samp(value).alias(name))
    return join_same(df, stats, keys)


def robust_z(df: DataFrame, keys: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Robust z-scores: ``values`` maps a column to its output name.

    0.6745 (x - median) / MAD; without a MAD (x - mean) / population std; without spread 0.
    Two aggregates per group (medians with moments, then deviations) replace group-wide windows.
    """
    columns = list(values)
    hot = hot_groups(df, keys)
    moments = [f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("std", F.stddev_pop))]
    if hot is None:
        mids = df.groupBy(*keys).agg(*moments, *[F.percentile(F.col(c).cast("double"), 0.5).alias(f"__med_{c}") for c in columns])
    else:
        mids = group_quantiles(df, keys, columns, [0.5], hot)
        mids = mids.select(*keys, *[F.col(f"{c}__q")[0].alias(f"__med_{c}") for c in columns])
        mids = join_same(mids, df.groupBy(*keys).agg(*moments), keys, None)
    centred = join_same(df, mids, keys, hot).withColumns(
        {f"__dev_{c}": F.abs(F.col(c) - F.col(f"__med_{c}")) for c in columns}
    )
    mads = group_quantiles(centred, keys, [f"__dev_{c}" for c in columns], [0.5], hot)
    mads = mads.select(*keys, *[F.col(f"__dev_{c}__q")[0].alias(f"__mad_{c}") for c in columns])
    out = join_same(centred, mads, keys, hot)
    for c, name in values.items():
        mad, std = F.col(f"__mad_{c}"), F.col(f"__std_{c}")
        flat = F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise(F.try_divide(F.col(c) - F.col(f"__avg_{c}"), std))
        robust = 0.6745 * F.try_divide(F.col(c) - F.col(f"__med_{c}"), mad)
        out = out.withColumn(name, F.when(mad.isNull() | (mad == 0), flat).otherwise(robust))
    return out.drop(*[f"__{k}_{c}" for k in ("med", "dev", "mad", "avg", "std") for c in columns])


def carry_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Fill NULLs forward along the order, then backward."""
    at = F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("v")))
    frames = Frames(running={"__before": ("max", at)}, suffix={"__after": ("min", at)})
    keyed, by = (df, keys) if keys else (df.withColumn("__all", F.lit(1)), ["__all"])
    out = over_history(keyed, by, order, frames)
    filled = F.coalesce(F.col(value), F.col("__before.v"), F.col("__after.v"))
    return out.withColumn(value, filled).drop("__before", "__after", "__all")


def sequence_windows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], stat: str, stat_avg: str, target: str,
    length: int, minutes: str = "min", minutes_avg: str = "min_season_avg", split: str = "split",
) -> DataFrame:
    """Full windows of (stat delta, minutes delta) with static context, baseline and target delta.

    Rows whose window is short or holds a NULL, or whose context or target is missing, are left out.
    """
    cell = F.array(
        (F.col(stat).cast("float") - F.col(stat_avg).cast("float")).cast("float"),
        (F.col(minutes).cast("float") - F.col(minutes_avg).cast("float")).cast("float"),
    )
    complete = F.forall(F.col("__cell"), lambda x: x.isNotNull())

    def window(w: WindowSpec) -> Column:
        return F.collect_list(F.when(complete, F.col("__cell"))).over(w.rowsBetween(-(length - 1), 0))

    out = over_history(df.withColumn("__cell", cell), keys, order, Frames({"x_seq": window}, back=length - 1))
    static = [F.col(c).cast("float") for c in (stat_avg, minutes_avg)]
    actual, baseline = F.col(target).cast("float"), F.col(stat_avg).cast("float")
    return out.filter(
        (F.size("x_seq") == length) & static[0].isNotNull() & static[1].isNotNull() & actual.isNotNull()
    ).select(
        *keys, *order, "x_seq", F.array(*static).alias("x_static"), (actual - baseline).cast("float").alias("y_delta"),
        actual.alias("y_actual"), baseline.alias("baseline"), F.col(split).alias("split"),
    )
