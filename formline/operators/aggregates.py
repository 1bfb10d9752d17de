"""Season, recent-form and distribution aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.config import RECENT_GAMES, REGULAR_SEASON_GAMES, SEASON_STAT_COLUMNS
from formline.functions.scalars import clamp, number, per_unit, rate_stats, row_mean, season_start_year
from formline.operators.joins import join_same, lookup
from formline.operators.ordered import Frames, hot_groups, over_history
from formline.operators.quantiles import group_quantiles
from formline.operators.topk import tail_per_key
from formline.operators.windows import carry_fill

__all__ = [
    "season_summary", "season_stats", "estimated_possessions", "recent_form", "consistency_stats",
    "value_counts", "target_summary", "segment_median", "string_join_distinct", "row_mean",
]


def total(c: str) -> Column:
    """Sum in which nothing observed counts as zero."""
    return F.coalesce(F.sum(number(c)), F.lit(0.0))


def distinct_counts(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct values per group from a shuffle of (keys, value) alone.

    Next to other aggregates a distinct count would drag all their buffers through that shuffle.
    """
    counted = df.select(*keys, column).distinct()
    return counted.groupBy(*keys).agg(F.count(column).alias(name))


def season_summary(
    logs: DataFrame, keys: Sequence[str] = ("player_id", "season"), order: Sequence[str] = ("game_date", "game_id"),
    sums: Mapping[str, str] | None = None, means: Mapping[str, str] | None = None,
) -> DataFrame:
    """Per player-season: last name and team, games, minutes, totals, availability, per-36 rates.

    ``sums`` and ``means`` add optional columns (output -> source); a sum also gets a per-36 rate.
    """
    sums = dict(sums or {})
    means = dict(means or {})
    last = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))) for c in ("player_name", "team_id")}
    known = logs.dropna(subset=list(keys))
    grouped = known.groupBy(*keys).agg(
        *[agg.alias(c) for c, agg in last.items()],
        F.max("game_date").alias("season_end_date"),
        total("minutes").alias("total_minutes"),
        F.avg(number("minutes")).alias("minutes_per_game"),
        *[total(c).alias(c) for c in ("points", "assists", "rebounds")],
        *[total(src).alias(out) for out, src in sums.items()],
        *[F.avg(number(src)).alias(out) for out, src in means.items()],
    )
    grouped = grouped.join(distinct_counts(known, keys, "game_id", "games_played"), list(keys))
    rates = {f"{s}_per_36": per_unit(c, "total_minutes", 36) for s, c in
             {"pts": "points", "ast": "assists", "reb": "rebounds", **{o: o for o in sums}}.items()}
    return grouped.withColumns({
        "season_start_year": season_start_year("season"),
        "availability_rate": clamp(F.col("games_played") / REGULAR_SEASON_GAMES, 0, 1),
        **rates,
    })


def season_stats(logs: DataFrame, keys: Sequence[str] = ("player_id", "player_name", "season", "team_id")) -> DataFrame:
    """Season totals and rates per player, season and team; NULL keys form their own group."""
    optional = ["turnovers", "fga", "fg3a", "fta", "steals", "blocks", "defensive_rebounds", "personal_fouls"]
    summed = ["minutes", "points", "assists", "rebounds", *[c for c in optional if c in logs.columns]]
    grouped = logs.groupBy(*keys).agg(*[total(c).alias(c) for c in summed])
    grouped = join_same(grouped, distinct_counts(logs, keys, "game_id", "games"), keys, None)
    absent = [c for c in optional if c not in logs.columns]
    grouped = grouped.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else grouped
    out = rate_stats(grouped)
    unknown = ("age", "usage_pct", "pace", "possessions", "offensive_rating", "defensive_rating")
    out = out.withColumns({c: F.lit(None).cast("double") for c in unknown})
    return out.select(*SEASON_STAT_COLUMNS, "games", "points", "assists", "rebounds")


def estimated_possessions(df: DataFrame) -> DataFrame:
    """Pace (own, season median, then nearest year's median) times minutes / 48, and per-100 rates."""
    by_season = group_quantiles(df, ["season"], ["pace"], [0.5]).select("season", F.col("pace__q")[0].alias("__season_pace"))
    distinct = df.select("season_start_year", "season", "pace").distinct()
    by_year = group_quantiles(distinct.dropna(subset=["season_start_year"]), ["season_start_year"], ["pace"], [0.5])
    by_year = by_year.select("season_start_year", F.col("pace__q")[0].alias("__year_pace"))
    by_year = carry_fill(by_year, [], ["season_start_year"], "__year_pace")
    out = lookup(lookup(df, by_season, ["season"]), by_year, ["season_start_year"])
    pace = F.coalesce(number("pace"), "__season_pace", "__year_pace")
    out = out.withColumn("estimated_possessions", pace * number("total_minutes") / 48)
    rates = {"pts": "points", "ast": "assists", "reb": "rebounds"}
    out = out.withColumns({f"{s}_per_100": per_unit(c, "estimated_possessions", 100, True) for s, c in rates.items()})
    return out.drop("__season_pace", "__year_pace")


def recent_form(
    logs: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = RECENT_GAMES,
    sums: Mapping[str, str] | None = None, means: Mapping[str, str] | None = None,
) -> DataFrame:
    """Last n games per group: count, means, per-36 rates and OLS slopes on the game index.

    Each slope is indexed over the observed values of its own stat.
    """
    slopes = {"minutes": "minutes", "pts": "points", "ast": "assists", "reb": "rebounds"}
    rates = {"pts": "points", "ast": "assists", "reb": "rebounds", **(sums or {})}
    tail = tail_per_key(logs.dropna(subset=list(keys)), keys, order, n)
    index = {f"__i_{s}": ("count", F.col(c)) for s, c in slopes.items()}
    tail = over_history(tail, keys, order, Frames(running=index), hot=None)  # at most n rows per group
    minutes = F.coalesce(F.sum("minutes"), F.lit(0.0))
    return tail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("recent_games_count"),
        F.avg("minutes").alias("recent_minutes_per_game"),
        *[F.avg(src).alias(out) for out, src in (means or {}).items()],
        *[
            F.when(F.count(c) >= 2, F.regr_slope(F.col(c).cast("double"), F.col(f"__i_{s}").cast("double")))
            .alias(f"recent_{s}_trend")
            for s, c in slopes.items()
        ],
        *[
            F.when(minutes > 0, F.coalesce(F.sum(c), F.lit(0.0)) / minutes * 36).alias(f"recent_{s}_per_36")
            for s, c in rates.items()
        ],
    )


def consistency_stats(
    df: DataFrame, keys: Sequence[str], stats: Sequence[str], min_games: int = 10,
    fractions: Sequence[float] = (0.2, 0.5, 0.8),
) -> DataFrame:
    """Distribution of each stat per group: mean, std, cv, quantiles, share above the mean."""
    values = df.withColumns({s: number(s) for s in stats})
    hot = hot_groups(values, keys)
    with_mean = over_history(values, keys, [], Frames(whole={f"__m_{s}": F.avg(s) for s in stats}), hot)
    aggs = [F.count(F.lit(1)).alias("games_observed")]
    for s in stats:
        above = F.when(F.col(s).isNotNull(), (F.col(s) > F.col(f"__m_{s}")).cast("double"))
        aggs += [
            F.avg(s).alias(f"{s}_mean"), F.stddev_pop(s).alias(f"{s}_std"), F.avg(above).alias(f"{s}_above_mean_rate"),
        ]
    if hot is None:
        # small groups: quantiles ride along in the same aggregate
        wanted = F.array(*[F.lit(float(p)) for p in fractions])
        aggs += [F.percentile(s, wanted).alias(f"{s}__q") for s in stats]
    out = with_mean.groupBy(*keys).agg(*aggs).filter(F.col("games_observed") >= min_games)
    if hot is not None:
        out = join_same(out, group_quantiles(values, keys, stats, fractions, hot), keys, None)
    extra = {}
    for s in stats:
        extra[f"{s}_cv"] = F.when(F.col(f"{s}_mean") > 0, F.col(f"{s}_std") / F.col(f"{s}_mean"))
        extra |= {f"{s}_p{round(p * 100)}": F.col(f"{s}__q")[i] for i, p in enumerate(fractions)}
    return out.withColumns(extra).drop(*[f"{s}__q" for s in stats])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per label, NULL included."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("row_pct", F.col("rows") / counts.agg(F.sum("rows")).scalar())


def target_summary(df: DataFrame, columns: Sequence[str], fractions: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Observed rows, missing share, mean, sample std and quantiles per column."""
    present = [c for c in columns if c in df.columns]
    long = _melt(df, present)
    stats = long.groupBy("target").agg(
        F.count("value").alias("non_null_rows"),
        F.avg(F.col("value").isNull().cast("double")).alias("missing_pct"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )
    quantiles = group_quantiles(long, ["target"], ["value"], fractions)
    out = stats.join(quantiles, "target", "left")
    named = {f"p{round(p * 100)}": F.col("value__q")[i] for i, p in enumerate(fractions)}
    return out.withColumns(named).drop("value__q")


def _melt(df: DataFrame, columns: Sequence[str], names: tuple[str, str] = ("target", "value")) -> DataFrame:
    cast = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot([], list(columns), *names)


def segment_median(df: DataFrame, segment: str, value: str, name: str = "segment_median") -> DataFrame:
    """Median per segment next to the global median as ``global_median``."""
    per = group_quantiles(df, [segment], [value], [0.5]).select(segment, F.col(f"{value}__q")[0].alias(name))
    whole = group_quantiles(df, [], [value], [0.5]).select(F.col(f"{value}__q")[0])
    return per.withColumn("global_median", whole.scalar())


def string_join_distinct(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Sorted distinct labels of each group joined by a comma; labels are deduplicated first."""
    distinct = df.select(*keys, column).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias(name))
