"""Labels, buckets and deterministic signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.config import (
    CAREER_PHASES, CONTRACT_BANDS, FORM_STATS, HIGH_AVAILABILITY_GAMES, HORIZONS, LOW_AVAILABILITY_GAMES,
    MARKET_TIERS, STATS, STAT_TARGETS, ConsistencyConfig, RangeConfig, TrendConfig,
)
from formline.functions.scalars import bucketize, clamp, interaction, number, row_mean, season_start_year
from formline.operators.aggregates import consistency_stats, segment_median
from formline.operators.joins import future_lookup_left, join_same, lookup
from formline.operators.ordered import Frames, over_history
from formline.operators.quantiles import group_quantiles
from formline.operators.topk import latest_per_key
from formline.operators.windows import last_std, robust_z, shifted
from formline.session import cut

HISTORY_KEYS = ("player_id", "season")
HISTORY_ORDER = ("as_of_date", "game_id")


# --- future horizons ----------------------------------------------------------------------
def horizon_targets(
    anchors: DataFrame, summary: DataFrame | None = None, key: str = "player_id", year: str = "season_start_year",
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """Calendar horizons: the season ``year + h``.

    A season that was observed but lacks the player counts as inactive with 0 games; a season
    after the last observed one leaves the labels NULL. Anchors that are their own summary
    (one row per key and year) look ahead in one window: the season ``year + h`` is within
    the next h rows or absent. Another summary is written once and joined per horizon.
    """
    if summary is not None:
        itself = summary is anchors
        summary = cut(summary)
        anchors = summary if itself else cut(anchors)
    source = anchors if summary is None else summary
    rates = [f"{s}_per_{n}" for s in STATS for n in (36, 100)]
    columns = [c for c in ("games_played", "minutes_per_game", *rates) if c in source.columns]
    out = anchors.withColumn("__last", source.agg(F.max(year)).scalar())
    if summary is None:
        out = _ahead(out, key, year, horizons, columns)
    for h in horizons:
        if summary is not None:
            out = future_lookup_left(out, summary, key, year, h, columns)
        present, games = F.col(f"present_h{h}"), F.col(f"games_played_h{h}")
        observed = (F.col(year) + h) <= F.col("__last")
        labels = {
            f"active_h{h}": F.when(present, F.coalesce((games > 0).cast("int"), F.lit(0))).when(observed, 0),
            f"games_played_h{h}": F.when(present, games).when(observed, F.lit(0)),
        }
        for s in STATS:
            rate = f"{s}_per_36_h{h}"
            if f"{s}_per_36" in columns:
                labels[f"{s}_per_game_h{h}"] = F.col(f"minutes_per_game_h{h}") * F.col(rate) / 36
        if "age_at_anchor" in anchors.columns:
            labels[f"age_at_h{h}"] = F.col("age_at_anchor") + h
        out = out.withColumns(labels).drop(f"present_h{h}")
    return out.drop("__last")


def _ahead(df: DataFrame, key: str, year: str, horizons: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """``<column>_h`` and ``present_h`` of the row exactly h years later, from one look-ahead window."""
    row = F.struct(F.col(year).alias("year"), *columns)
    steps = {f"__n{i}": shifted("__row", -i) for i in range(1, max(horizons) + 1)}
    out = over_history(df.withColumn("__row", row), [key], [year], Frames(steps, ahead=max(horizons)))
    made = {}
    for h in horizons:
        hits = [F.when(F.col(f"__n{i}.year") == F.col(year) + h, F.col(f"__n{i}")) for i in range(1, h + 1)]
        made[f"__hit{h}"] = F.coalesce(*hits)
    out = out.withColumns(made)
    for h in horizons:
        out = out.withColumns({
            f"present_h{h}": F.col(f"__hit{h}").isNotNull(), **{f"{c}_h{h}": F.col(f"__hit{h}.{c}") for c in columns},
        })
    return out.drop("__row", *steps, *made)


def horizon_targets_by_row(
    df: DataFrame, keys: Sequence[str] = ("player_id",), order: Sequence[str] = ("season_start_year",),
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """Row horizons: the next observed seasons; an unobserved future stays NULL."""
    sources = [c for c in ("games_played", "pts_per_36", "ast_per_36", "reb_per_36") if c in df.columns]
    made = {f"{c}_h{h}": shifted(c, -h) for h in horizons for c in sources}
    out = over_history(df, keys, order, Frames(made, ahead=max(horizons)))
    active = {f"active_h{h}": (F.col(f"games_played_h{h}") > 0).cast("int") for h in horizons}
    return availability_risk(out.withColumns(active), horizons)


def availability_risk(df: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """0/1 labels of few or many games per horizon, NULL kept."""
    labels = {}
    for h in horizons:
        if f"games_played_h{h}" in df.columns:
            games = number(f"games_played_h{h}")
            labels[f"low_availability_h{h}"] = (games <= LOW_AVAILABILITY_GAMES).cast("int")
            labels[f"high_availability_h{h}"] = (games >= HIGH_AVAILABILITY_GAMES).cast("int")
    return df.withColumns(labels) if labels else df


# --- signals ------------------------------------------------------------------------------
def classify_direction(delta: Column | str, tolerance: float) -> Column:
    value = F.col(delta) if isinstance(delta, str) else delta
    return F.when(value > tolerance, "improving").when(value < -tolerance, "declining").otherwise("stable")


def direction_score(label: Column | str) -> Column:
    value = F.col(label) if isinstance(label, str) else label
    return F.when(value == "improving", 1).when(value == "declining", -1).otherwise(0)


def trend_signals(df: DataFrame, config: TrendConfig = TrendConfig()) -> DataFrame:
    """Latest row per player-season with directions per stat and overall."""
    latest = latest_per_key(df, HISTORY_KEYS, HISTORY_ORDER)
    latest = latest.withColumns({f"{s}_recent_delta": F.col(f"{s}_last_5") - F.col(f"{s}_season_avg") for s in FORM_STATS})
    tolerances = {"pts_trend": config.pts, "ast_trend": config.ast, "reb_trend": config.reb, "minutes_trend": config.minutes}
    latest = latest.withColumns({
        name: classify_direction(f"{'min' if name == 'minutes_trend' else name[:3]}_recent_delta", tol)
        for name, tol in tolerances.items()
    })
    score = sum((direction_score(f"{s}_trend") for s in STATS[1:]), direction_score(f"{STATS[0]}_trend"))
    return latest.select(
        "player_id", "season", season_start_year("season", strict=True).alias("season_start_year"), "team_id",
        "as_of_date", *[f"{s}_recent_delta" for s in FORM_STATS], *tolerances,
        score.alias("production_trend_score"),
        classify_direction(score, config.overall).alias("overall_trend"),
    )


def consistency_signals(
    df: DataFrame, config: ConsistencyConfig = ConsistencyConfig(),
    keys: Sequence[str] = ("player_id", "season", "team_id"), stats: Sequence[str] = FORM_STATS,
) -> DataFrame:
    """Distribution per group, volatility z within the season, and a label."""
    # one row per group: written once, since the z-scores read it several times
    base = cut(consistency_stats(df, keys, stats, config.min_games, config.quantiles))
    scored = robust_z(base, ["season"], {f"{s}_cv": f"{s}_volatility_z" for s in stats})
    scores = {f"{s}_consistency_score": clamp(-F.col(f"{s}_volatility_z"), -3, 3) for s in stats}
    overall = row_mean([f"{s}_volatility_z" for s in stats])
    out = scored.withColumns({
        "season_start_year": season_start_year("season", strict=True), **scores, "overall_volatility_score": overall,
    })
    label = (
        F.when(F.col("overall_volatility_score") <= config.consistent, "consistent")
        .when(F.col("overall_volatility_score") >= config.volatile, "volatile").otherwise("balanced")
    )
    return out.withColumn("consistency_label", label)


def range_columns(stat: str, config: RangeConfig, sigma: Column) -> dict[str, Column]:
    """Expected value, floor, ceiling and width of a stat."""
    expected = (
        config.season_avg * F.col(f"{stat}_season_avg") + config.last_10 * F.col(f"{stat}_last_10")
        + config.last_5 * F.col(f"{stat}_last_5")
    )
    floor, ceiling = clamp(expected - config.multiplier * sigma, 0, None), expected + config.multiplier * sigma
    suffix = f"next_5_{stat}_avg"
    return {
        f"expected_{suffix}": expected, f"floor_{suffix}": floor, f"ceiling_{suffix}": ceiling,
        f"range_width_{suffix}": ceiling - floor,
    }


def with_volatility(df: DataFrame, config: RangeConfig = RangeConfig(), stats: Sequence[str] = STATS) -> DataFrame:
    """``<stat>_sigma``: rolling std, else the season's sample std, else 0."""
    rolling = {f"__roll_{s}": last_std(s, config.window, config.min_periods) for s in stats}
    out = over_history(df, HISTORY_KEYS, HISTORY_ORDER, Frames(rolling, back=config.window - 1))
    fallback = [f"__roll_{s}" for s in stats]
    if config.fallback == "period":
        season = df.groupBy("season").agg(*[F.stddev_samp(s).alias(f"__season_{s}") for s in stats])
        out = join_same(out, season, ["season"])
    sigma = {
        s: F.coalesce(F.col(f"__roll_{s}"), *([F.col(f"__season_{s}")] if config.fallback == "period" else []), F.lit(0.0))
        for s in stats
    }
    return out.withColumns({f"{s}_sigma": c for s, c in sigma.items()}).drop(*fallback, *[f"__season_{s}" for s in stats])


def range_signals(df: DataFrame, config: RangeConfig = RangeConfig(), targets: Mapping[str, str] = STAT_TARGETS) -> DataFrame:
    """Expected, floor and ceiling of the next games, for rows whose targets are known."""
    out = with_volatility(df, config, list(targets))
    ids = ["player_id", "as_of_date", "game_id", "season", "team_id", "split"]
    made: dict[str, Column] = {}
    for s in targets:
        made |= range_columns(s, config, F.col(f"{s}_sigma"))
    ranged = out.withColumns(made).dropna(subset=list(targets.values()))
    return ranged.select(*ids, *made, *targets.values())


def value_signals(df: DataFrame, predicted: str = "predicted_salary_usd", actual: str = "salary_usd", tolerance: float = 0.10) -> DataFrame:
    ratio = F.try_divide(F.col(predicted), F.col(actual))
    label = (
        F.when(ratio >= 1 + tolerance, "underpaid").when(ratio <= 1 - tolerance, "overpaid").otherwise("fair_value")
    )
    return df.withColumns({
        "salary_value_gap_usd": F.col(predicted) - F.col(actual), "salary_value_ratio": ratio, "salary_value_label": label,
    })


# --- salary buckets -----------------------------------------------------------------------
def contract_band(c: Column | str) -> Column:
    return bucketize(c, *CONTRACT_BANDS)


def market_tier(c: Column | str) -> Column:
    return bucketize(c, *MARKET_TIERS)


def career_phase(c: Column | str) -> Column:
    return bucketize(c, *CAREER_PHASES, closed=True)


def salary_tiers(df: DataFrame, rising_usage: float = 0.20) -> DataFrame:
    """Tier, phase, rising flag, segment and interactions known before the target season."""
    share, usage, age = F.col("previous_salary_cap_share"), F.col("prev_usage_pct"), F.col("age")
    rising = (share < 0.08) & (F.col("prev_minutes") >= 1800) & (usage >= rising_usage) & (age <= 26)
    out = df.withColumns({
        "salary_market_tier": market_tier(share), "career_phase": career_phase(age),
        "is_rising_candidate": F.coalesce(rising, F.lit(False)),
    })
    segment = F.when(F.col("is_rising_candidate"), "rising_candidate").otherwise(F.col("salary_market_tier"))
    return interaction(out.withColumn("salary_segment", segment), {
        "previous_cap_share_x_age": (share, age),
        "previous_cap_share_x_usage": (share, usage),
        "prev_minutes_x_usage": ("prev_minutes", usage),
        "starter_or_star_x_scoring": (F.col("salary_market_tier").isin("starter", "star"), "prev_scoring_creation"),
        "rising_x_scoring": ("is_rising_candidate", "prev_scoring_creation"),
    })


# --- role dimensions ----------------------------------------------------------------------
def role_dimensions(df: DataFrame, variant: str = "weighted") -> DataFrame:
    """Eight composites of season rates, weighted or as plain means."""
    c = F.col
    if variant == "mean":
        made = {
            "scoring_creation": row_mean(["points_per_100", "usage_pct", "free_throw_rate"]),
            "playmaking": row_mean(["assists_per_100", "usage_pct"]) - F.coalesce(c("turnover_rate"), F.lit(0.0)),
            "shooting": row_mean(["true_shooting_pct", "three_point_attempt_rate"]),
            "rim_pressure": row_mean(["free_throw_rate", "points_per_100"]),
            "rebounding": row_mean(["rebounds_per_100", "defensive_rebound_rate"]),
            "perimeter_defense": c("steal_rate"),
            "interior_defense": row_mean(["block_rate", "defensive_rebound_rate"]),
        }
    elif variant == "weighted":
        unit = {k: clamp(k, 0, 1) for k in ("turnover_rate", "three_point_attempt_rate", "foul_rate")}
        made = {
            "scoring_creation": c("points_per_100") * 0.45 + c("usage_pct") * 40 * 0.35 + c("true_shooting_pct") * 20 * 0.20,
            "playmaking": c("assists_per_100") * 0.70 + (1 - unit["turnover_rate"]) * 5 * 0.30,
            "shooting": c("true_shooting_pct") * 0.65 + unit["three_point_attempt_rate"] * 0.35,
            "rim_pressure": c("free_throw_rate") * 0.50 + c("usage_pct") * 0.50,
            "rebounding": c("rebounds_per_100") * 0.55 + c("defensive_rebound_rate") * 20 * 0.45,
            "perimeter_defense": c("steal_rate") * 0.75 + (1 - unit["foul_rate"]) * 0.25,
            "interior_defense": c("block_rate") * 0.45 + c("defensive_rebound_rate") * 0.35 + (1 - unit["foul_rate"]) * 0.20,
        }
    else:
        raise ValueError(f"Unknown role variant: {variant}")
    return df.withColumns({**made, "two_way_impact": c("offensive_rating") - c("defensive_rating")})


# --- prediction targets and baselines -----------------------------------------------------
def target_mode(mode: str) -> Column:
    """Training target of a salary row."""
    modes = {
        "cap_share": number("salary_cap_share"), "log_salary_usd": F.log1p(number("salary_usd")),
        "delta_cap_share": number("salary_delta_cap_share") if mode == "delta_cap_share" else None,
    }
    if mode not in modes:
        raise ValueError(f"Unsupported target mode: {mode}")
    return modes[mode]


def prediction_to_share(prediction: Column | str, mode: str) -> Column:
    """Raw prediction of a mode as a cap share, clipped at 0."""
    raw = F.col(prediction) if isinstance(prediction, str) else prediction
    if mode == "cap_share":
        return clamp(raw, 0, None)
    if mode == "log_salary_usd":
        return F.try_divide(clamp(F.expm1(raw), 0, None), number("salary_cap_usd"))
    if mode == "delta_cap_share":
        return clamp(number("previous_salary_cap_share") + raw, 0, None)
    raise ValueError(f"Unsupported target mode: {mode}")


def residual_correction(df: DataFrame, train: Column, actual: str, predicted: str, segment: str = "salary_segment") -> DataFrame:
    """Add the training rows' median residual of the segment (or overall), clipped at 0."""
    # residuals and their medians, a row a segment, are written once; the rest reads only these
    fit = cut(df.filter(train).select(segment, (F.col(actual) - F.col(predicted)).alias("__res")))
    medians = cut(segment_median(fit, segment, "__res", "__seg"))
    overall = medians.agg(F.max("global_median")).first()[0]
    out = lookup(df, medians.select(segment, "__seg"), [segment])
    corrected = F.col(predicted) + F.coalesce(F.col("__seg"), F.lit(overall).cast("double"))
    return out.withColumn("corrected", clamp(corrected, 0, None)).drop("__seg")


def minutes_heuristic(key: str) -> Column:
    """Future minutes per game from the last seasons' minutes."""
    lag0, lag1, lag2 = (number(f"minutes_per_game_lag_{i}") for i in range(3))
    if key == "last_mpg":
        return lag0
    weighted = 0.60 * lag0 + 0.30 * F.coalesce(lag1, lag0) + 0.10 * F.coalesce(lag2, lag1, lag0)
    if key == "weighted_lag_mpg":
        return weighted
    if key == "age_decay_weighted_mpg":
        years = clamp(number("age_at_anchor") - 30, 0, 8)
        return weighted * F.coalesce(1 - years * 0.025, F.lit(1.0))
    raise ValueError(f"Unsupported minutes heuristic: {key}")


def naive_last_n(stat: str, n: int = 5) -> Column:
    return F.col(f"{stat}_last_{n}")


def season_average(stat: str) -> Column:
    return F.col(f"{stat}_season_avg")


def train_median_baseline(df: DataFrame, target: str, train: Column, name: str = "prediction") -> DataFrame:
    median = group_quantiles(df.filter(train), [], [target], [0.5]).select(F.col(f"{target}__q")[0]).scalar()
    return df.withColumn(name, median)


def previous_value_baseline(df: DataFrame, previous: str, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, F.col(previous))


def clip_prediction(c: Column | str, kind: str) -> Column:
    """Rates are not negative; minutes lie in [0, 48]."""
    return clamp(c, 0, 48 if kind == "minutes" else None)
