"""Gold tables composed from the operators; everything is lazy until written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.config import (
    FORM_STATS, HORIZONS, LAG_FEATURES, LONG_TERM_SPLIT, PERCENT_COLUMNS, PERFORMANCE_BOUNDS, RATE_COLUMNS,
    ROLE_BOUNDS, ROLE_NUMERIC, SALARY_BOUNDS, SALARY_FEATURES, SALARY_SPLIT, SEASON_STAT_COLUMNS, SHORT_TERM_SPLIT,
    SLOPE_FEATURES, STATS, STAT_SOURCES, STAT_TARGETS, SplitConfig,
)
from formline.functions.scalars import (
    age_at, clip, coarse_age, name_key, normalize_code, number, parse_matchup, parse_money, percent_to_ratio,
    position_from_flags, season_age, safe_divide, standardize_position,
)
from formline.operators.aggregates import estimated_possessions, recent_form, season_summary
from formline.operators.frames import (
    complete_cases, fill_unknown, keep_splits, missing_flags, numeric_columns, valid_salary_rows,
)
from formline.operators.imputing import fill_median, flag_and_fill
from formline.operators.joins import (
    coalesce_suffix, enrich_left, join_by_name_key, join_cap, join_role, lag_join_inner, lookup,
)
from formline.operators.labels import (
    contract_band, horizon_targets, horizon_targets_by_row, role_dimensions, salary_tiers,
)
from formline.operators.splits import assign_split, assign_split_year
from formline.operators.topk import dedup_keep
from formline.operators.windows import career_cumulative, form_features, rest_days, trajectory
from formline.session import cut
from formline.sources.tables import (
    Layers, load_game_logs, load_gold, load_players, load_salaries, load_salary_cap, load_season_stats, require_columns, write_gold,
)

_PLAYER_COLUMNS = ("birth_date", "position", "height", "weight")


#: Id of salaries whose player is not known; it joins with nothing.
UNKNOWN_PLAYER = -1


def _one_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key by ``order``, then by every other column, so that ties don't depend on partitioning."""
    return dedup_keep(df, keys, [*order, *sorted(c for c in df.columns if c not in (*keys, *order))])


# --- role ---------------------------------------------------------------------------------
def build_role_features(players: DataFrame, stats: DataFrame, variant: str = "weighted", fit_where: Column | None = None) -> DataFrame:
    """Season rates with player bio, imputed, plus role dimensions; one row per player, season, team.

    The rates and the joined rows are written: the join's probe, the search for gaps and the medians read them again.
    """
    rates = {c: percent_to_ratio(c) for c in RATE_COLUMNS if c in stats.columns}
    role = cut(stats.withColumns(rates) if rates else stats)
    bio = [c for c in _PLAYER_COLUMNS if c in players.columns]
    shared = [c for c in bio if c in role.columns]
    order = ["player_id", *[c for c in ("player_name", *bio) if c in players.columns]]
    if bio:
        role = enrich_left(role, players, ["player_id"], bio, order, "_player")
        fresh = {f"{c}_player": c for c in bio if c not in shared}
        role = coalesce_suffix(role.withColumnsRenamed(fresh), shared, ["_player"])
    numeric = [c for c in ROLE_NUMERIC if c in role.columns]
    role = cut(missing_flags(role, [*numeric, "position"]))
    role = fill_unknown(fill_median(role, numeric, fit_where), ["position", "team_id"])
    role = role_dimensions(role, variant)
    return _one_of(role, ["player_id", "season", "team_id"], sorted(numeric))


# --- performance --------------------------------------------------------------------------
def canonical_stats(logs: DataFrame) -> DataFrame:
    """``as_of_date`` and numeric ``pts``, ``ast``, ``reb``, ``min`` under their short names."""
    out = logs if "as_of_date" in logs.columns else logs.withColumn("as_of_date", F.col("game_date"))
    names = {}
    for short, long in STAT_SOURCES.items():
        source = long if long in out.columns else short
        require_columns(out, [source], "game logs")
        names[short] = number(source)
    return out.withColumns(names)


def performance_features(logs: DataFrame, min_history: int | str = 5, horizon: int = 5) -> DataFrame:
    order = ["as_of_date", "game_id"]
    return form_features(canonical_stats(logs), ["player_id", "season"], order, FORM_STATS, STATS, min_history, horizon)


def build_performance_training(
    logs: DataFrame, split: SplitConfig = SHORT_TERM_SPLIT, min_history: int | str = 5
) -> DataFrame:
    """Complete point-in-time rows with next-five-game targets and a split label."""
    features = performance_features(logs, min_history)
    needed = [f"{s}_{x}" for s in FORM_STATS for x in ("last_5", "last_10", "season_avg")]
    labelled = features.withColumn("split", assign_split("season", split))
    return keep_splits(complete_cases(labelled, [*needed, *STAT_TARGETS.values()]))


# --- salary -------------------------------------------------------------------------------
def build_salary_training(
    salaries: DataFrame, cap: DataFrame, players: DataFrame, role: DataFrame, split: SplitConfig = SALARY_SPLIT,
    name_mode: str = "strict", fit_where: Column | None = None,
) -> DataFrame:
    """Salary rows with cap share, bio, age and prior role features; rows outside the splits stay.

    Salaries and the joined rows are written: the joins' probes, the search for gaps and the medians read them again.
    """
    money = parse_money("salary_usd") if dict(salaries.dtypes)["salary_usd"] == "string" else number("salary_usd")
    team = F.col("team") if "team" in salaries.columns else F.lit("UNK")
    out = cut(salaries.withColumns({
        "salary_usd": money, "team": team, "team_id": F.coalesce(normalize_code(team), F.lit("UNK")),
    }))
    out = join_cap(out, cap).withColumn("target_salary_usd", F.col("salary_usd"))
    bio = [c for c in ("player_id", *_PLAYER_COLUMNS) if c in players.columns]
    out = join_by_name_key(out, players, bio, ["player_id"], mode=name_mode)
    if "birth_date" in out.columns:
        out = out.withColumn("age", season_age("season_start_year", F.col("birth_date").try_cast("date")))
    if "player_id" in out.columns and "player_id" in role.columns:
        out = join_role(out, role, [c for c in ("position", *SALARY_FEATURES) if c in role.columns], ["team_id"])
        out = coalesce_suffix(out, ["position", "height", "weight", "age"], ["_role"])
    numeric = [c for c in SALARY_FEATURES if c in out.columns]
    money_columns = ["salary_usd", "salary_cap_usd", "salary_cap_share"]
    out = cut(missing_flags(out, [*money_columns, *numeric]))
    out = fill_median(out, [*money_columns, "target_salary_usd", *numeric], fit_where)
    out = fill_unknown(out, ["team", "team_id", "position"])
    return out.withColumn("split", assign_split("season_label", split))


def build_lagged_salary(
    salary: DataFrame, role: DataFrame, train_max: int = 2022, validation: int = 2023, test: int = 2024,
    rising_usage: float = 0.20, fan_out: bool = False,
) -> DataFrame:
    """Target-season salaries with last season's salary and role only.

    A player with several teams last season contributes the row with most minutes, or one
    row per team when ``fan_out``.
    """
    money = ["salary_usd", "salary_cap_usd", "salary_cap_share"]
    base = salary.select(
        "player_id", "player_name", "season_label", "season_start_year", "age", "position", "height", "weight", *money
    ).dropna(subset=["player_id", "season_start_year", *money]).filter(F.col("player_id") != UNKNOWN_PLAYER)
    history = base.select(
        "player_id", "season_start_year", F.col("salary_usd").alias("salary_usd"), "salary_cap_share"
    )
    prior = lag_join_inner(base, history, "player_id", "season_start_year", prefix="previous_")
    roles = role.withColumn("season_start_year", F.substring("season", 1, 4).try_cast("int"))
    if not fan_out:
        roles = dedup_keep(roles, ["player_id", "season_start_year"], [F.col("minutes").desc_nulls_last(), F.col("team_id").asc()])
    out = lag_join_inner(prior, roles, "player_id", "season_start_year")
    out = out.withColumns({
        "previous_contract_band": contract_band("previous_salary_cap_share"),
        "salary_delta_cap_share": F.col("salary_cap_share") - F.col("previous_salary_cap_share"),
        "salary_ratio_to_previous": safe_divide("salary_cap_share", "previous_salary_cap_share"),
    })
    out = salary_tiers(out, rising_usage)
    return keep_splits(out.withColumn("split", assign_split_year("season_start_year", train_max, validation, test)))


def prepare_salary_modeling(salary: DataFrame, features: Sequence[str], split: SplitConfig = SALARY_SPLIT) -> DataFrame:
    """Split rows with numeric features, a non-negative share and no gaps."""
    out = keep_splits(salary.withColumn("split", assign_split("season_label", split)))
    out = out.withColumns({c: number(c) for c in (*features, "salary_cap_share", "salary_cap_usd", "salary_usd")})
    needed = [*features, "salary_cap_share", "salary_cap_usd", "salary_usd"]
    return complete_cases(out.filter(F.col("salary_cap_share") >= 0), needed)


# --- long term ----------------------------------------------------------------------------
def season_anchors(
    logs: DataFrame, players: DataFrame, stats: DataFrame | None, order: Sequence[str] = ("game_date", "game_id"),
    stats_order: Sequence[str] = ("team_id",), sums: dict | None = None, means: dict | None = None,
) -> DataFrame:
    """One row per player-season with totals, context, age and career counters.

    The totals, small next to the logs, are written to the checkpoint folder because pace
    medians, the probe for hot groups and the result read them.
    """
    out = season_summary(logs, order=order, sums=sums, means=means)
    if stats is not None:
        wanted = [c for c in ("usage_pct", "pace", "offensive_rating", "defensive_rating") if c in stats.columns]
        out = enrich_left(out, stats, ["player_id", "season"], wanted, stats_order)
    out = cut(out)
    if "pace" in out.columns:
        out = estimated_possessions(out)
    bio = [c for c in _PLAYER_COLUMNS if c in players.columns]
    out = enrich_left(out, players, ["player_id"], bio, ["player_id", *bio])
    age = age_at("season_end_date", F.col("birth_date").try_cast("date")) if "birth_date" in out.columns else F.lit(None).cast("double")
    out = out.withColumn("age_at_anchor", age)
    return career_cumulative(out, ["player_id"], ["season_start_year"])


def build_long_term_training(
    logs: DataFrame, players: DataFrame, stats: DataFrame | None, split: SplitConfig = LONG_TERM_SPLIT,
    mode: str = "calendar", horizons: Sequence[int] = HORIZONS, order: Sequence[str] = ("game_date", "game_id"),
    stats_order: Sequence[str] = ("team_id",), sums: dict | None = None, means: dict | None = None,
) -> DataFrame:
    """Season anchors with lags, slopes, recent form and future-horizon labels.

    ``mode`` is ``calendar`` (season year + h) or ``row`` (next observed seasons).
    """
    # totals, distinct games and recent form each read the logs: their columns are written once
    read = ["player_id", "season", *order, "player_name", "team_id", "game_date", "game_id", "minutes", "points", "assists", "rebounds"]
    logs = cut(logs.select(*dict.fromkeys([*read, *(sums or {}).values(), *(means or {}).values()])))
    anchors = cut(season_anchors(logs, players, stats, order, stats_order, sums, means))
    lagged = [c for c in LAG_FEATURES if c in anchors.columns]
    sloped = [c for c in SLOPE_FEATURES if c in anchors.columns]
    out = trajectory(anchors, ["player_id"], ["season_start_year"], lagged, sloped)
    out = horizon_targets(out, horizons=horizons) if mode == "calendar" else horizon_targets_by_row(out, horizons=horizons)
    out = lookup(out, recent_form(logs, ["player_id", "season"], order), ["player_id", "season"])
    out = complete_cases(out, [f"active_h{h}" for h in horizons])
    out = out.withColumns({
        "anchor_season": F.col("season"), "anchor_season_start_year": F.col("season_start_year"),
        "anchor_date": F.col("season_end_date"), "split": assign_split("season", split),
    })
    return keep_splits(out)


# --- cleaning -----------------------------------------------------------------------------
def _text(c: str) -> Column:
    return F.trim(F.col(c).cast("string"))


def _first_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by its remaining columns."""
    return dedup_keep(df, keys, [c for c in df.columns if c not in keys])


def clean_role(df: DataFrame) -> DataFrame:
    """Unique keyed rows, tidy text, ratios, plausible ranges, season-median imputation with flags."""
    out = _first_of(df.dropna(subset=["player_id", "season", "team_id"]), ["player_id", "season", "team_id"])
    tidy = {"season": F.col("season").cast("string"), "team_id": F.upper(_text("team_id"))}
    if "player_name" in out.columns:
        tidy["player_name"] = _text("player_name")
    if "position" in out.columns:
        tidy["position"] = standardize_position("position")
    tidy |= {c: percent_to_ratio(c) for c in PERCENT_COLUMNS if c in out.columns}
    out = clip(out.withColumns(tidy), ROLE_BOUNDS)
    numeric = [c for c in numeric_columns(out) if c != "player_id"]
    return flag_and_fill(out, numeric, "season")


def clean_performance(df: DataFrame) -> DataFrame:
    """Unique keyed complete rows with clipped stats."""
    keys = ["player_id", "as_of_date", "game_id", "team_id"]
    out = _first_of(df.dropna(subset=[*keys, "season"]), keys)
    out = out.withColumns({"season": F.col("season").cast("string"), "team_id": F.upper(_text("team_id"))})
    deltas = ("last_5_minus_season_avg", "last_10_minus_season_avg", "last_5_minus_last_10")
    features = [f"{s}_{x}" for s in FORM_STATS for x in ("last_5", "last_10", "season_avg", *deltas)]
    targets = [c for c in out.columns if c.startswith("target_next_5_") and c.endswith("_avg")]
    values = [c for c in (*FORM_STATS, *features, *targets) if c in out.columns]
    out = clip(complete_cases(out, values), PERFORMANCE_BOUNDS)
    return out.select("player_id", "as_of_date", "game_id", "season", "team_id", *values)


def clean_salary(df: DataFrame) -> DataFrame:
    """Valid unique salary rows with tidy text, plausible ranges and flagged imputation."""
    out = df.dropna(subset=["player_name", "season_label", "salary_usd", "salary_cap_usd", "salary_cap_share"])
    out = _first_of(out, ["player_name", "season_label", "team", "salary_usd"])
    if "player_id" in out.columns:
        out = missing_flags(out, ["player_id"]).withColumn("player_id", F.coalesce(F.col("player_id").try_cast("long"), F.lit(UNKNOWN_PLAYER)))
    tidy = {"player_name": _text("player_name"), "season_label": F.col("season_label").cast("string")}
    tidy |= {c: F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("UNK")))) for c in ("team", "team_id") if c in out.columns}
    if "position" in out.columns:
        tidy["position"] = standardize_position("position")
    tidy |= {c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("source", "source_file", "collected_at") if c in out.columns}
    tidy |= {c: percent_to_ratio(c) for c in (*PERCENT_COLUMNS, "salary_cap_share") if c in out.columns}
    out = clip(valid_salary_rows(out.withColumns(tidy)), SALARY_BOUNDS)
    numeric = [c for c in numeric_columns(out) if c != "player_id"]
    return flag_and_fill(out, numeric, "season_label")


# --- sequences ----------------------------------------------------------------------------
SEQUENCE_TASKS = {"points": ("pts", 10), "assists": ("ast", 10), "rebounds": ("reb", 15)}
_TASK_ALIASES = {"pts": "points", "ast": "assists", "reb": "rebounds"}


def sequence_task(task: str) -> tuple[str, str, str, int]:
    """(stat, average, target, length) of a sequence task or its alias."""
    name = _TASK_ALIASES.get(task, task)
    if name not in SEQUENCE_TASKS:
        raise KeyError(f"Unknown sequence task: {task}")
    stat, length = SEQUENCE_TASKS[name]
    return stat, f"{stat}_season_avg", STAT_TARGETS[stat], length


def prepare_sequences(df: DataFrame, task: str) -> DataFrame:
    """Complete rows of the columns a task needs."""
    stat, average, target, _ = sequence_task(task)
    columns = list(dict.fromkeys(
        ["player_id", "season", "as_of_date", "game_id", "split", "min", "min_season_avg", stat, average, target]
    ))
    return complete_cases(require_columns(df, columns, "sequence table"), columns)


# --- source shapes ------------------------------------------------------------------------
def players_from_logs(logs: DataFrame) -> DataFrame:
    """Minimal players table with empty bio columns."""
    named = logs.select("player_id", "player_name").dropna()
    out = dedup_keep(named, ["player_id"], ["player_name"])
    return out.withColumns({
        "birth_date": F.lit(None).cast("date"), "position": F.lit(None).cast("string"),
        "height": F.lit(None).cast("double"), "weight": F.lit(None).cast("double"),
    })


def normalize_players(raw: DataFrame) -> DataFrame:
    """Bio source (personId, firstName, ...) in the canonical players schema."""
    def part(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit(""))

    out = raw.select(
        F.col("personId").try_cast("long").alias("player_id"),
        F.trim(F.concat_ws(" ", part("firstName"), part("lastName"))).alias("player_name"),
        F.col("birthDate").try_cast("date").alias("birth_date"),
        position_from_flags("guard", "forward", "center").alias("position"),
        number("heightInches").alias("height"), number("bodyWeightLbs").alias("weight"),
    )
    return _one_of(out.dropna(subset=["player_id"]), ["player_id"], ["player_name", "birth_date"])


def player_lookup(players: DataFrame) -> DataFrame:
    """Name key -> player id, one id per name."""
    named = dedup_keep(players.select("player_id", "player_name").dropna(), ["player_id"], ["player_name"])
    keyed = named.select(name_key("player_name").alias("player_name_key"), "player_id")
    return dedup_keep(keyed, ["player_name_key"], ["player_id"])


def normalize_advanced(raw: DataFrame, players: DataFrame, renames: dict[str, str], season: Column) -> DataFrame:
    """Advanced-stat source keyed by player name, on ratio scale, in the season-stats schema.

    ``renames`` maps canonical column -> source column.
    """
    keyed = raw.withColumn("player_name_key", name_key(renames["player_name"]))
    source = keyed.drop("player_id") if "player_id" in keyed.columns else keyed
    joined = lookup(source, player_lookup(players), ["player_name_key"])
    columns = {"player_id": F.col("player_id"), "player_name": F.col(renames["player_name"]), "season": season}
    for name, col in renames.items():
        if name == "team_id":
            columns[name] = normalize_code(col)
        elif name != "player_name":
            columns[name] = percent_to_ratio(col) if name in RATE_COLUMNS else number(col)
    out = joined.select(*[c.alias(n) for n, c in columns.items()]).dropna(subset=["player_id"])
    return _one_of(out, ["player_id", "season", "team_id"], ["player_name"])


def normalize_api_logs(raw: DataFrame, tie: Sequence[str] = ("team_id",)) -> DataFrame:
    """League game-log source (PLAYER_ID, MATCHUP, ...) as canonical logs with rest days."""
    names = {
        "player_id": "PLAYER_ID", "player_name": "PLAYER_NAME", "game_id": "GAME_ID", "season": "REQUESTED_SEASON",
        "team_id": "TEAM_ID", "team_abbreviation": "TEAM_ABBREVIATION", "minutes": "MIN", "points": "PTS",
        "assists": "AST", "rebounds": "REB",
    }
    out = raw.select(
        *[F.col(src).alias(n) for n, src in names.items() if src in raw.columns],
        F.col("GAME_DATE").try_cast("timestamp_ntz").alias("game_date"),
        *[c.alias(n) for n, c in parse_matchup("MATCHUP").items()],
        F.lit(None).cast("double").alias("usage_pct"), F.lit(None).cast("double").alias("true_shooting_pct"),
    )
    return rest_days(out, ["player_id"], ["game_date", "game_id", *tie], "game_date")


def normalize_api_season_stats(raw: DataFrame) -> DataFrame:
    """League season-stat source in the canonical schema; absent columns are NULL."""
    def col(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("double")

    made = {
        "player_id": col("PLAYER_ID"), "player_name": col("PLAYER_NAME").cast("string"), "season": col("REQUESTED_SEASON"),
        "team_id": col("TEAM_ID"), "age": col("AGE"), "minutes": col("MIN"), "usage_pct": col("USG_PCT"),
        "points_per_100": col("PTS"), "assists_per_100": col("AST"), "rebounds_per_100": col("REB"),
        "true_shooting_pct": col("TS_PCT"), "three_point_attempt_rate": safe_divide(col("FG3A"), col("FGA")),
        "free_throw_rate": safe_divide(col("FTA"), col("FGA")), "turnover_rate": F.coalesce(col("TM_TOV_PCT"), col("TOV_PCT")),
        "steal_rate": col("STL_PCT"), "block_rate": col("BLK_PCT"), "offensive_rating": col("OFF_RATING"),
        "defensive_rating": col("DEF_RATING"),
    }
    return raw.select(*[c.alias(n) for n, c in made.items()])


def enrich_season_stats(base: DataFrame, advanced: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """Box-score rates completed from advanced stats (exact team, then most minutes) and coarse age."""
    from formline.operators.joins import enrich_with_fallback

    shared = [c for c in (
        "player_name", "age", "minutes", *RATE_COLUMNS, "pace", "possessions", "offensive_rating", "defensive_rating",
    ) if c != "foul_rate"]
    out = enrich_with_fallback(base, advanced, shared)
    if players is not None and "birth_date" in players.columns:
        known = players.select("player_id", "birth_date").dropna()
        out = enrich_left(out, known, ["player_id"], ["birth_date"], ["birth_date"])
        out = out.withColumn("age", F.coalesce("age", coarse_age("season", F.col("birth_date").try_cast("date")))).drop("birth_date")
    return out.select(*[c for c in SEASON_STAT_COLUMNS if c in out.columns])


# --- whole build --------------------------------------------------------------------------
def build_all_gold(spark: SparkSession, root: str, partition_by: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All gold tables from the layers below ``root``, written as parquet."""
    layers = Layers(root)
    players, logs = load_players(spark, layers), load_game_logs(spark, layers)
    stats, cap = load_season_stats(spark, layers), load_salary_cap(spark, layers)
    write_gold(layers, {"player_role_features_clean": build_role_features(players, stats)}, partition_by)
    role = load_gold(spark, layers, "player_role_features_clean")
    frames = {
        "performance_training_clean": build_performance_training(logs),
        "salary_training_clean": build_salary_training(load_salaries(spark, layers), cap, players, role),
        "long_term_player_forecast_training": build_long_term_training(logs, players, stats),
    }
    write_gold(layers, frames, partition_by)
    return {"player_role_features_clean": role, **frames}
