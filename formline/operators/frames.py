"""Filters, projections, unions and reshapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.config import (
    FUTURE_PREFIXES, HORIZON_SUFFIXES, LOG_COLUMNS, LOG_NUMERIC, LOG_RENAMES, LOG_REQUIRED, METADATA_COLUMNS, SPLITS,
)
from formline.functions.scalars import (
    home_away_opponent, number, parse_minutes, season_end_year_from_date, season_label_from_end_year,
    snake_case_columns, true_shooting,
)
from formline.operators.topk import dedup_keep
from formline.operators.windows import rest_days

_NUMERIC = (T.NumericType,)


def canonicalize_logs(
    df: DataFrame, rename_map: Mapping[str, str] = LOG_RENAMES, first_year: int = 2017, last_year: int = 2025,
    tie: Sequence[str] = ("team_id",),
) -> DataFrame:
    """Raw box scores as canonical game logs: names, numbers, season, side, true shooting, rest."""
    logs = snake_case_columns(df).withColumnsRenamed(dict(rename_map))
    if "team_id" not in logs.columns and "team_abbreviation" in logs.columns:
        logs = logs.withColumn("team_id", F.col("team_abbreviation"))
    missing = [c for c in LOG_REQUIRED if c not in logs.columns]
    if missing:
        raise ValueError(f"Missing required player game-log columns: {missing}")
    numeric = {c: number(c) for c in LOG_NUMERIC if c in logs.columns}
    logs = logs.withColumns(
        {"game_date": F.col("game_date").try_cast("timestamp_ntz"), "minutes": parse_minutes("minutes"), **numeric}
    )
    have = set(logs.columns)
    if {"team_abbreviation", "home_team", "away_team"} <= have:
        logs = logs.withColumns(home_away_opponent("team_abbreviation", "home_team", "away_team"))
    if {"points", "fga", "fta"} <= have:
        logs = logs.withColumn("true_shooting_pct", true_shooting("points", "fga", "fta"))
    if "season_end_year" not in have:
        logs = logs.withColumn("season_end_year", season_end_year_from_date("game_date"))
    label = season_label_from_end_year("season_end_year")
    logs = logs.withColumns({"season_label": label, "season": label})
    logs = filter_period_between(filter_regular_season(logs), "season_end_year", first_year, last_year)
    logs = logs.select(*[c for c in LOG_COLUMNS if c in logs.columns])
    return rest_days(logs, ["player_id"], ["game_date", "game_id", *tie], "game_date")


def filter_regular_season(df: DataFrame) -> DataFrame:
    """Keep regular-season rows by the first text column that marks them; all rows if none does."""
    text = [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name != "season" and ("season" in f.name or "type" in f.name)
    ]
    if not text:
        return df
    has = {c: F.contains(F.lower(c), F.lit("regular")) for c in text}
    keep = F.lit(True)
    for c in reversed(text):  # decided by subqueries when the plan runs
        keep = F.when(F.coalesce(df.agg(F.max(has[c])).scalar(), F.lit(False)), has[c]).otherwise(keep)
    return df.filter(keep)


def filter_period_between(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[c for c in columns if c in df.columns])


def valid_salary_rows(df: DataFrame) -> DataFrame:
    return df.filter(
        (number("salary_usd") > 0) & (number("salary_cap_usd") > 0) & number("salary_cap_share").between(0, 1.5)
    )


def fill_unknown(df: DataFrame, columns: Sequence[str], value: str = "UNK") -> DataFrame:
    present = {c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = {f"{c}_was_missing": F.col(c).isNull() for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    wanted = df.columns if columns is None else columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in wanted if isinstance(kinds.get(c), _NUMERIC)]


def infer_features(
    df: DataFrame, targets: Sequence[str], exclude: Sequence[str] = (), horizon_guard: bool = False,
    observed_only: bool = False,
) -> list[str]:
    """Candidate feature columns: no metadata, targets or columns that look into the future."""
    out = {*targets, *METADATA_COLUMNS, *exclude}
    kept = [c for c in df.columns if c not in out and not c.startswith(FUTURE_PREFIXES)]
    if horizon_guard:
        kept = [c for c in kept if not c.endswith(HORIZON_SUFFIXES)]
    dates = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    kept = [c for c in kept if c not in dates]
    if observed_only and kept:
        counts = df.agg(*[F.count(c).alias(c) for c in kept]).first()
        kept = [c for c in kept if counts[c]]
    return kept


def split_rows(df: DataFrame, label: str = "train", split: str = "split") -> DataFrame:
    """Rows of a split, or all rows when it has none."""
    if split not in df.columns:
        return df
    rows = df.filter(F.col(split) == label)
    return df if rows.isEmpty() else rows


def keep_splits(df: DataFrame, split: str = "split", labels: Sequence[str] = SPLITS) -> DataFrame:
    return df.filter(F.col(split).isin(*labels))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def overlay(default: DataFrame, override: DataFrame, key: str, order: Sequence[str | Column] = ()) -> DataFrame:
    """Union of both with the override's row kept where both have the key."""
    both = union_all([default.withColumn("__rank", F.lit(1)), override.withColumn("__rank", F.lit(0))])
    return dedup_keep(both, [key], ["__rank", *order]).drop("__rank")


def long_by_stat(df: DataFrame, ids: Sequence[str], stats: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One row per stat: ``stats`` maps a label to {output column: source column}."""
    entries = [
        F.struct(F.lit(s).alias("stat"), *[F.col(src).cast("double").alias(out) for out, src in cols.items()])
        for s, cols in stats.items()
    ]
    names = list(next(iter(stats.values())))
    exploded = df.select(*ids, F.explode(F.array(*entries)).alias("__s"))
    return exploded.select(*ids, "__s.stat", *[f"__s.{n}" for n in names])


def add_constant_tags(df: DataFrame, tags: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})
