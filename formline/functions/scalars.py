"""Column -> Column cleaning, calendar and rate expressions. NaN never leaves these."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.config import POSITION_PARTS, TEAM_ALIASES


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Double, or NULL for text that is no number and for NaN."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def snake_case(name: str) -> str:
    """Column name in snake_case: ``Player Name!`` -> ``player_name``."""
    split = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name)
    return "_".join(part for part in re.split(r"[^a-zA-Z0-9]+", split) if part).lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def snake_case_text(c: Column | str) -> Column:
    """The snake_case rule applied to values instead of column names."""
    split = F.regexp_replace(_col(c), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.trim(F.regexp_replace(split, r"[^a-zA-Z0-9]+", "_"), F.lit("_")))


def name_key(c: Column | str, mode: str = "strict") -> Column:
    """Join key of a name: strict keeps ``[a-z0-9]`` only, light drops dots and apostrophes."""
    lowered = F.lower(_col(c).cast("string"))
    if mode == "strict":
        return F.regexp_replace(lowered, "[^a-z0-9]", "")
    if mode == "light":
        return F.translate(F.trim(lowered), ".'", "")
    raise ValueError(f"Unknown name key mode: {mode}")


def normalize_code(c: Column | str, aliases: Mapping[str, str] = TEAM_ALIASES) -> Column:
    """Trimmed upper-case code, with known aliases replaced."""
    code = F.upper(F.trim(_col(c).cast("string")))
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def percent_to_ratio(c: Column | str, cut: float = 1.5) -> Column:
    """Mixed percentages and ratios on ratio scale."""
    value = number(c)
    return F.when(value <= cut, value).otherwise(value / 100)


def parse_money(c: Column | str) -> Column:
    """Digits and dots of a currency text as a double; the sign is dropped."""
    digits = F.regexp_replace(_col(c).cast("string"), "[^0-9.]", "")
    return F.nullif(digits, F.lit("")).try_cast("double")


def normalize_season(c: Column | str) -> Column:
    """struct(start, end, label) of a season text such as ``2023-24`` or ``1999-2000``."""
    text, pattern = _col(c).cast("string"), r"(\d{4})\D+(\d{2,4})"
    start = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int")
    tail = F.nullif(F.regexp_extract(text, pattern, 2), F.lit(""))
    year = tail.try_cast("int")
    in_century = F.floor(start / 100).cast("int") * 100 + year
    short = F.when(in_century < start, in_century + 100).otherwise(in_century)
    end = F.when(F.length(tail) == 2, short).otherwise(year).cast("int")
    label = F.concat(start.cast("string"), F.lit("-"), F.right(end.cast("string"), F.lit(2)))
    return F.struct(start.alias("start"), end.alias("end"), label.alias("label"))


def season_start_year(c: Column | str, strict: bool = False) -> Column:
    """First four-digit run as a year; ``strict`` takes the first four characters."""
    text = _col(c).cast("string")
    if strict:
        return F.substring(text, 1, 4).try_cast("int")
    return F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")).try_cast("int")


def season_label_from_end_year(c: Column | str) -> Column:
    end = _col(c).cast("int")
    return F.concat((end - 1).cast("string"), F.lit("-"), F.right(end.cast("string"), F.lit(2)))


def season_end_year_from_date(c: Column | str, start_month: int = 7) -> Column:
    date = _col(c)
    return F.year(date) + F.when(F.month(date) >= start_month, 1).otherwise(0)


def parse_minutes(c: Column | str) -> Column:
    """``MM:SS`` or a plain number, in minutes."""
    text = F.trim(_col(c).cast("string"))
    parts = F.split(text, ":", 2)
    clock = parts[0].try_cast("double") + F.get(parts, F.lit(1)).try_cast("double") / 60
    return F.when(F.contains(text, F.lit(":")), clock).otherwise(number(text))


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero or either side is missing."""
    return F.try_divide(number(a), number(b))


def per_unit(a: Column | str, b: Column | str, scale: float, positive_only: bool = False) -> Column:
    """a per ``scale`` units of b (36 minutes, 100 possessions)."""
    rate = safe_divide(a, b) * scale
    return F.when(number(b) > 0, rate) if positive_only else rate


def true_shooting(points: Column | str, fga: Column | str, fta: Column | str) -> Column:
    return F.try_divide(number(points), 2 * (number(fga) + 0.44 * number(fta)))


def rate_columns() -> dict[str, Column]:
    """Season rates from season totals (minutes, points, fga, fta, ...)."""
    fga, fta, turnovers = number("fga"), number("fta"), number("turnovers")
    return {
        "points_per_100": per_unit("points", "minutes", 100),
        "assists_per_100": per_unit("assists", "minutes", 100),
        "rebounds_per_100": per_unit("rebounds", "minutes", 100),
        "true_shooting_pct": true_shooting("points", "fga", "fta"),
        "three_point_attempt_rate": safe_divide("fg3a", "fga"),
        "free_throw_rate": safe_divide("fta", "fga"),
        "turnover_rate": F.try_divide(turnovers, fga + 0.44 * fta + turnovers),
        "steal_rate": per_unit("steals", "minutes", 36),
        "block_rate": per_unit("blocks", "minutes", 36),
        "defensive_rebound_rate": per_unit("defensive_rebounds", "minutes", 36),
        "foul_rate": per_unit("personal_fouls", "minutes", 36),
    }


def rate_stats(df: DataFrame) -> DataFrame:
    return df.withColumns(rate_columns())


def standardize_position(c: Column | str) -> Column:
    """Valid position parts joined by ``/``; ``UNK`` when none is left."""
    parts = F.split(F.replace(F.upper(F.trim(_col(c))), F.lit("-"), F.lit("/")), "/")
    kept = F.array_join(F.filter(parts, lambda p: p.isin(*POSITION_PARTS)), "/")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("UNK"))


def position_from_flags(guard: Column | str, forward: Column | str, center: Column | str) -> Column:
    flags = zip("GFC", (guard, forward, center))
    return F.nullif(F.concat_ws("/", *[F.when(number(f) == 1, p) for p, f in flags]), F.lit(""))


def age_at(date: Column | str, birth: Column | str) -> Column:
    return F.datediff(_col(date), _col(birth)) / 365.25


def season_age(start_year: Column | str, birth: Column | str) -> Column:
    """Age on 1 October of the season's first year."""
    return age_at(F.make_date(_col(start_year).cast("int"), F.lit(10), F.lit(1)), birth)


def coarse_age(season: Column | str, birth: Column | str) -> Column:
    return (season_start_year(season, strict=True) - F.year(_col(birth))).cast("double")


def home_away_opponent(team: Column | str, home: Column | str, away: Column | str) -> dict[str, Column]:
    at_home = F.coalesce(_col(team) == _col(home), F.lit(False))
    return {
        "home_away": F.when(at_home, "HOME").otherwise("AWAY"),
        "opponent": F.when(at_home, _col(away)).otherwise(_col(home)),
    }


def parse_matchup(c: Column | str) -> dict[str, Column]:
    """Opponent and side from ``AAA vs. BBB`` or ``AAA @ BBB``."""
    text = _col(c)
    opponent = F.nullif(F.regexp_extract(text, r"(?:vs\.|@)\s+([A-Z]{2,3})", 1), F.lit(""))
    away = F.coalesce(F.contains(text, F.lit(" @ ")), F.lit(False))
    return {"opponent": opponent, "home_away": F.when(away, "AWAY").otherwise("HOME")}


def clamp(c: Column | str, low: float | None, high: float | None) -> Column:
    """Clip to [low, high]; NULL stays NULL although least/greatest would skip it."""
    value = _col(c)
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def clip(df: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    present = {c: clamp(number(c), *b) for c, b in bounds.items() if c in df.columns}
    return df.withColumns(present) if present else df


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    present = {c: number(c) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def interaction(df: DataFrame, pairs: Mapping[str, tuple[Column | str, Column | str]]) -> DataFrame:
    """Products of two columns; a boolean factor counts as 0 or 1."""
    return df.withColumns({n: number(_col(a).cast("double")) * number(_col(b).cast("double")) for n, (a, b) in pairs.items()})


def row_mean(columns: Sequence[Column | str]) -> Column:
    """Mean over columns, skipping NULLs; NULL when all are missing."""
    present = F.filter(F.array(*[_col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(present))


def bucketize(c: Column | str, bounds: Sequence[float], labels: Sequence[str], closed: bool = False) -> Column:
    """Label of the first bound above the value (at or above it when ``closed``); NULL -> unknown."""
    value, out = _col(c), F.when(_col(c).isNull(), "unknown")
    for bound, label in zip(bounds, labels):
        out = out.when(value <= bound if closed else value < bound, label)
    return out.otherwise(labels[len(bounds)])
