"""Constants, thresholds and column lists that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: codes and label sets ---------------------------------------------------
TEAM_ALIASES = {
    "BRK": "BKN",
    "CHO": "CHA",
    "PHO": "PHX",
    "NOH": "NOP",
    "NOK": "NOP",
    "NJN": "BKN",
}
POSITION_PARTS = ("G", "F", "C", "PG", "SG", "SF", "PF")
SPLITS = ("train", "validation", "test")

# --- fixed values: season cap and tax level in USD ----------------------------------------
SALARY_CAPS = [
    ("1999-00", 34000000, None),
    ("2000-01", 35500000, None),
    ("2001-02", 42500000, None),
    ("2002-03", 40271000, 52880000),
    ("2003-04", 43840000, 54556722),
    ("2004-05", 43870000, None),
    ("2005-06", 49500000, 61700000),
    ("2006-07", 53135000, 65420000),
    ("2007-08", 55630000, 67865000),
    ("2008-09", 58680000, 71150000),
    ("2009-10", 57700000, 69920000),
    ("2010-11", 58044000, 70307000),
    ("2011-12", 58044000, 70307000),
    ("2012-13", 58044000, 70307000),
    ("2013-14", 58679000, 71748000),
    ("2014-15", 63065000, 76829000),
    ("2015-16", 70000000, 84740000),
    ("2016-17", 94143000, 113287000),
    ("2017-18", 99093000, 119266000),
    ("2018-19", 101869000, 123733000),
    ("2019-20", 109140000, 132627000),
    ("2020-21", 109140000, 132627000),
    ("2021-22", 112414000, 136606000),
    ("2022-23", 123655000, 150267000),
    ("2023-24", 136021000, 165294000),
    ("2024-25", 140588000, 170814000),
    ("2025-26", 154647000, 187895000),
]

# --- fixed values: season constants -------------------------------------------------------
REGULAR_SEASON_GAMES = 82
HORIZONS = (1, 2, 3)
CAREER_LAGS = 4
RECENT_GAMES = 20
LOW_AVAILABILITY_GAMES = 20
HIGH_AVAILABILITY_GAMES = 61

# --- fixed values: column lists -----------------------------------------------------------
STATS = ("pts", "ast", "reb")
FORM_STATS = ("pts", "ast", "reb", "min")
STAT_SOURCES = {"pts": "points", "ast": "assists", "reb": "rebounds", "min": "minutes"}
STAT_TARGETS = {
    "pts": "target_next_5_pts_avg",
    "ast": "target_next_5_ast_avg",
    "reb": "target_next_5_reb_avg",
}
PERCENT_COLUMNS = (
    "usage_pct", "true_shooting_pct", "three_point_attempt_rate", "free_throw_rate", "turnover_rate",
)
RATE_COLUMNS = (*PERCENT_COLUMNS, "steal_rate", "block_rate", "defensive_rebound_rate", "foul_rate")
ROLE_NUMERIC = (
    "age", "height", "weight", "minutes", "usage_pct", "points_per_100", "assists_per_100",
    "rebounds_per_100", "true_shooting_pct", "three_point_attempt_rate", "free_throw_rate",
    "turnover_rate", "steal_rate", "block_rate", "defensive_rebound_rate", "foul_rate", "pace",
    "possessions", "offensive_rating", "defensive_rating",
)
ROLE_DIMENSIONS = (
    "scoring_creation", "playmaking", "shooting", "rim_pressure", "rebounding",
    "perimeter_defense", "interior_defense", "two_way_impact",
)
SALARY_FEATURES = (
    "age", "height", "weight", "minutes", "usage_pct", "points_per_100", "assists_per_100",
    "rebounds_per_100", "true_shooting_pct", "three_point_attempt_rate", "free_throw_rate",
    "turnover_rate", "steal_rate", "block_rate", "defensive_rebound_rate", "foul_rate",
    *ROLE_DIMENSIONS,
)
SIMILARITY_FEATURES = (
    "minutes", "usage_pct", "points_per_100", "assists_per_100", "rebounds_per_100",
    "true_shooting_pct", "three_point_attempt_rate", "free_throw_rate", "turnover_rate",
    "steal_rate", "block_rate", "defensive_rebound_rate", "foul_rate", *ROLE_DIMENSIONS,
)
SEASON_STAT_COLUMNS = (
    "player_id", "player_name", "season", "team_id", "age", "minutes", "usage_pct", "points_per_100",
    "assists_per_100", "rebounds_per_100", "true_shooting_pct", "three_point_attempt_rate",
    "free_throw_rate", "turnover_rate", "steal_rate", "block_rate", "defensive_rebound_rate",
    "foul_rate", "pace", "possessions", "offensive_rating", "defensive_rating",
)
LAG_FEATURES = (
    "age_at_anchor", "games_played", "minutes_per_game", "total_minutes", "availability_rate",
    "pts_per_36", "ast_per_36", "reb_per_36", "pts_per_100", "ast_per_100", "reb_per_100",
    "fga_per_36", "fta_per_36", "true_shooting_pct", "usage_pct",
)
SLOPE_FEATURES = (
    "games_played", "minutes_per_game", "pts_per_36", "ast_per_36", "reb_per_36", "pts_per_100",
    "ast_per_100", "reb_per_100", "total_minutes",
)
LOG_RENAMES = {
    "gameid": "game_id", "date": "game_date", "playerid": "player_id", "player": "player_name",
    "person_id": "player_id", "person_name": "player_name", "team": "team_abbreviation",
    "team_tricode": "team_abbreviation", "min": "minutes", "pts": "points", "ast": "assists",
    "reb": "rebounds", "rebounds_total": "rebounds", "oreb": "offensive_rebounds",
    "dreb": "defensive_rebounds", "stl": "steals", "blk": "blocks", "pf": "personal_fouls",
    "home": "home_team", "away": "away_team", "tov": "turnovers", "3_pm": "fg3m", "3_pa": "fg3a",
    "3pm": "fg3m", "3pa": "fg3a",
}
LOG_REQUIRED = ("player_id", "game_id", "game_date", "team_id", "minutes", "points", "assists", "rebounds")
LOG_NUMERIC = (
    "points", "assists", "rebounds", "offensive_rebounds", "defensive_rebounds", "steals", "blocks",
    "personal_fouls", "turnovers", "fgm", "fga", "fg3m", "fg3a", "ftm", "fta",
)
LOG_COLUMNS = (
    "player_id", "player_name", "game_date", "game_id", "season", "season_end_year", "season_label",
    "team_id", "team_abbreviation", "opponent", "home_away", "minutes", *LOG_NUMERIC, "true_shooting_pct",
)
METADATA_COLUMNS = (
    "player_id", "player_name", "season", "season_label", "anchor_season", "anchor_season_start_year",
    "anchor_date", "as_of_date", "game_id", "team_id", "split",
)
FUTURE_PREFIXES = (
    "target_", "active_h", "games_played_h", "minutes_per_game_h", "pts_per_36_h", "ast_per_36_h",
    "reb_per_36_h", "low_availability_h", "high_availability_h",
)
HORIZON_SUFFIXES = ("_h1", "_h2", "_h3")

# --- fixed values: plausible ranges -------------------------------------------------------
ROLE_BOUNDS = {
    "age": (15, 50), "minutes": (0, None), "usage_pct": (0, 0.6), "true_shooting_pct": (0, 1.5),
    "three_point_attempt_rate": (0, 1), "free_throw_rate": (0, 2), "turnover_rate": (0, 1),
    "points_per_100": (0, 100), "assists_per_100": (0, 60), "rebounds_per_100": (0, 60),
    "steal_rate": (0, 10), "block_rate": (0, 10), "defensive_rebound_rate": (0, 40),
    "foul_rate": (0, 15), "pace": (80, 120), "possessions": (0, None),
    "offensive_rating": (50, 160), "defensive_rating": (50, 160),
}
PERFORMANCE_BOUNDS = {
    "pts": (0, 100), "ast": (0, 40), "reb": (0, 40), "min": (0, 60), "min_last_5": (0, 48),
    "min_last_10": (0, 48), "min_season_avg": (0, 48), "min_last_5_minus_season_avg": (-48, 48),
    "min_last_10_minus_season_avg": (-48, 48), "min_last_5_minus_last_10": (-48, 48),
}
SALARY_BOUNDS = {
    "age": (15, 50), "height": (60, 96), "weight": (130, 360), "salary_usd": (1, None),
    "salary_cap_usd": (1, None), "salary_cap_share": (0, 1.5), "usage_pct": (0, 0.6),
    "true_shooting_pct": (0, 1.5), "three_point_attempt_rate": (0, 1), "free_throw_rate": (0, 2),
    "turnover_rate": (0, 1), "steal_rate": (0, 10), "block_rate": (0, 10),
    "defensive_rebound_rate": (0, 40), "foul_rate": (0, 15), "pace": (80, 120),
    "offensive_rating": (50, 160), "defensive_rating": (50, 160),
}

# --- fixed values: label boundaries -------------------------------------------------------
CONTRACT_BANDS = ((0.03, 0.08, 0.18), ("minimum_or_low", "rotation_contract", "starter_contract", "premium_contract"))
MARKET_TIERS = ((0.04, 0.10, 0.22), ("minimum_bench", "rotation", "starter", "star"))
CAREER_PHASES = ((24, 29, 33), ("early", "prime", "late_prime", "aging"))


@dataclass(frozen=True)
class TrendConfig:
    """Tolerances of the direction labels per stat."""

    pts: float = 3.0
    ast: float = 1.0
    reb: float = 1.2
    minutes: float = 3.0
    overall: float = 0.5


@dataclass(frozen=True)
class ConsistencyConfig:
    min_games: int = 10
    quantiles: tuple[float, float, float] = (0.20, 0.50, 0.80)
    consistent: float = -0.5
    volatile: float = 0.5


@dataclass(frozen=True)
class RangeConfig:
    season_avg: float = 0.563203
    last_10: float = 0.308359
    last_5: float = 0.128438
    window: int = 10
    min_periods: int = 5
    multiplier: float = 0.825154
    fallback: str | None = "period"


@dataclass(frozen=True)
class SplitConfig:
    """Split by season label: explicit sets first, else start year up to ``train_end``."""

    train_end: str | None = None
    train: tuple[str, ...] = ()
    validation: tuple[str, ...] = ()
    test: tuple[str, ...] = ()
    default: str = "ignore"
    null: str | None = None


SHORT_TERM_SPLIT = SplitConfig(train_end="2022-23", validation=("2023-24",), test=("2024-25",))
LONG_TERM_SPLIT = SplitConfig(train_end="2019-20", validation=("2020-21",), test=("2021-22",))
SALARY_SPLIT = SplitConfig(
    train=("2016-17", "2017-18", "2018-19", "2019-20", "2020-21", "2021-22", "2022-23"),
    validation=("2023-24",), test=("2024-25",),
)


@dataclass(frozen=True)
class QualityConfig:
    """What a training table must satisfy."""

    required: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    split: str = "split"
    allowed_splits: tuple[str, ...] = SPLITS
    keys: tuple[str, ...] = ()
    max_feature_missing: float = 0.0
    max_target_missing: float = 0.0
    require_all_splits: bool = True
