"""Gold-table builder queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.aggregate import LONG_ORDER, RECENT_SQL, SUMMARY_SQL
from catalog.registry import query
from catalog.views import DERIVED, LONG_SPLIT, SHORT_SPLIT, split_sql, table, view
from formline.config import PERCENT_COLUMNS, PERFORMANCE_BOUNDS, RATE_COLUMNS, ROLE_BOUNDS, ROLE_DIMENSIONS, ROLE_NUMERIC, SALARY_FEATURES
from formline.functions import scalars as S
from formline.operators import aggregates, labels, topk
from formline.plans import builders
from formline.session import cut


def ratio(c: str) -> str:
    return f"case when {c} <= 1.5 then {c} else {c} / 100 end"


_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def gold_table(spark, d: str, name: str, build) -> DataFrame:
    """A gold table written once per application; later queries read it, as after a gold build."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT:
        _BUILT[key] = cut(build())
    return _BUILT[key]


# --- role ---------------------------------------------------------------------------------
_RATES = ", ".join(f"{ratio(c)} as {c}" for c in RATE_COLUMNS)
_FILLS = ", ".join(f"coalesce({c}, (select median({c}) from role_raw)) as {c}" for c in ROLE_NUMERIC)
_FLAGS = ", ".join(f"{c} is null as {c}_was_missing" for c in (*ROLE_NUMERIC, "position"))
_DIMS = """points_per_100 * 0.45 + usage_pct * 40 * 0.35 + true_shooting_pct * 20 * 0.20 as scoring_creation,
    assists_per_100 * 0.70 + (1 - least(greatest(turnover_rate, 0), 1)) * 5 * 0.30 as playmaking,
    true_shooting_pct * 0.65 + least(greatest(three_point_attempt_rate, 0), 1) * 0.35 as shooting, free_throw_rate * 0.50 + usage_pct * 0.50 as rim_pressure,
    rebounds_per_100 * 0.55 + defensive_rebound_rate * 20 * 0.45 as rebounding, steal_rate * 0.75 + (1 - least(greatest(foul_rate, 0), 1)) * 0.25 as perimeter_defense,
    block_rate * 0.45 + defensive_rebound_rate * 0.35 + (1 - least(greatest(foul_rate, 0), 1)) * 0.20 as interior_defense, offensive_rating - defensive_rating as two_way_impact"""
DERIVED["role_raw"] = (("v_season_stats", "v_players"), f"""
    select s.* replace ({_RATES}), p.birth_date, p.position, p.height, p.weight
    from v_season_stats s left join v_players p on p.player_id = s.player_id""")
DERIVED["role"] = (("role_raw",), f"""
    select *, {_DIMS} from (select * replace ({_FILLS}, coalesce(position, 'UNK') as position), {_FLAGS} from role_raw) r""")


def role(spark, d):
    return builders.build_role_features(view(spark, d, "v_players"), view(spark, d, "v_season_stats"))


@query("role_features", f"select player_id, season, team_id, position, position_was_missing, age_was_missing, weight_was_missing, {', '.join((*ROLE_NUMERIC, *ROLE_DIMENSIONS))} from role",
       doubles=[*ROLE_NUMERIC, *ROLE_DIMENSIONS], digits=5, needs="role")
def _(spark, d):
    return role(spark, d).select("player_id", "season", "team_id", "position", "position_was_missing", "age_was_missing",
                                 "weight_was_missing", *ROLE_NUMERIC, *ROLE_DIMENSIONS)


def clip_sql(c: str, bounds) -> str:
    low, high = bounds
    out = c
    if low is not None:
        out = f"greatest({out}, {low})"
    if high is not None:
        out = f"least({out}, {high})"
    return f"case when {c} is not null then {out} end as {c}"


_CLIPPED = [c for c in ROLE_BOUNDS]
_SEASONAL = ", ".join(f"coalesce({c}, median({c}) over (partition by season)) as {c}" for c in _CLIPPED)
_GLOBAL = ", ".join(f"coalesce({c}, (select median({c}) from cr_fill), 0) as {c}" for c in _CLIPPED)
DERIVED["cr_fill"] = (("v_season_stats",), f"""
    select * replace ({_SEASONAL}) from (select *, usage_pct is null as usage_pct_was_missing from (select * replace ({', '.join(clip_sql(c, b) for c, b in ROLE_BOUNDS.items())})
    from (select * replace ({', '.join(f'{ratio(c)} as {c}' for c in PERCENT_COLUMNS)}, upper(trim(team_id)) as team_id) from v_season_stats) a) b) c""")


@query("clean_role", f"select * replace ({_GLOBAL}) from (select player_id, season, team_id, player_name, usage_pct_was_missing, {', '.join(_CLIPPED)} from cr_fill) x",
       doubles=_CLIPPED, digits=5, needs="cr_fill")
def _(spark, d):
    stats = view(spark, d, "v_season_stats")
    twice = stats.unionByName(stats.withColumn("season", F.when(F.col("season") > "2000", F.col("season"))))
    return builders.clean_role(twice).select("player_id", "season", "team_id", "player_name", "usage_pct_was_missing", *_CLIPPED)


_PB = {k: v for k, v in PERFORMANCE_BOUNDS.items() if "minus" not in k}


@query("clean_performance", f"select player_id, as_of_date, game_id, season, upper(team_id) as team_id, {', '.join(clip_sql(c, b) for c, b in _PB.items())} from performance",
       doubles=list(_PB), needs="performance")
def _(spark, d):
    from catalog.history import performance

    return builders.clean_performance(performance(spark, d)).select("player_id", "as_of_date", "game_id", "season", "team_id", *_PB)


# --- salary -------------------------------------------------------------------------------
_KEY = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
DERIVED["role_first"] = (("role",), "select * from (select *, row_number() over (partition by player_id, season order by team_id) as rn from role) x where rn = 1")
_ROLE_ONLY = [c for c in SALARY_FEATURES if c not in ("age", "height", "weight")]
DERIVED["salary_raw"] = (("v_salaries", "v_cap", "v_players", "role_first"), f"""
    select m.* exclude (money), m.money as salary_usd, c.salary_cap_usd, m.money / c.salary_cap_usd as salary_cap_share, m.money as target_salary_usd,
           p.player_id, coalesce(p.position, r.position) as position, coalesce(p.height, r.height) as height, coalesce(p.weight, r.weight) as weight,
           coalesce(date_diff('day', p.birth_date, make_date(m.season_start_year, 10, 1)) / 365.25, r.age) as age, {', '.join('r.' + c for c in _ROLE_ONLY)}
    from (select player_name, season_label, season_start_year, team, case upper(trim(team)) when 'BRK' then 'BKN' when 'PHO' then 'PHX' else upper(trim(team)) end as team_id,
                 try_cast(nullif(regexp_replace(salary_usd, '[^0-9.]', '', 'g'), '') as double) as money from v_salaries) m
    left join v_cap c on c.season = m.season_label
    left join v_players p on {_KEY.format('p.player_name')} = {_KEY.format('m.player_name')}
    left join role_first r on r.player_id = p.player_id and r.season = m.season_label""")
_MONEY = ("salary_usd", "salary_cap_usd", "salary_cap_share", "target_salary_usd")
DERIVED["salary"] = (("salary_raw",), f"""
    select * replace ({', '.join(f'coalesce({c}, (select median({c}) from salary_raw), 0) as {c}' for c in (*_MONEY, *SALARY_FEATURES))}, coalesce(position, 'UNK') as position),
           salary_usd is null as salary_usd_was_missing, {split_sql('season_label', LONG_SPLIT)} as split from salary_raw""")


def salary(spark, d):
    return builders.build_salary_training(
        view(spark, d, "v_salaries"), view(spark, d, "v_cap"), view(spark, d, "v_players"), gold_role(spark, d), LONG_SPLIT)


def gold_role(spark, d):
    return gold_table(spark, d, "role", lambda: role(spark, d))


def gold_salary(spark, d):
    return gold_table(spark, d, "salary", lambda: salary(spark, d))


_SALARY_OUT = ["player_name", "season_label", "season_start_year", "team", "team_id", "player_id", "position", "split", "salary_usd_was_missing"]


@query("salary_training", f"select {', '.join((*_SALARY_OUT, *_MONEY, *SALARY_FEATURES))} from salary",
       doubles=[*_MONEY, *SALARY_FEATURES], digits=3, needs="salary")
def _(spark, d):
    return salary(spark, d).select(*_SALARY_OUT, *_MONEY, *SALARY_FEATURES)


@query("clean_salary", """
    select player_name, season_label, upper(trim(team)) as team, position, salary_usd, salary_cap_share, least(greatest(age, 15), 50) as age from (
      select player_name, season_label, team, position, salary_usd, salary_cap_usd, case when salary_cap_share <= 1.5 then salary_cap_share else salary_cap_share / 100 end as salary_cap_share, age from salary) s
    where salary_usd > 0 and salary_cap_usd > 0 and salary_cap_share between 0 and 1.5""", doubles="salary_usd salary_cap_share age", digits=3, needs="salary")
def _(spark, d):
    out = builders.clean_salary(gold_salary(spark, d))
    return out.select("player_name", "season_label", "team", "position", "salary_usd", "salary_cap_share", "age")


_PREV = ("minutes", "usage_pct", "scoring_creation")
DERIVED["lagged"] = (("salary", "role"), f"""
    select s.player_id, s.player_name, s.season_label, s.season_start_year, s.salary_cap_share, s.age, p.salary_cap_share as previous_salary_cap_share, p.salary_usd as previous_salary_usd,
           r.team_id as prev_team_id, {', '.join(f'r.{c} as prev_{c}' for c in _PREV)}
    from salary s join salary p on p.player_id = s.player_id and p.season_start_year = s.season_start_year - 1
    join (select *, cast(substring(season, 1, 4) as int) as y, row_number() over (partition by player_id, substring(season, 1, 4) order by minutes desc nulls last, team_id) as rn from role) r
      on r.player_id = s.player_id and r.y = s.season_start_year - 1 and r.rn = 1""")
_TIER = "case when previous_salary_cap_share < 0.04 then 'minimum_bench' when previous_salary_cap_share < 0.10 then 'rotation' when previous_salary_cap_share < 0.22 then 'starter' else 'star' end"
_RISING = "coalesce(previous_salary_cap_share < 0.08 and prev_minutes >= 1800 and prev_usage_pct >= 0.2 and age <= 26, false)"


@query("lagged_salary", f"""
    select player_id, player_name, season_label, season_start_year, prev_team_id, salary_cap_share, previous_salary_cap_share, prev_minutes, prev_usage_pct,
           case when previous_salary_cap_share < 0.03 then 'minimum_or_low' when previous_salary_cap_share < 0.08 then 'rotation_contract' when previous_salary_cap_share < 0.18 then 'starter_contract' else 'premium_contract' end as previous_contract_band,
           salary_cap_share - previous_salary_cap_share as salary_delta_cap_share, salary_cap_share / nullif(previous_salary_cap_share, 0) as salary_ratio_to_previous,
           {_TIER} as salary_market_tier, case when age <= 24 then 'early' when age <= 29 then 'prime' when age <= 33 then 'late_prime' else 'aging' end as career_phase,
           {_RISING} as is_rising_candidate, case when {_RISING} then 'rising_candidate' else {_TIER} end as salary_segment,
           previous_salary_cap_share * age as previous_cap_share_x_age, previous_salary_cap_share * prev_usage_pct as previous_cap_share_x_usage, prev_minutes * prev_usage_pct as prev_minutes_x_usage,
           (case when {_TIER} in ('starter', 'star') then 1 else 0 end) * prev_scoring_creation as starter_or_star_x_scoring, (case when {_RISING} then 1 else 0 end) * prev_scoring_creation as rising_x_scoring,
           case when season_start_year <= 1998 then 'train' when season_start_year = 1999 then 'validation' when season_start_year = 2000 then 'test' end as split
    from lagged where season_start_year <= 2000""",
       doubles="salary_cap_share previous_salary_cap_share prev_minutes prev_usage_pct salary_delta_cap_share salary_ratio_to_previous previous_cap_share_x_age "
               "previous_cap_share_x_usage prev_minutes_x_usage starter_or_star_x_scoring rising_x_scoring", digits=5, needs="lagged")
def _(spark, d):
    return lagged(spark, d).select(
        "player_id", "player_name", "season_label", "season_start_year", "prev_team_id", "salary_cap_share", "previous_salary_cap_share", "prev_minutes", "prev_usage_pct",
        "previous_contract_band", "salary_delta_cap_share", "salary_ratio_to_previous", "salary_market_tier", "career_phase",
        "is_rising_candidate", "salary_segment", "previous_cap_share_x_age", "previous_cap_share_x_usage", "prev_minutes_x_usage",
        "starter_or_star_x_scoring", "rising_x_scoring", "split")


def lagged(spark, d):
    return builders.build_lagged_salary(gold_salary(spark, d), gold_role(spark, d), 1998, 1999, 2000)


@query("prepare_salary_modeling", f"select player_name, season_label, split, salary_cap_share, age from (select *, {split_sql('season_label', LONG_SPLIT)} as sp from salary) s where sp <> 'ignore'",
       doubles="salary_cap_share age", digits=5, needs="salary")
def _(spark, d):
    out = builders.prepare_salary_modeling(gold_salary(spark, d), ["age", "minutes"], LONG_SPLIT)
    return out.select("player_name", "season_label", "split", "salary_cap_share", "age")


# --- long term ----------------------------------------------------------------------------
_R = ("pts", "ast", "reb")


def horizon_sql(anchors: str, years: str, key: str = "player_id", year: str = "season_start_year", horizons=(1, 2, 3)) -> tuple[str, str]:
    """(columns, joins) of the calendar horizon labels of ``anchors`` alias a."""
    cols, joins = [], []
    for h in horizons:
        f = f"f{h}"
        seen, known = f"{f}.{key} is not null", f"a.{year} + {h} <= (select max({year}) from {years})"
        cols += [
            f"case when {seen} then ({f}.games_played > 0)::int when {known} then 0 end as active_h{h}",
            f"case when {seen} then {f}.games_played when {known} then 0 end as games_played_h{h}",
            f"{f}.minutes_per_game as minutes_per_game_h{h}",
            *[f"{f}.{s}_per_36 as {s}_per_36_h{h}" for s in _R],
            *[f"{f}.minutes_per_game * {f}.{s}_per_36 / 36 as {s}_per_game_h{h}" for s in _R],
        ]
        joins.append(f"left join {years} {f} on {f}.{key} = a.{key} and {f}.{year} = a.{year} + {h}")
    return ", ".join(cols), " ".join(joins)


HORIZON = [f"{c}_h{h}" for h in (1, 2, 3) for c in ("active", "games_played", "minutes_per_game", *[f"{s}_per_36" for s in _R], *[f"{s}_per_game" for s in _R])]
DERIVED["sparse_summary"] = (("v_logs_sparse",), """
    select player_id, season, cast(substring(season, 1, 4) as int) as season_start_year, count(distinct game_id) as games_played, avg(minutes) as minutes_per_game,
           sum(points) / sum(minutes) * 36 as pts_per_36, sum(assists) / sum(minutes) * 36 as ast_per_36, sum(rebounds) / sum(minutes) * 36 as reb_per_36
    from v_logs_sparse group by player_id, season""")


def sparse_summary(spark, d):
    return aggregates.season_summary(view(spark, d, "v_logs_sparse")).select(
        "player_id", "season", "season_start_year", "games_played", "minutes_per_game", "pts_per_36", "ast_per_36", "reb_per_36")


_C, _J = horizon_sql("a", "sparse_summary")


@query("horizon_targets", f"select a.player_id, a.season, {_C} from sparse_summary a {_J}", doubles=HORIZON, needs="sparse_summary")
def _(spark, d):
    return labels.horizon_targets(sparse_summary(spark, d)).select("player_id", "season", *HORIZON)


@query("horizon_targets_joined", f"select a.player_id, a.season, {_C} from sparse_summary a {_J}", doubles=HORIZON, needs="sparse_summary")
def _(spark, d):
    s = sparse_summary(spark, d)
    return labels.horizon_targets(s, s).select("player_id", "season", *HORIZON)


@query("horizon_targets_by_row", """
    select player_id, season, games_played_h1, games_played_h3, pts_per_36_h2, (games_played_h1 > 0)::int as active_h1, (games_played_h3 > 0)::int as active_h3,
           (games_played_h1 <= 20)::int as low_availability_h1, (games_played_h1 >= 61)::int as high_availability_h1
    from (select *, lead(games_played, 1) over w as games_played_h1, lead(games_played, 3) over w as games_played_h3, lead(pts_per_36, 2) over w as pts_per_36_h2
          from sparse_summary window w as (partition by player_id order by season_start_year)) x""",
       doubles="games_played_h1 games_played_h3 pts_per_36_h2 active_h1 active_h3 low_availability_h1 high_availability_h1", needs="sparse_summary")
def _(spark, d):
    return labels.horizon_targets_by_row(sparse_summary(spark, d)).select(
        "player_id", "season", "games_played_h1", "games_played_h3", "pts_per_36_h2", "active_h1", "active_h3", "low_availability_h1", "high_availability_h1")


@query("availability_risk", """
    select player_id, season, (games_played * 10 <= 20)::int as low_availability_h1, (games_played * 10 >= 61)::int as high_availability_h1 from sparse_summary""",
       doubles="low_availability_h1 high_availability_h1", needs="sparse_summary")
def _(spark, d):
    df = sparse_summary(spark, d).withColumn("games_played_h1", F.col("games_played") * 10)
    return labels.availability_risk(df).select("player_id", "season", "low_availability_h1", "high_availability_h1")


DERIVED["season_summary_v"] = (("v_logs_long",), SUMMARY_SQL)
DERIVED["recent_v"] = (("v_logs_long",), RECENT_SQL)
DERIVED["stats_first"] = (("v_season_stats",), "select * from (select *, row_number() over (partition by player_id, season order by team_id) as rn from v_season_stats) x where rn = 1")
DERIVED["anchors"] = (("season_summary_v", "stats_first", "v_players"), """
    with j as (select s.*, t.usage_pct, t.pace, p.position, p.birth_date from season_summary_v s left join stats_first t on t.player_id = s.player_id and t.season = s.season
               left join v_players p on p.player_id = s.player_id),
         m as (select season, median(pace) as p from j group by season),
         q as (select j.*, coalesce(j.pace, m.p) * total_minutes / 48 as estimated_possessions from j join m on m.season = j.season)
    select *, points / estimated_possessions * 100 as pts_per_100, date_diff('day', birth_date, season_end_date) / 365.25 as age_at_anchor,
           sum(games_played) over w as career_games, sum(total_minutes) over w as career_minutes, row_number() over w as years_in_league
    from q window w as (partition by player_id order by season_start_year rows between unbounded preceding and current row)""")
_HC, _HJ = horizon_sql("a", "anchors", horizons=(1, 2, 3))
_LT_H = list(HORIZON)
_LT_DOUBLES = ["age_at_anchor", "career_games", "career_minutes", "pts_per_100", "usage_pct_lag_0", "pts_per_36_lag_1", "total_minutes_lag_3", "pts_per_36_slope_3yr",
               "total_minutes_slope_3yr", "recent_pts_trend", "recent_pts_per_36", *_LT_H]
_LT_SQL = f"""
    with l as (select *, count(pts_per_36) over (partition by player_id order by season_start_year rows between unbounded preceding and current row) as i1 from anchors),
         t as (select *, usage_pct as usage_pct_lag_0, lag(pts_per_36, 1) over u as pts_per_36_lag_1, lag(total_minutes, 3) over u as total_minutes_lag_3,
                      case when count(pts_per_36) over w >= 2 then regr_slope(pts_per_36, i1) over w end as pts_per_36_slope_3yr,
                      case when count(total_minutes) over w >= 2 then regr_slope(total_minutes, i1) over w end as total_minutes_slope_3yr
               from l window u as (partition by player_id order by season_start_year), w as (partition by player_id order by season_start_year rows between 2 preceding and current row)),
         r as (select a.* exclude (i1), v.recent_games_count, v.recent_pts_trend, v.recent_pts_per_36, {_HC}, {split_sql('a.season', LONG_SPLIT)} as split
               from t a {_HJ} left join recent_v v on v.player_id = a.player_id and v.season = a.season)
    select player_id, season as anchor_season, team_id, position, split, years_in_league, recent_games_count, {', '.join(_LT_DOUBLES)} from r
    where active_h1 is not null and active_h2 is not null and active_h3 is not null and split <> 'ignore'"""


def long_term(spark, d, mode="calendar", horizons=(1, 2, 3)):
    return builders.build_long_term_training(
        view(spark, d, "v_logs_long"), view(spark, d, "v_players"), view(spark, d, "v_season_stats"), LONG_SPLIT, mode, horizons,
        order=LONG_ORDER, sums={"fga": "fga"}, means={"true_shooting_pct": "true_shooting_pct"})


@query("long_term_training", _LT_SQL, doubles=_LT_DOUBLES, digits=4, needs="anchors recent_v")
def _(spark, d):
    return long_term(spark, d).select("player_id", "anchor_season", "team_id", "position", "split", "years_in_league", "recent_games_count", *_LT_DOUBLES)


@query("long_term_training_by_row", f"""
    select player_id, season as anchor_season, split, games_played, games_played_h1, games_played_h2, games_played_h3, active_h2, low_availability_h2
    from (select *, lead(games_played, 1) over w as games_played_h1, lead(games_played, 2) over w as games_played_h2, lead(games_played, 3) over w as games_played_h3, (lead(games_played, 2) over w > 0)::int as active_h2,
                 (lead(games_played, 2) over w <= 20)::int as low_availability_h2, {split_sql('season', LONG_SPLIT)} as split
          from anchors window w as (partition by player_id order by season_start_year)) x where games_played_h3 is not null and split <> 'ignore'""", needs="anchors")
def _(spark, d):
    return long_term(spark, d, "row").select(
        "player_id", "anchor_season", "split", "games_played", "games_played_h1", "games_played_h2", "games_played_h3", "active_h2", "low_availability_h2")


@query("minutes_heuristic", """
    select player_id, season, l0 as last_mpg, 0.6 * l0 + 0.3 * coalesce(l1, l0) + 0.1 * coalesce(l2, l1, l0) as weighted,
           (0.6 * l0 + 0.3 * coalesce(l1, l0) + 0.1 * coalesce(l2, l1, l0)) * case when age > 30 then 1 - least(age - 30, 8) * 0.025 else 1 end as decayed
    from (select player_id, season, minutes_per_game as l0, lag(minutes_per_game) over w as l1, lag(minutes_per_game, 2) over w as l2,
                 case when player_id % 5 = 0 then null else 25.0 + player_id % 16 end as age
          from sparse_summary window w as (partition by player_id order by season_start_year)) x""", doubles="last_mpg weighted decayed", needs="sparse_summary")
def _(spark, d):
    from formline.operators.windows import lag_features

    df = lag_features(sparse_summary(spark, d), ["player_id"], ["season_start_year"], ["minutes_per_game"])
    df = df.withColumn("age_at_anchor", F.when(F.col("player_id") % 5 != 0, 25.0 + F.col("player_id") % 16))
    keys = {"last_mpg": "last_mpg", "weighted": "weighted_lag_mpg", "decayed": "age_decay_weighted_mpg"}
    return df.select("player_id", "season", *[labels.minutes_heuristic(k).alias(n) for n, k in keys.items()])


# --- source shapes ------------------------------------------------------------------------
@query("normalize_players", """
    select c_custkey as player_id, trim(concat('Customer ', split_part(c_name, '#', 2))) as player_name, date '1980-01-01' + cast(c_custkey % 5000 as int) as birth_date,
           case when c_custkey % 4 = 0 then 'G/F' when c_custkey % 4 = 1 then 'C' end as position, 70.0 + c_custkey % 10 as height, null::double as weight from customer""",
       doubles="height weight")
def _(spark, d):
    k = F.col("c_custkey")
    raw = table(spark, d, "customer").select(
        k.cast("string").alias("personId"), F.lit(" Customer").alias("firstName"), F.split("c_name", "#")[1].alias("lastName"),
        F.date_add(F.lit("1980-01-01").cast("date"), (k % 5000).cast("int")).cast("string").alias("birthDate"),
        (k % 4 == 0).cast("int").alias("guard"), (k % 4 == 0).cast("int").alias("forward"), (k % 4 == 1).cast("int").alias("center"),
        (70 + k % 10).cast("string").alias("heightInches"), F.lit("n/a").alias("bodyWeightLbs"))
    return builders.normalize_players(raw.unionByName(raw))


@query("normalize_advanced", """
    select p.player_id, upper(replace(p.player_name, '#', ' #')) as player_name, s.season, case when s.team_id <> 'N' then s.team_id when s.player_id % 2 = 0 then 'BKN' else 'LAL' end as team_id, s.minutes,
           case when s.usage_pct <= 1.5 then s.usage_pct else s.usage_pct / 100 end as usage_pct
    from v_season_stats s join v_players p on p.player_id = s.player_id""", doubles="minutes usage_pct", needs="v_season_stats v_players")
def _(spark, d):
    raw = view(spark, d, "v_season_stats").select(
        F.col("season").alias("Season"),
        F.concat(F.lit("SUPPLIER #"), F.lpad(F.col("player_id").cast("string"), 9, "0")).alias("Player"), F.when(F.col("team_id") != "N", F.col("team_id")).when(F.col("player_id") % 2 == 0, "brk").otherwise("LAL").alias("Team"),
        F.col("minutes").alias("MP"), F.col("usage_pct").alias("USG"))
    out = builders.normalize_advanced(raw, view(spark, d, "v_players"), {
        "player_name": "Player", "team_id": "Team", "minutes": "MP", "usage_pct": "USG"}, F.col("Season"))
    return out.select("player_id", "player_name", "season", "team_id", "minutes", "usage_pct")


@query("normalize_api_logs", """
    select *, cast(epoch_us(game_date) // 86400000000 - epoch_us(lag(game_date) over (partition by player_id order by game_date, game_id)) // 86400000000 as int) as rest_days
    from (select player_id, game_id, game_date, team_id, points, case when game_id % 2 = 0 then 'AWAY' else 'HOME' end as home_away, 'BOS' as opponent from v_logs_sparse) x""",
       doubles="points rest_days", needs="v_logs_sparse")
def _(spark, d):
    df = view(spark, d, "v_logs_sparse")
    raw = df.select(
        F.col("player_id").alias("PLAYER_ID"), F.col("game_id").alias("GAME_ID"), F.col("game_date").cast("string").alias("GAME_DATE"),
        F.col("season").alias("REQUESTED_SEASON"), F.col("team_id").alias("TEAM_ID"), F.col("minutes").alias("MIN"), F.col("points").alias("PTS"),
        F.col("assists").alias("AST"), F.col("rebounds").alias("REB"),
        F.when(F.col("game_id") % 2 == 0, "LAL @ BOS").otherwise("LAL vs. BOS").alias("MATCHUP"))
    return builders.normalize_api_logs(raw).select("player_id", "game_id", "game_date", "team_id", "points", "home_away", "opponent", "rest_days")


@query("normalize_api_season_stats", """
    select player_id, season, minutes, fg3a / nullif(fga, 0) as three_point_attempt_rate, coalesce(null, turnovers) as turnover_rate
    from (select player_id, season, sum(minutes) as minutes, sum(fg3a) as fg3a, sum(fga) as fga, sum(turnovers) as turnovers from v_logs_long group by 1, 2) x""",
       doubles="minutes three_point_attempt_rate turnover_rate", needs="v_logs_long")
def _(spark, d):
    raw = view(spark, d, "v_logs_long").groupBy(F.col("player_id").alias("PLAYER_ID"), F.col("season").alias("REQUESTED_SEASON")).agg(
        F.sum("minutes").alias("MIN"), F.sum("fg3a").alias("FG3A"), F.sum("fga").alias("FGA"), F.sum("turnovers").alias("TOV_PCT")).withColumn("TEAM_ID", F.lit(1))
    return builders.normalize_api_season_stats(raw).select("player_id", "season", "minutes", "three_point_attempt_rate", "turnover_rate")


@query("players_from_logs", "select player_id, min(player_name) as player_name, null::varchar as position from v_logs_long group by player_id", needs="v_logs_long")
def _(spark, d):
    return builders.players_from_logs(view(spark, d, "v_logs_long")).select("player_id", "player_name", "position")


@query("enrich_season_stats", """
    select b.player_id, b.season, b.team_id, b.minutes, a.usage_pct, coalesce(a.age, cast(substring(b.season, 1, 4) as int) - year(p.birth_date)) as age
    from v_season_stats b left join v_season_stats a on a.player_id = b.player_id and a.season = b.season and a.team_id = b.team_id
    left join v_players p on p.player_id = b.player_id""", doubles="minutes usage_pct age", needs="v_season_stats v_players")
def _(spark, d):
    stats = view(spark, d, "v_season_stats")
    base = stats.withColumns({c: F.lit(None).cast("double") for c in ("age", "usage_pct", "pace")})
    out = builders.enrich_season_stats(base, stats, view(spark, d, "v_players"))
    return out.select("player_id", "season", "team_id", "minutes", "usage_pct", "age")
