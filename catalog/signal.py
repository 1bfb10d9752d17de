"""Signal and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregate import CONSISTENCY, consistency_sql
from catalog.history import performance
from catalog.registry import query
from catalog.views import view
from formline.config import FORM_STATS, STATS, RangeConfig
from formline.operators import labels
from formline.operators.metrics import evaluate_ranges


def direction_sql(x: str, tol: float) -> str:
    return f"case when {x} > {tol} then 'improving' when {x} < -{tol} then 'declining' else 'stable' end"


def _score(x: str) -> str:
    return f"case {x} when 'improving' then 1 when 'declining' then -1 else 0 end"


@query("classify_direction", f"""
    select game_id, {direction_sql('x', 3.0)} as label from (select game_id, pts_last_5 - pts_season_avg as x from form) f""", needs="form")
def _(spark, d):
    from formline.plans.builders import performance_features

    df = performance_features(view(spark, d, "v_logs_short"))
    return df.select("game_id", labels.classify_direction(F.col("pts_last_5") - F.col("pts_season_avg"), 3.0).alias("label"))


@query("trend_signals", f"""
    select *, {_score('pts_trend')} + {_score('ast_trend')} + {_score('reb_trend')} as production_trend_score,
           {direction_sql(f"({_score('pts_trend')} + {_score('ast_trend')} + {_score('reb_trend')})", 0.5)} as overall_trend
    from (select player_id, season, cast(substring(season, 1, 4) as int) as season_start_year, team_id, as_of_date, pts_recent_delta, ast_recent_delta, reb_recent_delta, min_recent_delta,
                 {direction_sql('pts_recent_delta', 3.0)} as pts_trend, {direction_sql('ast_recent_delta', 1.0)} as ast_trend,
                 {direction_sql('reb_recent_delta', 1.2)} as reb_trend, {direction_sql('min_recent_delta', 3.0)} as minutes_trend
          from (select *, {', '.join(f'{s}_last_5 - {s}_season_avg as {s}_recent_delta' for s in FORM_STATS)},
                       row_number() over (partition by player_id, season order by as_of_date desc, game_id desc) as rn from performance) a where rn = 1) b""",
       doubles=[f"{s}_recent_delta" for s in FORM_STATS], needs="performance")
def _(spark, d):
    return labels.trend_signals(performance(spark, d))


def _z(s: str) -> str:
    return (f"case when mad_{s} is null or mad_{s} = 0 then case when sd_{s} is null or sd_{s} = 0 then 0 else ({s}_cv - av_{s}) / sd_{s} end "
            f"else 0.6745 * ({s}_cv - md_{s}) / mad_{s} end")


_CS = ("points", "rebounds")
_BASE = consistency_sql(_CS, "v_logs_long", "player_id, season, team_id", 10)
_MED = ", ".join(f"median({s}_cv) over (partition by season) as md_{s}, avg({s}_cv) over (partition by season) as av_{s}, stddev_pop({s}_cv) over (partition by season) as sd_{s}" for s in _CS)
_MAD = ", ".join(f"median(abs({s}_cv - md_{s})) over (partition by season) as mad_{s}" for s in _CS)
_KEEP = ", ".join(f"{s}_{x}" for s in _CS for x in CONSISTENCY)


@query("consistency_signals", f"""
    select player_id, season, team_id, games_observed, {_KEEP}, cast(substring(season, 1, 4) as int) as season_start_year,
           points_volatility_z, rebounds_volatility_z, least(greatest(-points_volatility_z, -3), 3) as points_consistency_score,
           least(greatest(-rebounds_volatility_z, -3), 3) as rebounds_consistency_score,
           (points_volatility_z + rebounds_volatility_z) / 2 as overall_volatility_score,
           case when (points_volatility_z + rebounds_volatility_z) / 2 <= -0.5 then 'consistent' when (points_volatility_z + rebounds_volatility_z) / 2 >= 0.5 then 'volatile' else 'balanced' end as consistency_label
    from (select *, {_z('points')} as points_volatility_z, {_z('rebounds')} as rebounds_volatility_z
          from (select *, {_MAD} from (select *, {_MED} from ({_BASE}) a) b) c) e""",
       doubles=[*[f"{s}_{x}" for s in _CS for x in (*CONSISTENCY, "volatility_z", "consistency_score")], "overall_volatility_score"],
       digits=5, needs="v_logs_long")
def _(spark, d):
    return labels.consistency_signals(view(spark, d, "v_logs_long"), stats=_CS)


def range_sql(config: RangeConfig = RangeConfig()) -> str:
    sigma = ", ".join(
        f"coalesce(case when count({s}) over w >= 5 then stddev_pop({s}) over w end, stddev_samp({s}) over (partition by season), 0) as {s}_sigma" for s in STATS)
    expected = ", ".join(
        f"{config.season_avg} * {s}_season_avg + {config.last_10} * {s}_last_10 + {config.last_5} * {s}_last_5 as expected_next_5_{s}_avg" for s in STATS)
    bounds = ", ".join(
        f"greatest(expected_next_5_{s}_avg - {config.multiplier} * {s}_sigma, 0) as floor_next_5_{s}_avg, "
        f"expected_next_5_{s}_avg + {config.multiplier} * {s}_sigma as ceiling_next_5_{s}_avg" for s in STATS)
    width = ", ".join(f"ceiling_next_5_{s}_avg - floor_next_5_{s}_avg as range_width_next_5_{s}_avg" for s in STATS)
    return f"""select *, {width} from (select *, {bounds} from (select *, {expected} from (select *, {sigma} from performance
        window w as (partition by player_id, season order by as_of_date, game_id rows between 9 preceding and current row)) a) b) c"""


RANGE_COLUMNS = [f"{x}_next_5_{s}_avg" for s in STATS for x in ("expected", "floor", "ceiling", "range_width", "target")]


@query("range_signals", f"select player_id, as_of_date, game_id, season, team_id, split, {', '.join(RANGE_COLUMNS)} from ({range_sql()}) r",
       doubles=RANGE_COLUMNS, needs="performance")
def _(spark, d):
    return labels.range_signals(performance(spark, d))


@query("evaluate_ranges", " union all ".join(f"""
    select split, '{s}' as stat, count(*) as rows, avg(abs(t - e)) as mae, sqrt(avg((t - e) * (t - e))) as rmse,
           1 - sum((t - e) * (t - e)) / (var_pop(t) * count(*)) as r2, avg(case when t between lo and hi then 1.0 else 0.0 end) as coverage_rate, avg(hi - lo) as avg_range_width
    from (select split, target_next_5_{s}_avg as t, expected_next_5_{s}_avg as e, floor_next_5_{s}_avg as lo, ceiling_next_5_{s}_avg as hi from ({range_sql()}) r) x group by split"""
                                            for s in STATS),
       doubles="mae rmse r2 coverage_rate avg_range_width", needs="performance")
def _(spark, d):
    return evaluate_ranges(labels.range_signals(performance(spark, d)))


@query("value_signals", """
    select o_orderkey, p - a as salary_value_gap_usd, p / nullif(a, 0) as salary_value_ratio,
           case when p / nullif(a, 0) >= 1.1 then 'underpaid' when p / nullif(a, 0) <= 0.9 then 'overpaid' else 'fair_value' end as salary_value_label
    from (select o_orderkey, avg(o_totalprice) over (partition by o_custkey) as p, case when o_orderkey % 50 = 0 then 0 else o_totalprice end as a from orders) x""",
       doubles="salary_value_gap_usd salary_value_ratio", digits=4)
def _(spark, d):
    from catalog.views import table
    from formline.operators.joins import join_same

    orders = table(spark, d, "orders")
    mean = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("predicted_salary_usd"))
    df = join_same(orders, mean, ["o_custkey"]).withColumn("salary_usd", F.when(F.col("o_orderkey") % 50 == 0, 0.0).otherwise(F.col("o_totalprice")))
    return labels.value_signals(df).select("o_orderkey", "salary_value_gap_usd", "salary_value_ratio", "salary_value_label")


@query("role_dimensions", """
    select player_id, season, team_id, points_per_100 * 0.45 + usage_pct * 40 * 0.35 + true_shooting_pct * 20 * 0.20 as scoring_creation,
           assists_per_100 * 0.70 + (1 - least(greatest(turnover_rate, 0), 1)) * 5 * 0.30 as playmaking,
           true_shooting_pct * 0.65 + least(greatest(three_point_attempt_rate, 0), 1) * 0.35 as shooting, free_throw_rate * 0.50 + usage_pct * 0.50 as rim_pressure,
           rebounds_per_100 * 0.55 + defensive_rebound_rate * 20 * 0.45 as rebounding, steal_rate * 0.75 + (1 - least(greatest(foul_rate, 0), 1)) * 0.25 as perimeter_defense,
           block_rate * 0.45 + defensive_rebound_rate * 0.35 + (1 - least(greatest(foul_rate, 0), 1)) * 0.20 as interior_defense, offensive_rating - defensive_rating as two_way_impact
    from v_season_stats""",
       doubles="scoring_creation playmaking shooting rim_pressure rebounding perimeter_defense interior_defense two_way_impact", needs="v_season_stats")
def _(spark, d):
    from formline.config import ROLE_DIMENSIONS

    return labels.role_dimensions(view(spark, d, "v_season_stats")).select("player_id", "season", "team_id", *ROLE_DIMENSIONS)


def _mean2(a: str, b: str) -> str:
    return f"(coalesce({a}, 0) + coalesce({b}, 0)) / nullif(({a} is not null)::int + ({b} is not null)::int, 0)"


@query("role_dimensions_mean", f"""
    select player_id, season, team_id, (points_per_100 + coalesce(usage_pct, 0) + free_throw_rate) / (2 + (usage_pct is not null)::int) as scoring_creation,
           {_mean2('assists_per_100', 'usage_pct')} - coalesce(turnover_rate, 0) as playmaking, {_mean2('true_shooting_pct', 'three_point_attempt_rate')} as shooting,
           {_mean2('free_throw_rate', 'points_per_100')} as rim_pressure, {_mean2('rebounds_per_100', 'defensive_rebound_rate')} as rebounding,
           steal_rate as perimeter_defense, {_mean2('block_rate', 'defensive_rebound_rate')} as interior_defense, offensive_rating - defensive_rating as two_way_impact
    from v_season_stats""",
       doubles="scoring_creation playmaking shooting rim_pressure rebounding perimeter_defense interior_defense two_way_impact", needs="v_season_stats")
def _(spark, d):
    from formline.config import ROLE_DIMENSIONS

    return labels.role_dimensions(view(spark, d, "v_season_stats"), "mean").select("player_id", "season", "team_id", *ROLE_DIMENSIONS)


@query("residual_correction", """
    with s as (select player_id, game_id, line, part, team_id as seg, points as y, minutes * 2 as p, season < '1999' as train from v_logs_long),
         g as (select seg, median(y - p) as m from s where train and seg <> 'R' group by seg), a as (select median(y - p) as m from s where train and seg <> 'R')
    select player_id, game_id, line, part, greatest(p + coalesce(g.m, a.m), 0) as corrected from s left join g on g.seg = s.seg, a""", doubles="corrected", needs="v_logs_long")
def _(spark, d):
    df = view(spark, d, "v_logs_long").withColumns({"pred": F.col("minutes") * 2})
    out = labels.residual_correction(df, (F.col("season") < "1999") & (F.col("team_id") != "R"), "points", "pred", "team_id")
    return out.select("player_id", "game_id", "line", "part", "corrected")


@query("baselines", """
    select game_id, split, pts_last_5 as naive, pts_season_avg as season_average, (select median(target_next_5_pts_avg) from performance where split = 'train') as train_median,
           pts as previous from performance""", doubles="naive season_average train_median previous", needs="performance")
def _(spark, d):
    df = labels.train_median_baseline(performance(spark, d), "target_next_5_pts_avg", F.col("split") == "train", "train_median")
    df = labels.previous_value_baseline(df, "pts", "previous")
    return df.select("game_id", "split", labels.naive_last_n("pts").alias("naive"), labels.season_average("pts").alias("season_average"), "train_median", "previous")
