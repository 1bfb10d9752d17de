"""Aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import table, view
from formline.operators import aggregates

LONG_ORDER = ["game_date", "game_id", "line", "part"]
KEYS = ["player_id", "season"]
_LAST = "arg_max({c}, row(game_date, game_id, line, part))"

SUMMARY_SQL = f"""
    select player_id, season, {_LAST.format(c='player_name')} as player_name, {_LAST.format(c='team_id')} as team_id, max(game_date) as season_end_date,
           count(distinct game_id) as games_played, sum(minutes) as total_minutes, avg(minutes) as minutes_per_game, sum(points) as points,
           coalesce(sum(assists), 0) as assists, sum(rebounds) as rebounds, sum(fga) as fga, avg(true_shooting_pct) as true_shooting_pct,
           cast(substring(season, 1, 4) as int) as season_start_year, least(count(distinct game_id) / 82, 1) as availability_rate,
           sum(points) / nullif(sum(minutes), 0) * 36 as pts_per_36, coalesce(sum(assists), 0) / nullif(sum(minutes), 0) * 36 as ast_per_36,
           sum(rebounds) / nullif(sum(minutes), 0) * 36 as reb_per_36, sum(fga) / nullif(sum(minutes), 0) * 36 as fga_per_36
    from v_logs_long group by player_id, season"""


@query("season_summary", SUMMARY_SQL,
       doubles="total_minutes minutes_per_game points assists rebounds fga true_shooting_pct availability_rate pts_per_36 ast_per_36 reb_per_36 fga_per_36",
       digits=5, needs="v_logs_long")
def _(spark, d):
    return aggregates.season_summary(
        view(spark, d, "v_logs_long"), order=LONG_ORDER, sums={"fga": "fga"}, means={"true_shooting_pct": "true_shooting_pct"})


@query("season_stats", """
    select player_id, player_name, season, team_id, cast(null as double) as age, minutes, cast(null as double) as usage_pct,
           points / minutes * 100 as points_per_100, assists / minutes * 100 as assists_per_100, rebounds / minutes * 100 as rebounds_per_100,
           points / nullif(2 * (fga + 0.44 * fta), 0) as true_shooting_pct, fg3a / nullif(fga, 0) as three_point_attempt_rate, fta / nullif(fga, 0) as free_throw_rate,
           turnovers / nullif(fga + 0.44 * fta + turnovers, 0) as turnover_rate, steals / minutes * 36 as steal_rate, blocks / minutes * 36 as block_rate,
           defensive_rebounds / minutes * 36 as defensive_rebound_rate, personal_fouls / minutes * 36 as foul_rate, cast(null as double) as pace,
           cast(null as double) as possessions, cast(null as double) as offensive_rating, cast(null as double) as defensive_rating, games, points, assists, rebounds
    from (select player_id, player_name, season, case when line = 7 then null else team_id end as team_id, count(distinct game_id) as games, sum(minutes) as minutes, sum(points) as points,
                 coalesce(sum(assists), 0) as assists, sum(rebounds) as rebounds, sum(fga) as fga, sum(fta) as fta, sum(fg3a) as fg3a, sum(turnovers) as turnovers,
                 sum(steals) as steals, sum(blocks) as blocks, sum(defensive_rebounds) as defensive_rebounds, sum(personal_fouls) as personal_fouls
          from v_logs_long group by 1, 2, 3, 4) x""",
       doubles="minutes points_per_100 assists_per_100 rebounds_per_100 true_shooting_pct three_point_attempt_rate free_throw_rate turnover_rate "
               "steal_rate block_rate defensive_rebound_rate foul_rate points assists rebounds age usage_pct pace possessions offensive_rating defensive_rating",
       digits=4, needs="v_logs_long")
def _(spark, d):
    logs = view(spark, d, "v_logs_long").withColumn("team_id", F.when(F.col("line") != 7, F.col("team_id")))
    return aggregates.season_stats(logs)


@query("estimated_possessions", """
    with s as (select player_id, season, team_id, cast(substring(season, 1, 4) as int) as y, minutes, points_per_100 as points, 1.0 as one,
                      case when substring(season, 1, 4) in ('1996', '2001') then null else pace end as pace from v_season_stats),
         m as (select season, median(pace) as p from s group by season),
         dy as (select distinct y, season, pace from s), ym as (select y, median(pace) as p from dy group by y),
         yf as (select y, coalesce(last_value(p ignore nulls) over (order by y rows between unbounded preceding and current row),
                                   first_value(p ignore nulls) over (order by y rows between current row and unbounded following)) as p from ym)
    select s.player_id, s.season, s.team_id, coalesce(s.pace, m.p, yf.p) * s.minutes / 48 as estimated_possessions,
           s.points / (coalesce(s.pace, m.p, yf.p) * s.minutes / 48) * 100 as pts_per_100
    from s left join m on m.season = s.season left join yf on yf.y = s.y""", doubles="estimated_possessions pts_per_100", needs="v_season_stats")
def _(spark, d):
    hidden = F.substring("season", 1, 4).isin("1996", "2001")
    df = view(spark, d, "v_season_stats").withColumns({
        "season_start_year": F.substring("season", 1, 4).cast("int"), "total_minutes": F.col("minutes"), "points": F.col("points_per_100"),
        "assists": F.lit(1.0), "rebounds": F.lit(1.0), "pace": F.when(~hidden, F.col("pace"))})
    return aggregates.estimated_possessions(df).select("player_id", "season", "team_id", "estimated_possessions", "pts_per_100")


def _slope(c: str) -> str:
    return f"case when count({c}) >= 2 then regr_slope({c}, i_{c}) end"


RECENT_SQL = f"""
    select player_id, season, count(*) as recent_games_count, avg(minutes) as recent_minutes_per_game, avg(true_shooting_pct) as recent_true_shooting_pct,
           {_slope('minutes')} as recent_minutes_trend, {_slope('points')} as recent_pts_trend, {_slope('assists')} as recent_ast_trend, {_slope('rebounds')} as recent_reb_trend,
           sum(points) / sum(minutes) * 36 as recent_pts_per_36, coalesce(sum(assists), 0) / sum(minutes) * 36 as recent_ast_per_36,
           sum(rebounds) / sum(minutes) * 36 as recent_reb_per_36, sum(fga) / sum(minutes) * 36 as recent_fga_per_36
    from (select *, {', '.join(f'count({c}) over u as i_{c}' for c in ('minutes', 'points', 'assists', 'rebounds'))}
          from (select *, row_number() over (partition by player_id, season order by game_date desc, game_id desc, line desc, part desc) as rn from v_logs_long) x where rn <= 20
          window u as (partition by player_id, season order by game_date, game_id, line, part rows between unbounded preceding and current row)) y
    group by player_id, season"""


@query("recent_form", RECENT_SQL,
       doubles="recent_minutes_per_game recent_true_shooting_pct recent_minutes_trend recent_pts_trend recent_ast_trend recent_reb_trend "
               "recent_pts_per_36 recent_ast_per_36 recent_reb_per_36 recent_fga_per_36", digits=5, needs="v_logs_long")
def _(spark, d):
    return aggregates.recent_form(
        view(spark, d, "v_logs_long"), KEYS, LONG_ORDER, sums={"fga": "fga"}, means={"recent_true_shooting_pct": "true_shooting_pct"})


def consistency_sql(stats, source: str, keys: str, least: int) -> str:
    cols = []
    for s in stats:
        cols.append(
            f"avg({s}) as {s}_mean, stddev_pop({s}) as {s}_std, case when avg({s}) > 0 then stddev_pop({s}) / avg({s}) end as {s}_cv, "
            f"quantile_cont({s}, 0.2) as {s}_p20, quantile_cont({s}, 0.5) as {s}_p50, quantile_cont({s}, 0.8) as {s}_p80, "
            f"avg(case when {s} is null then null when {s} > m_{s} then 1.0 else 0.0 end) as {s}_above_mean_rate")
    means = ", ".join(f"avg({s}) over (partition by {keys}) as m_{s}" for s in stats)
    return f"select {keys}, count(*) as games_observed, {', '.join(cols)} from (select *, {means} from {source}) z group by {keys} having count(*) >= {least}"


CONSISTENCY = ("mean", "std", "cv", "p20", "p50", "p80", "above_mean_rate")


@query("consistency_stats", consistency_sql(("points", "assists"), "v_logs_long", "player_id, season, team_id", 10),
       doubles=[f"{s}_{x}" for s in ("points", "assists") for x in CONSISTENCY], digits=5, needs="v_logs_long")
def _(spark, d):
    return aggregates.consistency_stats(view(spark, d, "v_logs_long"), ["player_id", "season", "team_id"], ["points", "assists"])


@query("value_counts", """
    select label, count(*) as rows, count(*) / (select count(*) from events)::double as row_pct
    from (select case when event_type = 'click' then null else event_type end as label from events) x group by label""", doubles="row_pct")
def _(spark, d):
    label = F.when(F.col("event_type") != "click", F.col("event_type"))
    return aggregates.value_counts(table(spark, d, "events").select(label.alias("label")), "label")


@query("target_summary", " union all ".join(f"""
    select '{c}' as target, count({c}) as non_null_rows, avg(case when {c} is null then 1.0 else 0.0 end) as missing_pct, avg({c}) as mean,
           stddev_samp({c}) as std, quantile_cont({c}, 0.1) as p10, quantile_cont({c}, 0.5) as p50, quantile_cont({c}, 0.9) as p90 from v_logs_long"""
                                           for c in ("points", "assists", "true_shooting_pct")),
       doubles="missing_pct mean std p10 p50 p90", digits=5, needs="v_logs_long")
def _(spark, d):
    return aggregates.target_summary(view(spark, d, "v_logs_long"), ["points", "assists", "true_shooting_pct", "absent"])


@query("segment_median", """
    select team_id, median(assists) as segment_median, (select median(assists) from v_logs_long) as global_median from v_logs_long group by team_id""",
       doubles="segment_median global_median", needs="v_logs_long")
def _(spark, d):
    return aggregates.segment_median(view(spark, d, "v_logs_long"), "team_id", "assists")


@query("string_join_distinct", """
    select player_id, string_agg(season, ', ' order by season) as seasons from (select distinct player_id, season from v_logs_long) x group by player_id""", needs="v_logs_long")
def _(spark, d):
    return aggregates.string_join_distinct(view(spark, d, "v_logs_long"), ["player_id"], "season", "seasons")
