"""Ordered-history and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import SHORT_SPLIT, form_sql, table, view
from formline.config import FORM_STATS, STATS
from formline.operators import topk, windows
from formline.plans import builders

KEYS, ORDER = ["player_id", "season"], ["as_of_date", "game_id"]
LONG_ORDER = ["game_date", "game_id", "line", "part"]
_W = "partition by player_id, season order by as_of_date, game_id"
_LW = "partition by player_id, season order by game_date, game_id, line, part"
_FORM = " ".join(
    f"{s}_{x}" for s in FORM_STATS
    for x in ("last_5", "last_10", "season_avg", "last_5_minus_season_avg", "last_10_minus_season_avg", "last_5_minus_last_10")
)
_TARGETS = " ".join(f"target_next_5_{s}_avg" for s in STATS)


@query("rolling_mean", f"""
    select game_id, case when count(pts) over w >= 5 then avg(pts) over w end as warm, case when count(pts) over w >= 10 then avg(pts) over w end as strict
    from v_logs_short window w as ({_W} rows between 9 preceding and current row)""", doubles="warm strict", needs="v_logs_short")
def _(spark, d):
    df = windows.rolling_mean(view(spark, d, "v_logs_short"), KEYS, ORDER, "pts", 10, 5, "warm")
    return windows.rolling_mean(df, KEYS, ORDER, "pts", 10, "window", "strict").select("game_id", "warm", "strict")


@query("expanding_mean", f"""
    select game_id, case when count(pts) over w >= 5 then avg(pts) over w end as to_date
    from v_logs_short window w as ({_W} rows between unbounded preceding and current row)""", doubles="to_date", needs="v_logs_short")
def _(spark, d):
    return windows.expanding_mean(view(spark, d, "v_logs_short"), KEYS, ORDER, "pts", 5, "to_date").select("game_id", "to_date")


@query("rolling_std", f"""
    select game_id, case when count(pts) over w >= 5 then stddev_pop(pts) over w end as pts_rolling_std_10,
           case when count(ast) over w >= 5 then stddev_pop(ast) over w end as ast_rolling_std_10
    from v_logs_short window w as ({_W} rows between 9 preceding and current row)""",
       doubles="pts_rolling_std_10 ast_rolling_std_10", needs="v_logs_short")
def _(spark, d):
    return windows.rolling_std(view(spark, d, "v_logs_short"), KEYS, ORDER, ["pts", "ast"]).select(
        "game_id", "pts_rolling_std_10", "ast_rolling_std_10")


@query("future_average", f"""
    select game_id, case when count(pts) over w = 5 then avg(pts) over w end as target_next_5_pts_avg
    from v_logs_short window w as ({_W} rows between 1 following and 5 following)""", doubles="target_next_5_pts_avg", needs="v_logs_short")
def _(spark, d):
    return windows.future_average(view(spark, d, "v_logs_short"), KEYS, ORDER, "pts").select("game_id", "target_next_5_pts_avg")


def _form_query(name: str, least):
    @query(name, f"select game_id, {', '.join((_FORM + ' ' + _TARGETS).split())} from ({form_sql(least)}) x",
           doubles=f"{_FORM} {_TARGETS}", needs="v_logs_short")
    def _(spark, d):
        return builders.performance_features(view(spark, d, "v_logs_short"), least).select("game_id", *_FORM.split(), *_TARGETS.split())


_form_query("form_features", 5)
_form_query("form_features_full_window", "window")


@query("rest_days", """
    select *, cast(floor((epoch_us(as_of_date) - epoch_us(lag(as_of_date) over (partition by player_id order by as_of_date, game_id))) / 86400000000.0) as int) as rest_days
    from (select player_id, game_id, as_of_date from v_logs_short) x""", doubles="rest_days", needs="v_logs_short")
def _(spark, d):
    df = view(spark, d, "v_logs_short").select("player_id", "game_id", "as_of_date")
    return windows.rest_days(df, ["player_id"], ORDER, "as_of_date")


_SUMMARY = """
    select player_id, season, cast(substring(season, 1, 4) as int) as y, count(*) as games, sum(points) as points,
           case when player_id % 9 = 0 and cast(substring(season, 1, 4) as int) % 2 = 0 then null else sum(assists) end as assists
    from v_logs_sparse group by player_id, season"""


def _summary(spark, d):
    df = view(spark, d, "v_logs_sparse").groupBy("player_id", "season").agg(
        F.count(F.lit(1)).alias("games"), F.sum("points").alias("points"), F.sum("assists").alias("assists"))
    y = F.substring("season", 1, 4).cast("int")
    return df.withColumn("y", y).withColumn("assists", F.when(~((F.col("player_id") % 9 == 0) & (F.col("y") % 2 == 0)), F.col("assists")))


@query("lag_features", f"""
    select player_id, season, points as points_lag_0, lag(points) over w as points_lag_1, lag(points, 2) over w as points_lag_2,
           lag(points, 3) over w as points_lag_3
    from ({_SUMMARY}) s window w as (partition by player_id order by y)""",
       doubles="points_lag_0 points_lag_1 points_lag_2 points_lag_3", needs="v_logs_sparse")
def _(spark, d):
    out = windows.lag_features(_summary(spark, d), ["player_id"], ["y"], ["points"])
    return out.select("player_id", "season", *[f"points_lag_{i}" for i in range(4)])


@query("trailing_slope", f"""
    select player_id, season, case when count(assists) over w >= 2 then regr_slope(assists, i) over w end as assists_slope_3yr,
           case when count(points) over w >= 2 then regr_slope(points, j) over w end as points_slope_3yr
    from (select *, count(assists) over u as i, count(points) over u as j from ({_SUMMARY}) s
          window u as (partition by player_id order by y rows between unbounded preceding and current row)) t
    window w as (partition by player_id order by y rows between 2 preceding and current row)""",
       doubles="assists_slope_3yr points_slope_3yr", needs="v_logs_sparse")
def _(spark, d):
    out = windows.trailing_slope(_summary(spark, d), ["player_id"], ["y"], ["assists", "points"])
    return out.select("player_id", "season", "assists_slope_3yr", "points_slope_3yr")


@query("career_cumulative", f"""
    select player_id, season, cast(sum(games) over w as bigint) as career_games, sum(points) over w as career_minutes, row_number() over w as years_in_league
    from ({_SUMMARY}) s window w as (partition by player_id order by y rows between unbounded preceding and current row)""",
       doubles="career_minutes", needs="v_logs_sparse")
def _(spark, d):
    out = windows.career_cumulative(_summary(spark, d), ["player_id"], ["y"], "games", "points")
    return out.select("player_id", "season", "career_games", "career_minutes", "years_in_league")


@query("group_std", "select game_id, stddev_samp(pts) over (partition by season) as season_std from v_logs_short", doubles="season_std", needs="v_logs_short")
def _(spark, d):
    return windows.group_std(view(spark, d, "v_logs_short"), ["season"], "pts", "season_std").select("game_id", "season_std")


@query("robust_z", """
    select game_id, case when mad is null or mad = 0 then case when std is null or std = 0 then 0 else (x - mean) / std end else 0.6745 * (x - med) / mad end as z,
           case when fmad is null or fmad = 0 then case when fstd is null or fstd = 0 then 0 else (flat - fmean) / fstd end else 0.6745 * (flat - fmed) / fmad end as flat_z
    from (select *, median(abs(x - med)) over (partition by season) as mad, stddev_pop(x) over (partition by season) as std, avg(x) over (partition by season) as mean,
                 median(abs(flat - fmed)) over (partition by season) as fmad, stddev_pop(flat) over (partition by season) as fstd, avg(flat) over (partition by season) as fmean
          from (select game_id, season, pts as x, median(pts) over (partition by season) as med,
                       case when game_id % 10 = 0 then 1.0 else 2.0 end as flat,
                       median(case when game_id % 10 = 0 then 1.0 else 2.0 end) over (partition by season) as fmed from v_logs_short) a) b""",
       doubles="z flat_z", needs="v_logs_short")
def _(spark, d):
    df = view(spark, d, "v_logs_short").withColumn("flat", F.when(F.col("game_id") % 10 == 0, 1.0).otherwise(2.0))
    return windows.robust_z(df, ["season"], {"pts": "z", "flat": "flat_z"}).select("game_id", "z", "flat_z")


@query("carry_fill", f"""
    select game_id, coalesce(last_value(pts ignore nulls) over (partition by player_id, season order by as_of_date, game_id rows between unbounded preceding and current row),
           first_value(pts ignore nulls) over (partition by player_id, season order by as_of_date, game_id rows between current row and unbounded following)) as pts
    from v_logs_short""", doubles="pts", needs="v_logs_short")
def _(spark, d):
    return windows.carry_fill(view(spark, d, "v_logs_short"), KEYS, ORDER, "pts").select("game_id", "pts")


_SEQ = "cast(pts as float) - cast(pts_season_avg as float)"


@query("sequence_windows", f"""
    select game_id, split, x[1] as first_stat_delta, x[10] as last_stat_delta, list_sum(x) as stat_sum, list_sum(m) as minutes_sum, len(x) as cells,
           cast(target_next_5_pts_avg as float) - cast(pts_season_avg as float) as y_delta, cast(pts_season_avg as float) as baseline
    from (select *, list({_SEQ}) over w as x, list(cast(min as float) - cast(min_season_avg as float)) over w as m,
                 count({_SEQ}) over w as n
          from performance window w as (partition by player_id, season order by as_of_date, game_id rows between 9 preceding and current row)) p
    where n = 10""", doubles="first_stat_delta last_stat_delta stat_sum minutes_sum y_delta baseline", digits=3, needs="performance")
def _(spark, d):
    perf = builders.prepare_sequences(performance(spark, d), "points")
    stat, average, target, length = builders.sequence_task("pts")
    seq = windows.sequence_windows(perf, KEYS, ORDER, stat, average, target, length)
    total = lambda i: F.aggregate(F.transform("x_seq", lambda c: c[i].cast("double")), F.lit(0.0), lambda a, x: a + x)
    return seq.select(
        "game_id", "split", F.col("x_seq")[0][0].alias("first_stat_delta"), F.element_at("x_seq", -1)[0].alias("last_stat_delta"),
        total(0).alias("stat_sum"), total(1).alias("minutes_sum"), F.size("x_seq").cast("long").alias("cells"), "y_delta", "baseline")


def performance(spark, d):
    """Complete short-term training rows of the event histories."""
    return builders.build_performance_training(view(spark, d, "v_logs_short"), SHORT_SPLIT)


@query("performance_training", f"""
    select player_id, season, as_of_date, game_id, team_id, split, pts, ast, reb, min, {', '.join((_FORM + ' ' + _TARGETS).split())} from performance""",
       doubles=f"pts ast reb min {_FORM} {_TARGETS}", needs="performance")
def _(spark, d):
    return performance(spark, d).select(
        *KEYS, *ORDER, "team_id", "split", *FORM_STATS, *_FORM.split(), *_TARGETS.split())


# --- top-k --------------------------------------------------------------------------------
@query("latest_per_key", f"""
    select player_id, season, game_id, pts from (select *, row_number() over (partition by player_id, season order by as_of_date desc, game_id desc) as rn from v_logs_short) x where rn = 1""",
       doubles="pts", needs="v_logs_short")
def _(spark, d):
    return topk.latest_per_key(view(spark, d, "v_logs_short"), KEYS, ORDER).select(*KEYS, "game_id", "pts")


@query("tail_per_key", f"""
    select player_id, season, game_id from (select *, row_number() over (partition by player_id, season order by as_of_date desc, game_id desc) as rn from v_logs_short) x where rn <= 3""",
       needs="v_logs_short")
def _(spark, d):
    return topk.tail_per_key(view(spark, d, "v_logs_short"), KEYS, ORDER, 3).select(*KEYS, "game_id")


@query("best_per_group", """
    select season, game_id, pts from (select *, row_number() over (partition by season order by pts asc nulls last, game_id) as rn from v_logs_short) x where rn = 1""",
       doubles="pts", needs="v_logs_short")
def _(spark, d):
    return topk.best_per_group(view(spark, d, "v_logs_short"), ["season"], "pts", ["game_id"]).select("season", "game_id", "pts")


@query("top_n", "select game_id, pts from v_logs_short order by pts desc nulls last, game_id limit 25", doubles="pts", needs="v_logs_short")
def _(spark, d):
    return topk.top_n(view(spark, d, "v_logs_short"), "pts", 25, ["game_id"]).select("game_id", "pts")


@query("top_n_per_group", """
    select season, team_id, game_id, pts from (select *, row_number() over (partition by season, team_id order by pts desc nulls last, game_id) as rn from v_logs_short) x where rn <= 5""",
       doubles="pts", needs="v_logs_short")
def _(spark, d):
    return topk.top_n_per_group(view(spark, d, "v_logs_short"), ["season", "team_id"], "pts", 5, ["game_id"]).select("season", "team_id", "game_id", "pts")


@query("dedup_keep", """
    select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as rn from lineitem) x where rn = 1""")
def _(spark, d):
    return topk.dedup_keep(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("sample_rows", "select least(count(*), 5000) as n, 1 as repeatable from orders")
def _(spark, d):
    df = table(spark, d, "orders")
    one = topk.sample_rows(df, 5000, ["o_orderkey"])
    two = topk.sample_rows(df.repartition(5), 5000, ["o_orderkey"])
    both = one.select("o_orderkey").join(two.select("o_orderkey"), "o_orderkey", "left_semi")
    n = one.agg(F.count(F.lit(1))).scalar()
    return both.agg(F.count(F.lit(1)).alias("n")).select("n", (F.col("n") == n).cast("int").alias("repeatable"))
