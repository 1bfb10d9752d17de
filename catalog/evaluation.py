"""Metric and parameter-grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.gold import sparse_summary
from catalog.history import performance
from catalog.registry import query
from catalog.views import table, view
from formline.config import STATS, RangeConfig
from formline.operators import labels, metrics


def regression_sql(y: str, e: str) -> str:
    return (f"avg(abs({y} - {e})) as mae, sqrt(avg(({y} - {e}) * ({y} - {e}))) as rmse, "
            f"1 - sum(({y} - {e}) * ({y} - {e})) / (var_pop({y}) * count(*)) as r2")


@query("regression_metrics", f"select count(*) as rows, {regression_sql('target_next_5_pts_avg', 'pts_last_5')} from performance", doubles="mae rmse r2", needs="performance")
def _(spark, d):
    return metrics.regression_metrics(performance(spark, d), "target_next_5_pts_avg", "pts_last_5")


@query("evaluate_by_split", f"select split, 'points' as task, count(*) as rows, {regression_sql('target_next_5_pts_avg', 'pts_season_avg')} from performance where split in ('validation', 'test') group by split",
       doubles="mae rmse r2", needs="performance")
def _(spark, d):
    return metrics.evaluate_by_split(performance(spark, d), "target_next_5_pts_avg", "pts_season_avg", "points")


@query("classification_metrics", """
    with s as (select event_type as grp, (event_id % 3 = 0)::int as y, round(value / (value + 20), 2) + case when event_id % 3 = 0 then 0.1 else 0 end as p from events),
         r as (select *, rank() over (partition by grp order by p) + (count(*) over (partition by grp, p) - 1) / 2.0 as rk from s),
         a as (select grp, (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) as roc_auc from r group by grp)
    select s.grp, count(*) as rows, avg(y) as positive_rate, avg((y = (p >= 0.5)::int)::int) as accuracy, avg((p - y) * (p - y)) as brier,
           coalesce(sum(y * (p >= 0.5)::int) / nullif(sum((p >= 0.5)::int), 0), 0) as precision, coalesce(sum(y * (p >= 0.5)::int) / nullif(sum(y), 0), 0) as recall,
           coalesce(2 * sum(y * (p >= 0.5)::int) / nullif(sum(y) + sum((p >= 0.5)::int), 0), 0) as f1, max(a.roc_auc) as roc_auc
    from s join a on a.grp = s.grp group by s.grp""", doubles="positive_rate accuracy brier precision recall f1 roc_auc")
def _(spark, d):
    y = (F.col("event_id") % 3 == 0).cast("int")
    p = F.round(F.col("value") / (F.col("value") + 20), 2) + F.when(y == 1, 0.1).otherwise(0.0)
    df = table(spark, d, "events").select(F.col("event_type").alias("grp"), y.alias("y"), p.alias("p"))
    return metrics.classification_metrics(df, "y", "p", by=["grp"])


_SAL = "select o_orderstatus as split, o_orderpriority as seg, o_totalprice as usd, 400000.0 as cap, o_totalprice / 400000 as share, (o_orderkey % 100) / 100.0 - 0.1 as pred from orders"


def _salary_rows(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("seg"), F.col("o_totalprice").alias("salary_usd"),
        F.lit(400000.0).alias("salary_cap_usd"), (F.col("o_totalprice") / 400000).alias("salary_cap_share"),
        ((F.col("o_orderkey") % 100) / 100 - 0.1).alias("pred"))


_SM = f"avg(abs(share - greatest(pred, 0))) as cap_share_mae, avg(abs(usd - greatest(pred, 0) * cap)) as usd_mae, sqrt(avg(power(share - greatest(pred, 0), 2))) as rmse, 1 - sum(power(share - greatest(pred, 0), 2)) / (var_pop(share) * count(*)) as r2"


@query("salary_metrics", f"select split, count(*) as rows, {_SM} from ({_SAL}) s group by split", doubles="cap_share_mae usd_mae rmse r2", digits=5)
def _(spark, d):
    return metrics.salary_metrics(_salary_rows(spark, d), "pred")


@query("segment_metrics", f"select split, seg, count(*) as rows, {_SM} from ({_SAL}) s group by split, seg", doubles="cap_share_mae usd_mae rmse r2", digits=5)
def _(spark, d):
    return metrics.segment_metrics(_salary_rows(spark, d), "pred", "seg")


@query("interval_metrics", """
    select split, count(*) as rows, avg(abs(y - m)) as p50_mae, avg((y between least(a, b) and greatest(a, b))::int) as interval_coverage,
           avg(greatest(a, b) - least(a, b)) as avg_interval_width, median(greatest(a, b) - least(a, b)) as median_interval_width
    from (select event_type as split, value as y, value * 0.9 + event_id % 7 as m, value * 0.5 + event_id % 11 as a, value * 1.5 - event_id % 5 as b from events) e group by split""",
       doubles="p50_mae interval_coverage avg_interval_width median_interval_width")
def _(spark, d):
    v, e = F.col("value"), F.col("event_id")
    df = table(spark, d, "events").select(
        F.col("event_type").alias("split"), v.alias("y"), (v * 0.9 + e % 7).alias("m"), (v * 0.5 + e % 11).alias("a"), (v * 1.5 - e % 5).alias("b"))
    return metrics.interval_metrics(df, "y", "a", "m", "b")


# --- grids --------------------------------------------------------------------------------
GRID = {"pts": [0.5, 1.0, 2.0, 3.0, 5.0], "ast": [1.0, 4.0, 8.0], "min": [1.0, 2.0, 3.0]}


def _grid_sql(s: str, t: float) -> str:
    future = f"target_next_5_{s}_avg - {s}_season_avg" if s != "min" else "cast(null as double)"
    return f"""select '{s}' as stat, {t} as tolerance, count(*) as rows, avg((abs(x) > {t})::int) as non_stable_rate,
        avg(case when abs(x) > {t} and f is not null then (sign(x) = sign(f))::int end) as directional_hit_rate, avg(case when x > {t} then f end) as future_delta_mean_improving,
        avg(case when abs(x) <= {t} then f end) as future_delta_mean_stable, avg(case when x < -{t} then f end) as future_delta_mean_declining, avg((abs(x) > {t})::int) >= 0.1 as selection_eligible
        from (select {s}_last_5_minus_season_avg as x, {future} as f from performance where split = 'validation') p"""


_GRID_SQL = " union all ".join(_grid_sql(s, t) for s, ts in GRID.items() for t in ts)
_GRID_DOUBLES = "tolerance non_stable_rate directional_hit_rate future_delta_mean_improving future_delta_mean_stable future_delta_mean_declining"


@query("trend_threshold_grid", _GRID_SQL, doubles=_GRID_DOUBLES, needs="performance")
def _(spark, d):
    return metrics.trend_threshold_grid(performance(spark, d), GRID)


@query("trend_threshold_selection", f"""
    select * exclude (rn) from (select *, row_number() over (partition by stat order by selection_eligible desc, directional_hit_rate desc nulls last, non_stable_rate desc, tolerance) as rn
    from ({_GRID_SQL}) g) h where rn = 1""", doubles=_GRID_DOUBLES, needs="performance")
def _(spark, d):
    return metrics.select_trend_thresholds(metrics.trend_threshold_grid(performance(spark, d), GRID))


WEIGHTS = [(s / 10, t / 10, round(1 - s / 10 - t / 10, 1)) for s in range(3, 8) for t in range(1, 6) if s + t <= 10]
_W_SQL = ", ".join(f"({a}, {b}, {c})" for a, b, c in WEIGHTS)
_ERR = " union all ".join(f"""
    select '{s}' as stat, w.a, w.b, w.c, avg(abs(target_next_5_{s}_avg - (w.a * {s}_season_avg + w.b * {s}_last_10 + w.c * {s}_last_5))) / stddev_pop(target_next_5_{s}_avg) as score
    from performance, (values {_W_SQL}) w(a, b, c) where split = 'validation' group by w.a, w.b, w.c""" for s in STATS)


@query("blend_weight_grid", f"select a as w_season, b as w_ten, c as w_five, avg(score) as normalized_mae from ({_ERR}) e group by a, b, c",
       doubles="w_season w_ten w_five normalized_mae", needs="performance")
def _(spark, d):
    return metrics.blend_weight_grid(performance(spark, d), WEIGHTS)


@query("best_blend", f"select a as w_season, b as w_ten, c as w_five, avg(score) as normalized_mae from ({_ERR}) e group by a, b, c order by 4, 1, 2, 3 limit 1",
       doubles="w_season w_ten w_five normalized_mae", needs="performance")
def _(spark, d):
    return metrics.best_blend(metrics.blend_weight_grid(performance(spark, d), WEIGHTS))


MULTIPLIERS = [round(0.30 + 0.05 * i, 2) for i in range(31)]


def _mult_sql() -> str:
    parts = []
    for s in STATS:
        parts.append(f"""select m, avg((t between greatest(e - m * g, 0) and e + m * g)::int) as c, avg(e + m * g - greatest(e - m * g, 0)) as w
            from (select target_next_5_{s}_avg as t, 0.5 * {s}_season_avg + 0.3 * {s}_last_10 + 0.2 * {s}_last_5 as e,
                  coalesce(case when count({s}) over w >= 5 then stddev_pop({s}) over w end, stddev_samp({s}) over (partition by season), 0) as g, split
                  from performance window w as (partition by player_id, season order by as_of_date, game_id rows between 9 preceding and current row)) p,
                 (values {', '.join(f'({m})' for m in MULTIPLIERS)}) v(m) where split = 'validation' group by m""")
    return f"select m as multiplier, avg(c) as coverage, avg(w) as avg_width, abs(avg(c) - 0.8) as coverage_gap from ({' union all '.join(parts)}) u group by m"


@query("volatility_multiplier_grid", _mult_sql(), doubles="multiplier coverage avg_width coverage_gap", needs="performance")
def _(spark, d):
    df = labels.with_volatility(performance(spark, d))
    return metrics.volatility_multiplier_grid(df, (0.5, 0.3, 0.2), MULTIPLIERS)


# --- model comparison ---------------------------------------------------------------------
_EVALS = """select * from (select o_orderstatus as task, o_orderpriority as model, case when o_orderkey % 3 = 0 then 'validation' else 'test' end as split,
    avg(abs(o_totalprice / 1000 - 150)) as mae, count(*) as n from orders group by 1, 2, 3) e"""


@query("model_selection", f"""
    with e as ({_EVALS}) select v.task, v.model, v.split, v.mae, v.n, t.mae as test_mae, t.n as test_n
    from (select *, row_number() over (partition by task order by mae, model) as rn from e where split = 'validation') v
    left join e t on t.task = v.task and t.model = v.model and t.split = 'test' where rn = 1""", doubles="mae test_mae")
def _(spark, d):
    split = F.when(F.col("o_orderkey") % 3 == 0, "validation").otherwise("test")
    evals = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("model"), split.alias("split")).agg(
        F.avg(F.abs(F.col("o_totalprice") / 1000 - 150)).alias("mae"), F.count(F.lit(1)).alias("n"))
    return metrics.model_selection(evals, "mae", ["task"], ["task", "model"], ["mae", "n"])


_COMP = """select player_id, case when season_start_year < 1998 then 'train' when season_start_year = 1998 then 'validation' else 'test' end as split, minutes_per_game as last,
    lead(minutes_per_game) over w as minutes_h1, pts_per_36 as rate, lead(minutes_per_game) over w * lead(pts_per_36) over w / 36 as pts_pg, ast_per_36 as arate, lead(minutes_per_game) over w * lead(ast_per_36) over w / 36 as ast_pg
    from sparse_summary window w as (partition by player_id order by season_start_year)"""


def _pg(y: str, e: str, name: str) -> str:
    t = f"case when {e} is not null then {y} end"
    return (f"avg(abs({y} - ({e}))) as {name}mae, sqrt(avg(power({y} - ({e}), 2))) as {name}rmse, 1 - sum(power({y} - ({e}), 2)) / (var_pop({t}) * count({t})) as {name}r2")


def _comp_sql() -> str:
    parts = []
    for name, m in (("last_mpg", "last"), ("flat_mpg", "24.0 + 0 * last")):
        parts.append(f"""select split, '{name}' as minutes_estimator, 1 as horizon, count(*) as rows, {_pg('minutes_h1', m, 'minutes_')}, count(minutes_h1) as minutes_rows,
            {_pg('pts_pg', f'rate * ({m}) / 36', 'pts_pg_')}, count(pts_pg) as pts_rows, {_pg('ast_pg', f'arate * ({m}) / 36', 'ast_pg_')}, count(ast_pg) as ast_rows
            from ({_COMP}) c group by split""")
    return f"select *, (pts_pg_mae + ast_pg_mae) / 2 as avg_pg_mae from ({' union all '.join(parts)}) u"


_COMP_DOUBLES = [f"{p}{m}" for p in ("minutes_", "pts_pg_", "ast_pg_") for m in ("mae", "rmse", "r2")] + ["avg_pg_mae"]


def composition(spark, d):
    from formline.operators.windows import over_history, shifted
    from formline.operators.ordered import Frames

    made = {f"{c}_n": shifted(c, -1) for c in ("minutes_per_game", "pts_per_36", "ast_per_36")}
    df = over_history(sparse_summary(spark, d), ["player_id"], ["season_start_year"], Frames(made, ahead=1))
    y = F.col("season_start_year")
    df = df.withColumns({
        "split": F.when(y < 1998, "train").when(y == 1998, "validation").otherwise("test"), "minutes_per_game_h1": F.col("minutes_per_game_n"),
        "pts_per_game_h1": F.col("minutes_per_game_n") * F.col("pts_per_36_n") / 36, "ast_per_game_h1": F.col("minutes_per_game_n") * F.col("ast_per_36_n") / 36})
    return metrics.composition_eval(
        df, 1, {"last_mpg": F.col("minutes_per_game"), "flat_mpg": F.lit(24.0)}, {"pts": "pts_per_36", "ast": "ast_per_36"})


@query("composition_eval", _comp_sql(), doubles=_COMP_DOUBLES, needs="sparse_summary")
def _(spark, d):
    return composition(spark, d)


_DIRECT = "select 1 as horizon, split, stat, model, mae from (values ('validation', 'pts', 'a', 1.0), ('validation', 'pts', 'b', 0.5), ('validation', 'ast', 'a', 9.0), ('test', 'pts', 'a', 900.0), ('test', 'ast', 'a', 900.0)) v(split, stat, model, mae)"


@query("per_game_decision", f"""
    with c as (select * from (select *, row_number() over (partition by split order by avg_pg_mae, minutes_estimator) as rn from ({_comp_sql()}) x where avg_pg_mae is not null) y where rn = 1),
         b as (select split, stat, min(mae) as mae from ({_DIRECT}) d group by split, stat),
         w as (select split, max(case when stat = 'pts' then mae end) as p, max(case when stat = 'ast' then mae end) as a from b group by split)
    select c.horizon, c.split, minutes_estimator as recommended_minutes_estimator, avg_pg_mae as compose_avg_pg_mae, w.p as direct_pts_pg_mae, w.a as direct_ast_pg_mae, (w.p + w.a) / 2 as direct_avg_pg_mae,
           avg_pg_mae - (w.p + w.a) / 2 as compose_minus_direct_avg_mae, minutes_mae <= 40 and minutes_r2 >= -9 as minutes_passes_threshold, coalesce(avg_pg_mae - (w.p + w.a) / 2 <= 0, false) as compose_beats_direct,
           case when minutes_mae <= 40 and minutes_r2 >= -9 and coalesce(avg_pg_mae - (w.p + w.a) / 2 <= 0, false) then 'optional_per_game' else 'use_per36_only' end as recommendation
    from c left join w on w.split = c.split""", doubles="compose_avg_pg_mae direct_pts_pg_mae direct_ast_pg_mae direct_avg_pg_mae compose_minus_direct_avg_mae", needs="sparse_summary")
def _(spark, d):
    direct = spark.createDataFrame(
        [(1, "validation", "pts", "a", 1.0), (1, "validation", "pts", "b", 0.5), (1, "validation", "ast", "a", 9.0), (1, "test", "pts", "a", 900.0), (1, "test", "ast", "a", 900.0)],
        "horizon int, split string, stat string, model string, mae double")
    out = metrics.per_game_decision(composition(spark, d), direct, ["pts", "ast"], max_mae=40, min_r2=-9)
    return out.select("horizon", "split", "recommended_minutes_estimator", "compose_avg_pg_mae", "direct_pts_pg_mae", "direct_ast_pg_mae", "direct_avg_pg_mae",
                      "compose_minus_direct_avg_mae", "minutes_passes_threshold", "compose_beats_direct", "recommendation")
