"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import SHORT_SPLIT, split_sql, table, view
from formline.config import QualityConfig
from formline.operators import quality, splits


@query("missing_summary", """
    select 'age' as "column", 'double' as dtype, count(*) - count(age) as missing_count, 1 - count(age) / count(*)::double as missing_pct, count(distinct age) as n_unique from v_season_stats
    union all select 'season', 'string', count(*) - count(season), 1 - count(season) / count(*)::double, count(distinct season) from v_season_stats
    union all select 'absent', 'MISSING_COLUMN', count(*), 1.0, 0 from v_season_stats""", doubles="missing_pct", needs="v_season_stats")
def _(spark, d):
    return quality.missing_summary(view(spark, d, "v_season_stats"), ["age", "season", "absent"])


@query("missingness_ranking", """
    select 'age' as feature, avg((age is null)::int) as missing_pct from v_season_stats union all select 'usage_pct', avg((usage_pct is null)::int) from v_season_stats
    union all select 'pace', avg((pace is null)::int) from v_season_stats""", doubles="missing_pct", needs="v_season_stats")
def _(spark, d):
    return quality.missingness_ranking(view(spark, d, "v_season_stats"), ["age", "usage_pct", "pace"])


@query("finite_summary", """
    select 'x' as "column", count(*) filter (where event_id % 10 = 1) as inf_count, count(*) filter (where event_id % 10 = 1) as non_finite_count from events
    union all select 'value', 0, 0""")
def _(spark, d):
    e = F.col("event_id") % 10
    x = F.when(e == 0, float("nan")).when(e == 1, float("inf")).when(e == 2, None).otherwise(F.col("value"))
    return quality.finite_summary(table(spark, d, "events").withColumn("x", x), ["x", "value", "absent"])


@query("duplicate_keys", """
    select 'l_orderkey, l_linenumber' as key_columns, count(*) - count(distinct (l_orderkey, l_linenumber)) as duplicate_count,
           1 - count(distinct (l_orderkey, l_linenumber)) / count(*)::double as duplicate_rate, cast(null as varchar) as missing_key_columns from lineitem""", doubles="duplicate_rate")
def _(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("split_summary", f"""
    select split, count(*) as rows, count(*) / (select count(*) from v_logs_short)::double as row_pct from (select {split_sql('season', SHORT_SPLIT)} as split from v_logs_short) s group by split""",
       doubles="row_pct", needs="v_logs_short")
def _(spark, d):
    return quality.split_summary(view(spark, d, "v_logs_short").withColumn("split", splits.assign_split("season", SHORT_SPLIT)))


@query("validate_training", """
    with m as (select count(*) as n, count(pts) as p, count(distinct (player_id, season)) as k from v_logs_short)
    select 'error' as severity, 'required_column' as "check", 'absent' as "column", 'Missing required column: absent' as message
    union all select 'error', 'split_label', 'split', 'Unexpected split label: ignore' from m
    union all select 'error', 'feature_missing', 'pts', 'Feature missing pct ' || printf('%.4f', 1 - p / n::double) || ' exceeds 0.0000' from m
    union all select 'error', 'feature_missing', 'absent', 'Feature missing pct 1.0000 exceeds 0.0000'
    union all select 'warning', 'duplicate_key', 'player_id, season', 'Duplicate key rows found: ' || (n - k) from m""", needs="v_logs_short")
def _(spark, d):
    df = view(spark, d, "v_logs_short").withColumn("split", splits.assign_split("season", SHORT_SPLIT))
    issues, _ = quality.validate_training(df, QualityConfig(
        required=("player_id",), features=("pts", "ast", "absent"), targets=("reb",), keys=("player_id", "season")))
    return issues


@query("null_rate_report", """
    select (avg((usage_pct is null)::int) + avg((pace is null)::int)) / 2 as missing_share, max(usage_pct) > 1.5 as off_scale, true as refresh from v_season_stats""",
       doubles="missing_share", needs="v_season_stats")
def _(spark, d):
    return quality.null_rate_report(view(spark, d, "v_season_stats"), ["usage_pct", "pace"], 0.25, ["usage_pct"])


@query("dataframe_fingerprint", """
    select count(*) as rows, min(season) as season_min, max(season) as season_max, count(distinct season) as season_count, 'game_id, season, split' as columns,
           (select string_agg(split || '=' || n, ';' order by split) from (select team_id as split, count(*) as n from v_logs_short group by 1) x) as split_counts from v_logs_short""",
       needs="v_logs_short")
def _(spark, d):
    df = view(spark, d, "v_logs_short").select("game_id", "season", F.col("team_id").alias("split"))
    return quality.dataframe_fingerprint(df, "season")
