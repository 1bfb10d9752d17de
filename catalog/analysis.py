"""Feature-analysis queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.history import performance
from catalog.registry import query
from catalog.views import view
from formline.operators import analysis

FEATURES = ("age", "usage_pct", "pace", "rebounds_per_100", "turnover_rate", "foul_rate")
TARGET = "points_per_100"


@query("pearson_ranking", " union all ".join(
    f"select '{f}' as feature, count({f}) as rows, corr({f}, {TARGET}) as correlation, '{TARGET}' as target, abs(corr({f}, {TARGET})) as abs_correlation from v_season_stats" for f in FEATURES),
       doubles="correlation abs_correlation", needs="v_season_stats")
def _(spark, d):
    df = view(spark, d, "v_season_stats").withColumn("flat", F.lit(1.0))
    return analysis.pearson_ranking(df, TARGET, [*FEATURES, "flat"])


def rank_sql(c: str, source: str) -> str:
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"


def spearman_sql(a: str, b: str, source: str) -> str:
    return f"(select corr(ra, rb) from (select {rank_sql(a, source)} as ra, {rank_sql(b, source)} as rb from {source} where {a} is not null and {b} is not null) q)"


@query("correlation_summary", " union all ".join(
    f"""select feature, '{TARGET}' as target, rows, p as pearson, s as spearman, abs(p) as abs_pearson, abs(s) as abs_spearman, abs(s) - abs(p) as monotonic_minus_linear
    from (select '{f}' as feature, count({f}) as rows, corr({f}, {TARGET}) as p, {spearman_sql(f, TARGET, 'v_season_stats')} as s from v_season_stats) x""" for f in FEATURES),
       doubles="pearson spearman abs_pearson abs_spearman monotonic_minus_linear", needs="v_season_stats")
def _(spark, d):
    return analysis.correlation_summary(view(spark, d, "v_season_stats"), TARGET, FEATURES)


@query("redundant_pairs", "select * from (" + " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, abs({spearman_sql(a, b, 'v_season_stats')}) as abs_spearman_corr" for a, b in combinations(FEATURES, 2)) + ") z where abs_spearman_corr >= 0.05",
       doubles="abs_spearman_corr", needs="v_season_stats")
def _(spark, d):
    return analysis.redundant_pairs(view(spark, d, "v_season_stats"), FEATURES, 0.05)


def _bin(c: str) -> str:
    return " + ".join(f"({c} > (select quantile_cont({c}, {i / 10}) from performance))::int" for i in range(1, 10))


def _mi(f: str, code: str) -> str:
    return f"""select '{f}' as feature, 'target_next_5_pts_avg' as target, sum(n / t * ln(n * t / (nx * ny))) as mutual_info from (
        select *, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny, sum(n) over () as t
        from (select x, y, count(*)::double as n from (select {code} as x, yb as y from binned) b group by x, y) c) e"""


_MI_FEATURES = ("pts_last_5", "pts_season_avg", "min_last_10")


@query("mutual_information", f"""with binned as (select team_id, {', '.join(f'{_bin(f)} as b_{f}' for f in _MI_FEATURES)}, {_bin('target_next_5_pts_avg')} as yb from performance)
    {' union all '.join([*[_mi(f, f'b_{f}') for f in _MI_FEATURES], _mi('team_id', 'team_id')])}""", doubles="mutual_info", needs="performance")
def _(spark, d):
    return analysis.mutual_information(performance(spark, d), "target_next_5_pts_avg", [*_MI_FEATURES, "team_id"], categorical=["team_id"])


@query("signal_summary", f"""
    with a as ({' union all '.join(f"select '{TARGET}' as target, '{f}' as feature, abs(corr({f}, {TARGET})) as abs_spearman from v_season_stats" for f in FEATURES[:4])}),
         b as ({' union all '.join(f"select '{TARGET}' as target, '{f}' as feature, avg({f}) as mutual_info from v_season_stats" for f in FEATURES[2:])}),
         m as (select coalesce(a.target, b.target) as target, coalesce(a.feature, b.feature) as feature, abs_spearman, mutual_info from a full join b on a.feature = b.feature),
         r as (select *, abs_spearman / (select max(abs_spearman) from m) as rank_score_abs_spearman, mutual_info / (select max(mutual_info) from m) as rank_score_mutual_info from m)
    select *, (coalesce(rank_score_abs_spearman, 0) + coalesce(rank_score_mutual_info, 0)) / ((rank_score_abs_spearman is not null)::int + (rank_score_mutual_info is not null)::int) as combined_signal_score from r""",
       doubles="abs_spearman mutual_info rank_score_abs_spearman rank_score_mutual_info combined_signal_score", needs="v_season_stats")
def _(spark, d):
    df = view(spark, d, "v_season_stats")
    a = analysis.pearson_ranking(df, TARGET, FEATURES[:4]).select("target", "feature", F.col("abs_correlation").alias("abs_spearman"))
    b = df.agg(*[F.avg(f).alias(f) for f in FEATURES[2:]]).unpivot([], list(FEATURES[2:]), "feature", "mutual_info").withColumn("target", F.lit(TARGET))
    return analysis.signal_summary([a, b])
