"""Join, union and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import SHORT_SPLIT, split_sql, table, view
from formline.operators import frames, imputing, joins, splits, topk


@query("enrich_left", """
    select o_orderkey, c_mktsegment, c_nationkey as c_nationkey_dim from orders left join customer on c_custkey = o_custkey""")
def _(spark, d):
    dim = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    out = joins.enrich_left(
        table(spark, d, "orders"), dim.select("o_custkey", "c_mktsegment", F.col("c_nationkey").alias("c_nationkey_dim")),
        ["o_custkey"], ["c_mktsegment", "c_nationkey_dim", "absent"], ["c_mktsegment", "c_nationkey_dim"])
    return out.select("o_orderkey", "c_mktsegment", "c_nationkey_dim")


@query("coalesce_suffix", "select c_custkey, case when c_custkey % 3 = 0 then c_acctbal when c_custkey % 3 = 1 then 1.0 else 2.0 end as balance from customer", doubles="balance")
def _(spark, d):
    k = F.col("c_custkey") % 3
    df = table(spark, d, "customer").select(
        "c_custkey", F.when(k == 0, F.col("c_acctbal")).alias("balance"), F.when(k == 1, 1.0).alias("balance_x"), F.lit(2.0).alias("balance_y"))
    return joins.coalesce_suffix(df, ["balance", "absent"], ["_x", "_y"])


@query("join_by_name_key", r"""
    select s.player_name, s.season_label, p.player_id, p.position from v_salaries s left join v_players p
    on regexp_replace(lower(s.player_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(p.player_name), '[^a-z0-9]', '', 'g')""",
       needs="v_salaries v_players")
def _(spark, d):
    out = joins.join_by_name_key(view(spark, d, "v_salaries"), view(spark, d, "v_players"), ["player_id", "position"], ["player_id"])
    return out.select("player_name", "season_label", "player_id", "position")


@query("join_cap", r"""
    select s.player_name, s.season_label, c.salary_cap_usd,
           try_cast(nullif(regexp_replace(s.salary_usd, '[^0-9.]', '', 'g'), '') as double) / c.salary_cap_usd as salary_cap_share
    from v_salaries s left join v_cap c on c.season = s.season_label""", doubles="salary_cap_usd salary_cap_share", digits=4, needs="v_salaries v_cap")
def _(spark, d):
    from formline.functions.scalars import parse_money

    df = view(spark, d, "v_salaries").withColumn("salary_usd", parse_money("salary_usd"))
    return joins.join_cap(df, view(spark, d, "v_cap")).select("player_name", "season_label", "salary_cap_usd", "salary_cap_share")


@query("join_role", """
    select l.player_id, l.season_label, l.age, r.age as age_role, r.pace from
      (select distinct player_id, season as season_label, 30.0 as age from v_logs_long) l
    left join (select * from (select *, row_number() over (partition by player_id, season order by team_id) as rn from v_season_stats) x where rn = 1) r
    on r.player_id = l.player_id and r.season = l.season_label""", doubles="age age_role pace", needs="v_logs_long v_season_stats")
def _(spark, d):
    base = view(spark, d, "v_logs_long").select("player_id", F.col("season").alias("season_label"), F.lit(30.0).alias("age")).distinct()
    return joins.join_role(base, view(spark, d, "v_season_stats"), ["age", "pace"], ["team_id"])


_HEAVY = "row_number() over (partition by {k} order by minutes desc nulls last, team_id) as rn"


@query("enrich_with_fallback", f"""
    select b.player_id, b.season, b.team_id, coalesce(e.usage_pct, f.usage_pct) as usage_pct, coalesce(b.pace, e.pace, f.pace) as pace
    from (select player_id, season, team_id, case when player_id % 3 = 0 then pace end as pace from v_season_stats) b
    left join (select * from v_season_stats where team_id <> 'R') e on e.player_id = b.player_id and e.season = b.season and e.team_id = b.team_id
    left join (select * from (select *, {_HEAVY.format(k='player_id, season')} from v_season_stats where team_id <> 'R') x where rn = 1) f
      on f.player_id = b.player_id and f.season = b.season""", doubles="usage_pct pace", needs="v_season_stats")
def _(spark, d):
    stats = view(spark, d, "v_season_stats")
    base = stats.select("player_id", "season", "team_id", F.when(F.col("player_id") % 3 == 0, F.col("pace")).alias("pace"))
    return joins.enrich_with_fallback(base, stats.filter(F.col("team_id") != "R"), ["usage_pct", "pace"])


@query("join_multi_source", """
    select player_id, season, team_id, coalesce(case when player_id % 2 = 0 then steal_rate end, case when team_id <> 'A' then block_rate end, case when season < '1999' then foul_rate end) as steal_rate,
           case when team_id <> 'A' then usage_pct end as usage_pct
    from v_season_stats""", doubles="steal_rate usage_pct", needs="v_season_stats")
def _(spark, d):
    stats = view(spark, d, "v_season_stats")
    keys = ["player_id", "season", "team_id"]
    main = stats.select(*keys, F.when(F.col("player_id") % 2 == 0, F.col("steal_rate")).alias("steal_rate"))
    usage = stats.filter(F.col("team_id") != "A").select(*keys, F.col("block_rate").alias("steal_rate"), "usage_pct")
    defense = stats.filter(F.col("season") < "1999").select(*keys, F.col("foul_rate").alias("steal_rate"))
    return joins.join_multi_source(main, usage, defense, keys, ["steal_rate", "usage_pct"], ["steal_rate"])


_YEARLY = "select player_id, cast(substring(season, 1, 4) as int) as y, count(*) as games, sum(points) as points from v_logs_sparse group by 1, 2"


def _yearly(spark, d):
    y = F.substring("season", 1, 4).cast("int").alias("y")
    return view(spark, d, "v_logs_sparse").groupBy("player_id", y).agg(F.count(F.lit(1)).alias("games"), F.sum("points").alias("points"))


@query("lag_join_inner", f"""
    with s as ({_YEARLY}) select a.player_id, a.y, a.games, a.points, b.games as prev_games, b.points as prev_points
    from s a join s b on a.player_id = b.player_id and b.y = a.y - 1""", doubles="points prev_points", digits=4, needs="v_logs_sparse")
def _(spark, d):
    s = _yearly(spark, d)
    return joins.lag_join_inner(s, s, "player_id", "y")


@query("future_lookup_left", f"""
    with s as ({_YEARLY}) select a.player_id, a.y, a.games, a.points, b.games as games_h2, b.player_id is not null as present_h2
    from s a left join s b on a.player_id = b.player_id and b.y = a.y + 2""", doubles="points games_h2", digits=4, needs="v_logs_sparse")
def _(spark, d):
    s = _yearly(spark, d)
    return joins.future_lookup_left(s, s, "player_id", "y", 2, ["games"])


@query("merge_signal_tables", """
    select coalesce(a.target, b.target) as target, coalesce(a.feature, b.feature) as feature, a.x, b.z from
      (select 'n' as target, n_name as feature, n_nationkey as x from nation where n_nationkey < 18) a
    full join (select 'n' as target, n_name as feature, n_regionkey as z from nation where n_nationkey > 6) b on a.target = b.target and a.feature = b.feature""",
       doubles="x z")
def _(spark, d):
    n = table(spark, d, "nation").select(F.lit("n").alias("target"), F.col("n_name").alias("feature"), "n_nationkey", "n_regionkey")
    a = n.filter("n_nationkey < 18").select("target", "feature", F.col("n_nationkey").alias("x"))
    b = n.filter("n_nationkey > 6").select("target", "feature", F.col("n_regionkey").alias("z"))
    return joins.merge_signal_tables([a, b])


@query("overlay", """
    select k, max(v) as v from (select c_custkey as k, case when c_custkey % 4 = 0 then 'override' else 'default' end as v from customer
    union all select c_custkey + 100000, 'override' from customer where c_custkey % 4 = 0) x group by k""")
def _(spark, d):
    c = table(spark, d, "customer")
    default = c.select(F.col("c_custkey").alias("k"), F.lit("default").alias("v"))
    other = c.filter("c_custkey % 4 = 0")
    override = other.select(F.col("c_custkey").alias("k"), F.lit("override").alias("v")).unionByName(
        other.select((F.col("c_custkey") + 100000).alias("k"), F.lit("override").alias("v")))
    return frames.overlay(default, override, "k")


# --- imputation and scaling ---------------------------------------------------------------
@query("fill_median", """
    select player_id, season, team_id, coalesce(pace, (select median(pace) from v_season_stats)) as pace,
           coalesce(age, (select median(age) from v_season_stats where season < '1999')) as age
    from v_season_stats""", doubles="pace age", needs="v_season_stats")
def _(spark, d):
    df = imputing.fill_median(view(spark, d, "v_season_stats"), ["pace", "absent"])
    return imputing.fill_median(df, ["age"], F.col("season") < "1999").select("player_id", "season", "team_id", "pace", "age")


@query("group_median_fill", """
    with g as (select player_id, season, team_id, block_rate is null as block_rate_was_missing,
                      coalesce(block_rate, median(block_rate) over (partition by season, case when season >= '2001' then 1 end)) as b,
                      case when season >= '2001' then null else usage_pct end as u0 from v_season_stats),
         h as (select *, coalesce(u0, median(u0) over (partition by season)) as u from g)
    select player_id, season, team_id, block_rate_was_missing, u0 is null as usage_pct_was_missing, b as block_rate,
           coalesce(u, (select median(u) from h), 0) as usage_pct from h""", doubles="block_rate usage_pct", needs="v_season_stats")
def _(spark, d):
    df = view(spark, d, "v_season_stats").withColumn("usage_pct", F.when(F.col("season") < "2001", F.col("usage_pct")))
    out = imputing.flag_and_fill(df, ["block_rate", "usage_pct"], "season")
    return out.select("player_id", "season", "team_id", "block_rate_was_missing", "usage_pct_was_missing", "block_rate", "usage_pct")


@query("standardize", """
    select player_id, season, team_id, (minutes - (select avg(minutes) from v_season_stats)) / (select stddev_pop(minutes) from v_season_stats) as minutes_z,
           (1.0 - 1.0) / 1 as flat_z from v_season_stats""", doubles="minutes_z flat_z", needs="v_season_stats")
def _(spark, d):
    df = view(spark, d, "v_season_stats").withColumn("flat", F.lit(1.0))
    return imputing.standardize(df, ["minutes", "flat"]).select("player_id", "season", "team_id", "minutes_z", "flat_z")


_TR = split_sql("season", SHORT_SPLIT)


@query("scale_sequences", f"""
    with s as (select game_id, {_TR} as split, pts, ast, list(pts) over w as x, count(pts) over w as n from v_logs_short
               window w as (partition by player_id, season order by as_of_date, game_id rows between 4 preceding and current row)),
         f as (select * from s where n = 5 and ast is not null), c as (select unnest(x) as v from f where split = 'train'),
         st as (select avg(v) as m, stddev_pop(v) as sd from c), sa as (select avg(ast) as m, stddev_pop(ast) as sd from f where split = 'train'),
         y as (select avg(pts - ast) as m, stddev_pop(pts - ast) as sd from f where split = 'train')
    select game_id, (x[5] - st.m) / st.sd as last_cell, (ast - sa.m) / sa.sd as static0, (pts - ast - y.m) / y.sd as y_scaled, pts as y_restored
    from f, st, sa, y""", doubles="last_cell static0 y_scaled y_restored", digits=3, needs="v_logs_short")
def _(spark, d):
    from pyspark.sql import Window

    df = view(spark, d, "v_logs_short").withColumn("split", splits.assign_split("season", SHORT_SPLIT))
    w = Window.partitionBy("player_id", "season").orderBy("as_of_date", "game_id").rowsBetween(-4, 0)
    cells = F.collect_list(F.when(F.col("pts").isNotNull(), F.array(F.col("pts").cast("float")))).over(w)
    seq = df.withColumn("x_seq", cells).filter((F.size("x_seq") == 5) & F.col("ast").isNotNull())
    seq = seq.select("game_id", "split", "x_seq", F.array(F.col("ast").cast("float")).alias("x_static"),
                     (F.col("pts") - F.col("ast")).alias("y_delta"), F.col("ast").alias("baseline"))
    stats = imputing.sequence_scaler(seq, F.col("split") == "train", scale_target=True)
    out = imputing.inverse_scaler(imputing.apply_scaler(seq, stats), stats, "y_delta_scaled")
    return out.select("game_id", F.element_at("x_seq_scaled", -1)[0].alias("last_cell"), F.col("x_static_scaled")[0].alias("static0"),
                      F.col("y_delta_scaled").alias("y_scaled"), F.col("y_pred").alias("y_restored"))
