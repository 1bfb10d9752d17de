"""Scalar, projection and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import LONG_SPLIT, SHORT_SPLIT, split_sql, table, view
from formline.config import SALARY_CAPS, TEAM_ALIASES
from formline.functions import scalars as S
from formline.operators import frames, labels, splits
from formline.sources import tables


@query("scan_table", "select n_nationkey, n_name, n_regionkey from nation")
def _(spark, d):
    df = tables.scan_table(spark, f"{d}/nation.parquet")
    return tables.require_columns(df, ["n_nationkey"], "nation").select("n_nationkey", "n_name", "n_regionkey")


@query("scan_dir", """
    select 'orders' as file, count(*) as n, sum(o_custkey) as total from orders""")
def _(spark, d):
    df = tables.scan_dir(spark, d, "parquet", pattern="orders")
    file = F.regexp_extract("source_file", r"(orders)\.parquet", 1).alias("file")
    return df.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("total"))


_CAP_SQL = """
    select season, salary_cap_usd, 'given' as source from v_cap
    union all
    select * from (values """ + ", ".join(f"('{s}', {c}, 'curated_salary_cap_history')" for s, c, _ in SALARY_CAPS) + """) d(season, salary_cap_usd, source)
    where season not in (select season from v_cap)"""


@query("salary_cap_overlay", _CAP_SQL, doubles="salary_cap_usd", digits=2, needs="v_cap")
def _(spark, d):
    given = view(spark, d, "v_cap").withColumn("source", F.lit("given"))
    full = tables.complete_salary_cap(spark, given)
    return full.select("season", "salary_cap_usd", "source")


@query("schema_report", """
    select 'orders' as table, count(*) as rows, 'o_channel' as missing_columns,
           'o_orderdate, o_orderpriority, o_orderstatus, o_totalprice' as extra_columns from orders
    union all
    select 'customer', count(*), '', 'c_acctbal, c_mktsegment, c_nationkey' from customer""")
def _(spark, d):
    from formline.operators.quality import schema_report

    frames_ = {n: table(spark, d, n) for n in ("orders", "customer")}
    return schema_report(frames_, {"orders": ["o_orderkey", "o_custkey", "o_channel"], "customer": ["c_custkey", "c_name"]})


@query("snake_case", r"""
    select p_partkey, lower(trim(regexp_replace(regexp_replace(concat(p_type, ' ', p_brand, 'Size%'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^a-zA-Z0-9]+', '_', 'g'), '_')) as name
    from part""")
def _(spark, d):
    text = F.concat("p_type", F.lit(" "), "p_brand", F.lit("Size%"))
    return table(spark, d, "part").select("p_partkey", S.snake_case_text(text).alias("name"))


@query("snake_case_columns", "select c_custkey as cust_key, c_name as customer_name, c_acctbal as acct_bal_usd from customer")
def _(spark, d):
    raw = table(spark, d, "customer").select(
        F.col("c_custkey").alias("CustKey"), F.col("c_name").alias("Customer Name!"), F.col("c_acctbal").alias("acctBal (USD)")
    )
    return S.snake_case_columns(raw)


@query("name_key", r"""
    select c_custkey, regexp_replace(lower(n), '[^a-z0-9]', '', 'g') as strict, replace(replace(trim(lower(n)), '.', ''), '''', '') as light
    from (select c_custkey, case when c_custkey % 17 = 0 then null else concat(' ', c_name, ' Jr.''s ') end as n from customer) x""")
def _(spark, d):
    name = F.when(F.col("c_custkey") % 17 != 0, F.concat(F.lit(" "), "c_name", F.lit(" Jr.'s ")))
    return table(spark, d, "customer").select("c_custkey", S.name_key(name).alias("strict"), S.name_key(name, "light").alias("light"))


_ALIAS_CASE = " ".join(f"when '{a}' then '{b}'" for a, b in TEAM_ALIASES.items())


@query("normalize_code", f"""
    select c_custkey, case upper(trim(t)) {_ALIAS_CASE} else upper(trim(t)) end as code
    from (select c_custkey, case c_custkey % 5 when 0 then ' brk' when 1 then 'pho ' when 2 then 'NOK' when 3 then null
          else substring(c_mktsegment, 1, 3) end as t from customer) x""")
def _(spark, d):
    k = F.col("c_custkey") % 5
    text = F.when(k == 0, " brk").when(k == 1, "pho ").when(k == 2, "NOK").when(k == 4, F.substring("c_mktsegment", 1, 3))
    return table(spark, d, "customer").select("c_custkey", S.normalize_code(text).alias("code"))


@query("percent_to_ratio", """
    select event_id, case when x <= 1.5 then x else x / 100 end as ratio
    from (select event_id, case when event_id % 9 = 0 then null when event_id % 2 = 0 then value else value / 100 end as x from events) e""",
       doubles="ratio")
def _(spark, d):
    e = F.col("event_id")
    x = F.when(e % 9 == 0, None).when(e % 2 == 0, F.col("value")).otherwise(F.col("value") / 100)
    return table(spark, d, "events").select("event_id", S.percent_to_ratio(x).alias("ratio"))


@query("parse_money", r"""
    select player_name, season_label, cast(nullif(regexp_replace(salary_usd, '[^0-9.]', '', 'g'), '') as double) as salary from v_salaries""",
       doubles="salary", digits=2, needs="v_salaries")
def _(spark, d):
    return view(spark, d, "v_salaries").select("player_name", "season_label", S.parse_money("salary_usd").alias("salary"))


@query("normalize_season", """
    select o_orderkey, y as start_year, y + 1 as end_year, concat(cast(y as varchar), '-', right(cast(y + 1 as varchar), 2)) as label,
           y as first_year
    from (select o_orderkey, cast(year(o_orderdate) as int) as y from orders) o""")
def _(spark, d):
    y = F.year("o_orderdate")
    long = F.concat(y.cast("string"), F.lit("/"), (y + 1).cast("string"))
    short = F.concat(F.lit("season "), y.cast("string"), F.lit("-"), F.right((y + 1).cast("string"), F.lit(2)))
    text = F.when(F.col("o_orderkey") % 2 == 0, long).otherwise(short)
    s = S.normalize_season(text)
    return table(spark, d, "orders").select(
        "o_orderkey", s["start"].alias("start_year"), s["end"].alias("end_year"), s["label"].alias("label"),
        S.season_start_year(text).alias("first_year"),
    )


@query("season_of_date", """
    select game_id, line, part, player_id, season as label, cast(substring(season, 1, 4) as int) as start_year, cast(substring(season, 1, 4) as int) + 1 as end_year
    from v_logs_long""", needs="v_logs_long")
def _(spark, d):
    df = view(spark, d, "v_logs_long")
    end = S.season_end_year_from_date("game_date")
    return df.select(
        "game_id", "line", "part", "player_id", S.season_label_from_end_year(end).alias("label"),
        S.season_start_year("season", strict=True).alias("start_year"), end.alias("end_year"),
    )


@query("parse_minutes", """
    select event_id, case when event_id % 3 = 0 then k + (event_id % 60) / 60.0 when event_id % 3 = 1 then k + 0.5 end as minutes
    from (select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events) e""", doubles="minutes")
def _(spark, d):
    k = F.regexp_extract("props", "([0-9]+)", 1)
    e = F.col("event_id")
    clock = F.concat(F.lit(" "), k, F.lit(":"), F.lpad((e % 60).cast("string"), 2, "0"))
    text = F.when(e % 3 == 0, clock).when(e % 3 == 1, F.concat(k, F.lit(".5"))).otherwise("DNP")
    return table(spark, d, "events").select("event_id", S.parse_minutes(text).alias("minutes"))


@query("safe_divide", """
    select player_id, game_id, line, part, case when rebounds <> 0 then assists / rebounds end as ratio, assists / minutes * 36 as per_36
    from v_logs_long""", doubles="ratio per_36", needs="v_logs_long")
def _(spark, d):
    return view(spark, d, "v_logs_long").select(
        "player_id", "game_id", "line", "part", S.safe_divide("assists", "rebounds").alias("ratio"),
        S.per_unit("assists", "minutes", 36, positive_only=True).alias("per_36"),
    )


@query("rate_stats", """
    select player_id, game_id, line, part, points / nullif(2 * (fga + 0.44 * fta), 0) as true_shooting_pct,
           fg3a / nullif(fga, 0) as three_point_attempt_rate, fta / nullif(fga, 0) as free_throw_rate,
           turnovers / nullif(fga + 0.44 * fta + turnovers, 0) as turnover_rate, steals / nullif(minutes, 0) * 36 as steal_rate,
           blocks / nullif(minutes, 0) * 36 as block_rate, defensive_rebounds / nullif(minutes, 0) * 36 as defensive_rebound_rate,
           personal_fouls / nullif(minutes, 0) * 36 as foul_rate, points / nullif(minutes, 0) * 100 as points_per_100,
           assists / nullif(minutes, 0) * 100 as assists_per_100, rebounds / nullif(minutes, 0) * 100 as rebounds_per_100
    from v_logs_long""",
       doubles="true_shooting_pct three_point_attempt_rate free_throw_rate turnover_rate steal_rate block_rate "
               "defensive_rebound_rate foul_rate points_per_100 assists_per_100 rebounds_per_100", needs="v_logs_long")
def _(spark, d):
    return S.rate_stats(view(spark, d, "v_logs_long")).select(
        "player_id", "game_id", "line", "part", "true_shooting_pct", "three_point_attempt_rate", "free_throw_rate",
        "turnover_rate", "steal_rate", "block_rate", "defensive_rebound_rate", "foul_rate", "points_per_100",
        "assists_per_100", "rebounds_per_100",
    )


@query("standardize_position", """
    select s_suppkey, case s_suppkey % 4 when 0 then 'G/SF' when 1 then 'C' when 2 then 'UNK' else 'UNK' end as position,
           case when s_nationkey % 2 = 0 and s_suppkey % 3 = 0 then 'G/C' when s_nationkey % 2 = 0 then 'G' when s_suppkey % 3 = 0 then 'C' end as flags
    from supplier""")
def _(spark, d):
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, " g-x/sf").when(k == 1, "C").when(k == 2, "wing")
    return table(spark, d, "supplier").select(
        "s_suppkey", S.standardize_position(text).alias("position"),
        S.position_from_flags((F.col("s_nationkey") % 2 == 0).cast("int"), F.lit(0), (F.col("s_suppkey") % 3 == 0).cast("int")).alias("flags"),
    )


@query("ages", """
    select player_id, date_diff('day', birth_date, date '1999-03-01') / 365.25 as age,
           date_diff('day', birth_date, date '1998-10-01') / 365.25 as season_age, 1998 - year(birth_date) as coarse
    from v_players""", doubles="age season_age coarse", needs="v_players")
def _(spark, d):
    return view(spark, d, "v_players").select(
        "player_id", S.age_at(F.lit("1999-03-01").cast("date"), "birth_date").alias("age"),
        S.season_age(F.lit(1998), "birth_date").alias("season_age"), S.coarse_age(F.lit("1998-99"), "birth_date").alias("coarse"),
    )


@query("home_away", """
    select game_id, line, part, player_id, case when team_id = 'A' then 'HOME' else 'AWAY' end as home_away,
           case when team_id = 'A' then 'N' else 'A' end as opponent from v_logs_long""", needs="v_logs_long")
def _(spark, d):
    df = view(spark, d, "v_logs_long")
    return df.withColumns(S.home_away_opponent("team_id", F.lit("A"), F.lit("N"))).select(
        "game_id", "line", "part", "player_id", "home_away", "opponent")


@query("parse_matchup", """
    select o_orderkey, case o_orderkey % 3 when 0 then 'BOS' when 1 then 'NY' end as opponent,
           case when o_orderkey % 3 = 0 then 'AWAY' else 'HOME' end as home_away from orders""")
def _(spark, d):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "LAL @ BOS").when(k == 1, "LAL vs. NY").otherwise("bye")
    return table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in S.parse_matchup(text).items()])


@query("clip", """
    select event_id, case when pts is not null then least(greatest(pts, 5.0), 40.0) end as pts, case when ast is not null then greatest(ast, 10.0) end as ast
    from (select game_id as event_id, pts, ast from v_logs_short) e""", doubles="pts ast", needs="v_logs_short")
def _(spark, d):
    df = view(spark, d, "v_logs_short").select(F.col("game_id").alias("event_id"), "pts", "ast")
    return S.clip(df, {"pts": (5, 40), "ast": (10, None), "absent": (0, 1)})


@query("coerce_numeric", """
    select o_orderkey, try_cast(case when o_orderkey % 4 = 0 then 'n/a' else cast(o_orderkey % 1000 as varchar) end as double) as x,
           (case when o_orderstatus = 'F' then 1 else 0 end) * o_totalprice as flagged from orders""", doubles="x flagged", digits=2)
def _(spark, d):
    df = table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 0, "n/a").otherwise((F.col("o_orderkey") % 1000).cast("string"))
    df = S.coerce_numeric(df.withColumn("x", text), ["x"])
    return S.interaction(df, {"flagged": (F.col("o_orderstatus") == "F", "o_totalprice")}).select("o_orderkey", "x", "flagged")


@query("row_mean", """
    select player_id, season, team_id, (coalesce(usage_pct, 0) + coalesce(pace, 0)) / nullif((usage_pct is not null)::int + (pace is not null)::int, 0) as m
    from v_season_stats""", doubles="m", needs="v_season_stats")
def _(spark, d):
    return view(spark, d, "v_season_stats").select("player_id", "season", "team_id", S.row_mean(["usage_pct", "pace"]).alias("m"))


@query("canonicalize_logs", """
    select *, cast(epoch_us(game_date) // 86400000000 - epoch_us(lag(game_date) over (partition by player_id order by game_date, game_id, line, part)) // 86400000000 as int) as rest_days
    from (
      select player_id, game_id, line, part, season, cast(substring(season, 1, 4) as int) + 1 as season_end_year, game_date, minutes, points, assists, rebounds,
             team_id, case when team_id = 'A' then 'HOME' else 'AWAY' end as home_away,
             case when team_id = 'A' then 'N' else 'A' end as opponent, points / nullif(2 * (fga + 0.44 * fta), 0) as true_shooting_pct
      from v_logs_long where line <> 3) x where season_end_year between 1996 and 2000""",
       doubles="minutes points assists rebounds true_shooting_pct rest_days", needs="v_logs_long")
def _(spark, d):
    raw = view(spark, d, "v_logs_long").select(
        F.col("player_id").alias("personId"), F.col("game_id").alias("gameId"), "line", "part", F.col("game_date").cast("string").alias("gameDate"),
        F.col("team_id").alias("teamTricode"), F.lit("A").alias("home"), F.lit("N").alias("away"),
        F.concat(F.col("minutes").cast("int").cast("string"), F.lit(":00")).alias("MIN"), F.col("points").cast("string").alias("PTS"),
        F.col("assists").alias("AST"), F.col("rebounds").alias("reboundsTotal"), "fga", "fta",
        F.when(F.col("line") == 3, "Playoffs").otherwise("Regular Season").alias("game_type"),
    ).withColumnsRenamed({"line": "fg3m", "part": "fgm"})
    out = frames.canonicalize_logs(raw, first_year=1996, last_year=2000, tie=("fg3m", "fgm"))
    return out.select(
        "player_id", "game_id", F.col("fg3m").cast("int").alias("line"), F.col("fgm").cast("long").alias("part"), "season", "season_end_year",
        "game_date", "minutes", "points", "assists", "rebounds", "team_id", "home_away", "opponent", "true_shooting_pct", "rest_days",
    )


@query("filter_regular_season", "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F'")
def _(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "Regular Season").otherwise("Playoffs")
    df = table(spark, d, "orders").withColumns({"game_type": kind, "season": F.lit("regular"), "season_note": F.lit("none")})
    return frames.filter_regular_season(df).select("o_orderkey", "o_orderpriority")


@query("filter_period_between", "select o_orderkey from orders where o_orderdate between timestamp '1996-01-01' and timestamp '1997-06-30'")
def _(spark, d):
    df = table(spark, d, "orders")
    low, high = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz")
    return frames.filter_period_between(df, "o_orderdate", low, high).select("o_orderkey")


@query("complete_cases", "select game_id, pts from v_logs_short where pts is not null", doubles="pts", needs="v_logs_short")
def _(spark, d):
    return frames.complete_cases(view(spark, d, "v_logs_short"), ["pts", "absent"]).select("game_id", "pts")


@query("valid_salary_rows", """
    select c_custkey from (select c_custkey, c_acctbal as salary, 5000.0 as cap, c_acctbal / 5000 as share from customer) c
    where salary > 0 and cap > 0 and share between 0 and 1.5""")
def _(spark, d):
    df = table(spark, d, "customer").withColumns({
        "salary_usd": F.col("c_acctbal"), "salary_cap_usd": F.lit(5000.0), "salary_cap_share": F.col("c_acctbal") / 5000})
    return frames.valid_salary_rows(df).select("c_custkey")


@query("fill_unknown", """
    select player_id, coalesce(position, 'UNK') as position, position is null as position_was_missing, weight is null as weight_was_missing
    from v_players""", needs="v_players")
def _(spark, d):
    df = frames.missing_flags(view(spark, d, "v_players"), ["position", "weight", "absent"])
    return frames.fill_unknown(df, ["position"]).select("player_id", "position", "position_was_missing", "weight_was_missing")


@query("infer_features", """
    select unnest(['age', 'minutes', 'usage_pct']) as feature, count(*) as n from v_season_stats""", needs="v_season_stats")
def _(spark, d):
    df = view(spark, d, "v_season_stats").select(
        "player_id", "season", "team_id", "age", "minutes", "usage_pct", F.lit(1).alias("active_h1"), F.lit(2).alias("x_h2"),
        F.lit(None).cast("double").alias("empty"), F.lit(3).alias("target_next"))
    found = frames.infer_features(df, ["usage_target"], horizon_guard=True, observed_only=True)
    return df.select(F.explode(F.array(*[F.lit(f) for f in found])).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("split_rows", f"""
    select game_id, {split_sql('season', SHORT_SPLIT)} as split from v_logs_short
    where {split_sql('season', SHORT_SPLIT)} = 'train'""", needs="v_logs_short")
def _(spark, d):
    df = view(spark, d, "v_logs_short").withColumn("split", splits.assign_split("season", SHORT_SPLIT))
    return frames.split_rows(df, "train").select("game_id", "split")


@query("assign_split", f"""
    select player_id, game_id, line, part, {split_sql('season', LONG_SPLIT)} as by_season,
           case when season in ('1996-97') then 'validation' when season in ('1997-98') then 'test' when season in ('1995-96') then 'train' else 'ignore' end as by_set,
           case when y <= 1997 then 'train' when y = 1998 then 'validation' when y = 1999 then 'test' else 'ignore' end as by_year
    from (select *, cast(substring(season, 1, 4) as int) as y from v_logs_long) x""", needs="v_logs_long")
def _(spark, d):
    return view(spark, d, "v_logs_long").select(
        "player_id", "game_id", "line", "part", splits.assign_split("season", LONG_SPLIT).alias("by_season"),
        splits.assign_split_sets("season", ["1995-96"], ["1996-97"], ["1997-98"]).alias("by_set"),
        splits.assign_split_year(S.season_start_year("season"), 1997, 1998, 1999).alias("by_year"),
    )


@query("supervised_splits", f"""
    select split, count(*) as n, sum(pts) as pts from (select *, {split_sql('season', SHORT_SPLIT)} as split from v_logs_short) s
    where split in ('train', 'validation', 'test') and pts is not null group by split""", doubles="pts", digits=3, needs="v_logs_short")
def _(spark, d):
    df = view(spark, d, "v_logs_short").withColumn("split", splits.assign_split("season", SHORT_SPLIT))
    parts = splits.make_supervised_splits(df, ["ast", "reb"], "pts")
    tagged = [p.withColumn("split", F.lit(n)) for n, p in zip(parts._fields, parts)]
    return frames.union_all(tagged).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("pts").alias("pts"))


@query("union_all", """
    select 'customer' as kind, c_custkey as key, c_acctbal as balance, c_mktsegment as segment from customer
    union all select 'supplier', s_suppkey, s_acctbal, null from supplier""")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return frames.union_all([frames.add_constant_tags(c, {"kind": "customer"}), frames.add_constant_tags(s, {"kind": "supplier"})])


@query("long_by_stat", """
    select game_id, 'pts' as stat, pts as actual, ast as other from v_logs_short union all select game_id, 'reb', reb, min from v_logs_short""",
       doubles="actual other", needs="v_logs_short")
def _(spark, d):
    return frames.long_by_stat(view(spark, d, "v_logs_short"), ["game_id"], {
        "pts": {"actual": "pts", "other": "ast"}, "reb": {"actual": "reb", "other": "min"}})


_S = "c_acctbal / 10000"


@query("salary_buckets", f"""
    select c_custkey, case when s is null then 'unknown' when s < 0.03 then 'minimum_or_low' when s < 0.08 then 'rotation_contract' when s < 0.18 then 'starter_contract' else 'premium_contract' end as band,
           case when s is null then 'unknown' when s < 0.04 then 'minimum_bench' when s < 0.10 then 'rotation' when s < 0.22 then 'starter' else 'star' end as tier,
           case when a <= 24 then 'early' when a <= 29 then 'prime' when a <= 33 then 'late_prime' else 'aging' end as phase
    from (select c_custkey, case when c_custkey % 7 = 0 then null else {_S} end as s, 18 + c_custkey % 20 as a from customer) c""")
def _(spark, d):
    s = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 10000)
    return table(spark, d, "customer").select(
        "c_custkey", labels.contract_band(s).alias("band"), labels.market_tier(s).alias("tier"),
        labels.career_phase(18 + F.col("c_custkey") % 20).alias("phase"))


@query("target_modes", """
    select o_orderkey, o_totalprice / 400000 as share, ln(1 + o_totalprice) as log_usd,
           greatest(exp(ln(1 + o_totalprice)) - 1, 0) / 400000 as back, greatest(0.1 - o_totalprice / 400000, 0) as delta_back
    from orders""", doubles="share log_usd back delta_back")
def _(spark, d):
    df = table(spark, d, "orders").withColumns({
        "salary_usd": F.col("o_totalprice"), "salary_cap_usd": F.lit(400000.0), "salary_cap_share": F.col("o_totalprice") / 400000,
        "previous_salary_cap_share": F.lit(0.1)})
    df = df.withColumn("log_usd", labels.target_mode("log_salary_usd"))
    return df.select(
        "o_orderkey", labels.target_mode("cap_share").alias("share"), "log_usd",
        labels.prediction_to_share("log_usd", "log_salary_usd").alias("back"),
        labels.prediction_to_share(-F.col("salary_cap_share"), "delta_cap_share").alias("delta_back"))


@query("clip_prediction", """
    select c_custkey, greatest(c_acctbal, 0) as rate, least(greatest(c_acctbal / 100, 0), 48) as minutes from customer""", doubles="rate minutes")
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", labels.clip_prediction("c_acctbal", "rate").alias("rate"),
        labels.clip_prediction(F.col("c_acctbal") / 100, "minutes").alias("minutes"))
