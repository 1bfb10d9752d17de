"""Views over the given tables in SQL that Spark and DuckDB both accept, and SQL-only views
of derived tables for the comparison side."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from formline.config import FORM_STATS, STATS, SplitConfig

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

_SEASON = (
    "concat(cast(year(l_shipdate) - case when month(l_shipdate) >= 7 then 0 else 1 end as string), '-', "
    "right(cast(year(l_shipdate) + case when month(l_shipdate) >= 7 then 1 else 0 end as string), 2))"
)

# name -> (sources, SQL)
BASE: dict[str, tuple[tuple[str, ...], str]] = {
    "v_logs_short": (("events",), """
        select user_id as player_id, concat('user ', cast(user_id as string)) as player_name, event_id as game_id,
               ts as as_of_date, ts as game_date, cast(cast(date_trunc('week', ts) as date) as string) as season,
               event_type as team_id, case when event_id % 17 = 0 then null else value end as pts,
               cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) as double) as ast, value / 10 as reb,
               cast(24 + cast(regexp_extract(props, '([0-9]+)', 1) as int) % 24 as double) as min
        from events"""),
    "v_logs_long": (("lineitem",), f"""
        select l_suppkey as player_id, concat('Supplier ', cast(l_suppkey as string)) as player_name,
               l_orderkey as game_id, l_shipdate as game_date, l_linenumber as line, l_partkey as part,
               {_SEASON} as season, l_returnflag as team_id, l_quantity as minutes,
               l_extendedprice / 1000 as points,
               case when l_partkey % 17 = 0 then null else l_discount * 100 end as assists, l_tax * 100 as rebounds,
               l_quantity * 2 as fga, l_tax * 50 as fta, l_discount * 80 as fg3a,
               case when l_orderkey % 19 = 0 then null else l_discount * 10 end as true_shooting_pct,
               l_tax * 20 as steals, l_discount * 15 as blocks, l_tax * 60 as defensive_rebounds,
               l_discount * 30 as personal_fouls, l_tax * 30 as turnovers
        from lineitem"""),
    "v_logs_sparse": (("orders",), """
        select o_custkey as player_id, concat('customer ', cast(o_custkey as string)) as player_name,
               o_orderkey as game_id, o_orderdate as game_date,
               concat(cast(year(o_orderdate) as string), '-', right(cast(year(o_orderdate) + 1 as string), 2)) as season,
               o_orderstatus as team_id, cast(10 + o_orderkey % 30 as double) as minutes, o_totalprice / 10000 as points,
               cast(o_orderkey % 12 as double) as assists, cast(o_orderkey % 9 as double) as rebounds
        from orders"""),
    "v_players": (("supplier",), """
        select s_suppkey as player_id, s_name as player_name,
               case when s_suppkey % 17 = 0 then null else date '1970-01-01' + cast(s_suppkey % 9000 as int) end as birth_date,
               case when s_suppkey % 13 = 0 then null when s_nationkey % 3 = 0 then 'G' when s_nationkey % 3 = 1 then 'F'
                    else 'C' end as position,
               cast(70 + s_suppkey % 15 as double) as height,
               case when s_suppkey % 11 = 0 then null else cast(180 + s_suppkey % 60 as double) end as weight
        from supplier"""),
    "v_season_stats": (("lineitem",), f"""
        select l_suppkey as player_id, concat('Supplier#', cast(l_suppkey as string)) as player_name, {_SEASON} as season,
               l_returnflag as team_id, case when l_suppkey % 13 = 0 then null else cast(20 + l_suppkey % 20 as double) end as age,
               sum(l_quantity) as minutes,
               case when l_suppkey % 7 = 0 then null when l_suppkey % 2 = 0 then avg(l_discount) * 4
                    else avg(l_discount) * 400 end as usage_pct,
               avg(l_extendedprice) / 2500 as points_per_100, avg(l_linenumber) as assists_per_100,
               avg(l_quantity) / 3 as rebounds_per_100, avg(l_tax) * 14 as true_shooting_pct,
               avg(case when l_linestatus = 'F' then 1.0e0 else 0.0e0 end) as three_point_attempt_rate,
               avg(l_linenumber) / 7 as free_throw_rate, avg(l_discount) as turnover_rate, avg(l_tax) * 10 as steal_rate,
               case when l_suppkey % 5 = 0 then null else avg(l_linenumber) / 4 end as block_rate,
               avg(l_quantity) / 100 as defensive_rebound_rate, avg(l_discount) * 10 as foul_rate,
               case when l_suppkey % 4 = 0 then null else 90 + avg(l_quantity) / 5 end as pace,
               sum(l_quantity) * 2 as possessions, 100 + avg(l_extendedprice) / 5000 as offensive_rating,
               100 + avg(l_tax) * 100 as defensive_rating
        from lineitem group by l_suppkey, {_SEASON}, l_returnflag"""),
    "v_salaries": (("lineitem",), f"""
        select concat(case when l_suppkey % 2 = 0 then 'SUPPLIER#' else 'Supplier.# ' end,
                      right(concat('000000000', cast(l_suppkey as string)), 9)) as player_name,
               {_SEASON} as season_label, cast(substring({_SEASON}, 1, 4) as int) as season_start_year,
               case when l_suppkey % 3 = 0 then 'brk' when l_suppkey % 3 = 1 then ' PHO ' else 'LAL' end as team,
               case when l_suppkey % 23 = 0 then '' else concat('$ ', cast(cast(floor(sum(l_extendedprice)) as bigint) as string), ',000.25') end
                   as salary_usd
        from lineitem group by l_suppkey, {_SEASON}"""),
    "v_cap": (("lineitem",), f"""
        select {_SEASON} as season, floor(sum(l_extendedprice)) * 100 as salary_cap_usd,
               floor(sum(l_extendedprice)) * 120 as tax_level_usd
        from lineitem where l_shipdate >= timestamp '1995-07-01 00:00:00' group by {_SEASON}"""),
}

SHORT_SPLIT = SplitConfig(train=("2024-01-01", "2024-01-08"), validation=("2024-01-15",), test=("2024-01-22",))
LONG_SPLIT = SplitConfig(train_end="1998-99", validation=("1999-00",), test=("2000-01",))


def _form(stats: Sequence[str], targets: Sequence[str], least: dict[int, int], season_least: int) -> str:
    """SQL columns of the form features."""
    out = []
    for s in stats:
        for n in (5, 10):
            out.append(f"case when count({s}) over w{n} >= {least[n]} then avg({s}) over w{n} end as {s}_last_{n}")
        out.append(f"case when count({s}) over upto >= {season_least} then avg({s}) over upto end as {s}_season_avg")
    out += [f"case when count({s}) over nxt = 5 then avg({s}) over nxt end as target_next_5_{s}_avg" for s in targets]
    return ",\n".join(out)


FORM_WINDOWS = """window w5 as (partition by player_id, season order by as_of_date, game_id rows between 4 preceding and current row),
    w10 as (partition by player_id, season order by as_of_date, game_id rows between 9 preceding and current row),
    upto as (partition by player_id, season order by as_of_date, game_id rows between unbounded preceding and current row),
    nxt as (partition by player_id, season order by as_of_date, game_id rows between 1 following and 5 following)"""


def form_sql(least: int | str = 5) -> str:
    limits = {5: 5, 10: 10} if least == "window" else {5: int(least), 10: int(least)}
    deltas = ", ".join(
        f"{s}_last_5 - {s}_season_avg as {s}_last_5_minus_season_avg, {s}_last_10 - {s}_season_avg as "
        f"{s}_last_10_minus_season_avg, {s}_last_5 - {s}_last_10 as {s}_last_5_minus_last_10"
        for s in FORM_STATS
    )
    base = _form(FORM_STATS, STATS, limits, 1 if least == "window" else int(least))
    return f"select *, {deltas} from (select *, {base} from v_logs_short {FORM_WINDOWS}) f"


def split_sql(column: str, split: SplitConfig) -> str:
    def inside(labels):
        return ", ".join(f"'{x}'" for x in labels)

    arms = [f"when {column} in ({inside(getattr(split, x))}) then '{x}'" for x in ("validation", "test", "train") if getattr(split, x)]
    if split.train_end:
        arms.append(f"when try_cast(substring({column}, 1, 4) as int) <= {split.train_end[:4]} then 'train'")
    return f"case {' '.join(arms)} else '{split.default}' end"


_COMPLETE = " and ".join(
    [f"{s}_{x} is not null" for s in FORM_STATS for x in ("last_5", "last_10", "season_avg")]
    + [f"target_next_5_{s}_avg is not null" for s in STATS]
)

# SQL-only views for the comparison side: name -> (sources, SQL)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "form": (("v_logs_short",), form_sql(5)),
    "performance": (("form",), f"""
        select * from (select *, {split_sql('season', SHORT_SPLIT)} as split from form) p
        where {_COMPLETE} and split in ('train', 'validation', 'test')"""),
}


def with_clause(needs: Sequence[str], body: str) -> str:
    """WITH prefix of the needed views, dependencies first, ending in ``result``."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done or name in TABLES:
            return
        sources, _ = BASE.get(name) or DERIVED[name]
        for source in sources:
            visit(source)
        done.append(name)

    for name in needs:
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({(BASE.get(n) or DERIVED[n])[1]})" for n in done]
    return "WITH " + ",\n".join([*parts, f"result AS ({body})"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base view as a DataFrame."""
    sources, text = BASE[name]
    marked = re.sub(r"\bfrom (\w+)", r"from {\1}", text)
    return spark.sql(marked, **{s: table(spark, sf_dir, s) for s in sources})
