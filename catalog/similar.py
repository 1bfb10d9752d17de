"""Similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.gold import gold_role, gold_salary
from catalog.registry import query
from catalog.views import DERIVED, table, view
from formline.config import ROLE_DIMENSIONS, SIMILARITY_FEATURES
from formline.operators import metrics, similarity
from formline.operators.similarity import Query

DERIVED["sim_base"] = (("role", "salary"), """
    select r.* exclude (rn0), s.salary_usd, s.salary_cap_share, s.team_id as salary_team_id
    from (select *, cast(substring(season, 1, 4) as int) as season_start_year, 0 as rn0 from role) r
    left join salary s on s.player_id = r.player_id and s.season_start_year = r.season_start_year""")

QUERIES = [
    Query("supplier#2"), Query("Supplier#3", "1998-99", top_n=5, cheaper_only=True, younger_only=True),
    Query("SUPPLIER#7", "1999-00", top_n=7, same_position_group=False, age_max=35.0, minutes_min=500.0, salary_cap_share_max=0.0102),
]


def base(spark, d):
    return similarity.similarity_base(gold_role(spark, d), gold_salary(spark, d))


def _num(x) -> str:
    return "null" if x is None else str(x)


def replacement_sql(i: int, q: Query, features=SIMILARITY_FEATURES) -> str:
    named = f"contains(lower(player_name), '{q.player_name.lower()}')" + (f" and season = '{q.season}'" if q.season else "")
    keep = ["b.player_id <> t.player_id"]
    if q.same_position_group:
        keep.append("(t.position is null or contains(coalesce(b.position, ''), left(t.position, 1)))")
    if q.cheaper_only:
        keep.append("(t.salary_cap_share is null or b.salary_cap_share <= t.salary_cap_share)")
    if q.younger_only:
        keep.append("(t.age is null or b.age <= t.age)")
    if q.salary_cap_share_max is not None:
        keep.append(f"b.salary_cap_share <= {q.salary_cap_share_max}")
    if q.age_max is not None:
        keep.append(f"b.age <= {q.age_max}")
    if q.minutes_min is not None:
        keep.append(f"coalesce(b.minutes, 0) >= {q.minutes_min}")
    md = ", ".join(f"coalesce(median({f}), 0) as m_{f}" for f in features)
    fill = ", ".join(f"coalesce({f}, m_{f}) as {f}" for f in features)
    sd = ", ".join(f"case when stddev_pop({f}) > 0 then stddev_pop({f}) else 1 end as s_{f}" for f in features)
    dist = " + ".join(f"power((coalesce(p.{f}, m_{f}) - coalesce(t.{f}, m_{f})) / s_{f}, 2)" for f in features)
    return f"""(
        with t as (select * from sim_base where {named} order by season_start_year desc, minutes desc, player_id, team_id limit 1),
             p as (select b.* from sim_base b, t where b.season = t.season and {' and '.join(keep)}),
             u as (select {', '.join(features)} from p union all select {', '.join(features)} from t), m as (select {md} from u),
             s as (select {sd} from (select {fill} from u, m) f)
        select {i} as query_id, t.player_name as target_player_name, t.player_id as target_player_id, t.season as target_season, p.player_id, p.team_id, p.position, p.age, p.salary_cap_share,
               p.salary_cap_share - t.salary_cap_share as salary_cap_share_gap, p.age - t.age as age_gap, sqrt(({dist}) / {len(features)}) as similarity_distance,
               1 / (1 + sqrt(({dist}) / {len(features)})) as similarity_score, '{', '.join(features)}' as features_used
        from p, t, m, s order by similarity_distance, p.player_id, p.team_id limit {q.top_n})"""


_OUT = ["query_id", "target_player_name", "target_player_id", "target_season", "player_id", "team_id", "position", "age", "salary_cap_share",
        "salary_cap_share_gap", "age_gap", "similarity_distance", "similarity_score", "features_used"]
_D = ["age", "salary_cap_share", "salary_cap_share_gap", "age_gap", "similarity_distance", "similarity_score"]


@query("similarity_base", "select player_id, season, team_id, season_start_year, salary_usd, salary_cap_share, salary_team_id from sim_base",
       doubles="salary_usd salary_cap_share", digits=4, needs="sim_base")
def _(spark, d):
    return base(spark, d).select("player_id", "season", "team_id", "season_start_year", "salary_usd", "salary_cap_share", "salary_team_id")


@query("resolve_target", """
    select player_id, season, team_id, minutes from sim_base where contains(lower(player_name), 'supplier#3') order by season_start_year desc, minutes desc, player_id, team_id limit 1""",
       doubles="minutes", needs="sim_base")
def _(spark, d):
    return similarity.resolve_target(base(spark, d), "SUPPLIER#3").select("player_id", "season", "team_id", "minutes")


@query("find_replacements", f"select * exclude (query_id) from {replacement_sql(0, QUERIES[0])}", doubles=_D, needs="sim_base")
def _(spark, d):
    return similarity.find_replacements(base(spark, d), QUERIES[0]).select(*_OUT[1:])


@query("find_replacements_batch", "select * from " + " union all select * from ".join(replacement_sql(i, q) for i, q in enumerate(QUERIES)), doubles=_D, needs="sim_base")
def _(spark, d):
    return similarity.find_replacements_batch(base(spark, d), QUERIES).select(*_OUT)


@query("similarity_diagnostics", f"""
    select count(*)::double as rows, avg(similarity_score) as avg_similarity_score, avg(similarity_distance) as avg_similarity_distance,
           avg(salary_cap_share_gap) as avg_salary_cap_share_gap, avg(age_gap) as avg_age_gap from {replacement_sql(0, QUERIES[0])}""",
       doubles="rows avg_similarity_score avg_similarity_distance avg_salary_cap_share_gap avg_age_gap", needs="sim_base")
def _(spark, d):
    return metrics.similarity_diagnostics(similarity.find_replacements(base(spark, d), QUERIES[0]))


WEIGHTS = {"scoring_creation": 1.0, "playmaking": 1.2, "shooting": 0.8, "rim_pressure": 1.0, "rebounding": 0.7, "perimeter_defense": 0.8, "interior_defense": 0.4, "two_way_impact": 0.8}


def _cosine_sql() -> str:
    z = ", ".join(f"{WEIGHTS[f]} * ({f} - avg({f}) over ()) / stddev_pop({f}) over () as z_{f}" for f in ROLE_DIMENSIONS)
    dot = lambda a, b: " + ".join(f"{a}.z_{f} * {b}.z_{f}" for f in ROLE_DIMENSIONS)
    return f"""
        with z as (select player_id, player_name, season, team_id, {z} from role),
             t as (select * from z where lower(player_name) = 'supplier#5' order by player_id desc, season desc, team_id desc limit 1)
        select z.player_id, z.season, z.team_id, ({dot('z', 't')}) / (sqrt({dot('z', 'z')}) * sqrt({dot('t', 't')})) as similarity_score from z, t
        where (z.player_id, z.season, z.team_id) <> (t.player_id, t.season, t.team_id) order by similarity_score desc, 1, 2, 3 limit 10"""


@query("cosine_similar", _cosine_sql(), doubles="similarity_score", needs="role")
def _(spark, d):
    return similarity.cosine_similar(gold_role(spark, d), "Supplier#5", weights=WEIGHTS).select("player_id", "season", "team_id", "similarity_score")


@query("cosine_similar_vectors", """
    with c as (select label, vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings),
         z as (select vec_id, i, (v - avg(v) over (partition by i)) / stddev_pop(v) over (partition by i) as z from c),
         t as (select i, z from z where vec_id = 3), s as (select z.vec_id, sum(z.z * t.z) / (sqrt(sum(z.z * z.z)) * sqrt(sum(t.z * t.z))) as similarity_score from z join t on t.i = z.i group by z.vec_id)
    select vec_id, similarity_score from s where vec_id <> 3 order by similarity_score desc, vec_id limit 15""", doubles="similarity_score", digits=4)
def _(spark, d):
    e = table(spark, d, "embeddings")
    cells = {f"e{i}": F.col("embedding")[i].cast("double") for i in range(64)}
    wide = e.select("vec_id", F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("player_name"), *[c.alias(n) for n, c in cells.items()])
    return similarity.cosine_similar(wide, "VEC 3", top_k=15, features=list(cells), ties=["vec_id"]).select("vec_id", "similarity_score")
