"""Similarity retrieval: many queries in one plan, each with its own filtered pool."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.config import ROLE_DIMENSIONS, SIMILARITY_FEATURES
from formline.functions.scalars import number, season_start_year
from formline.operators.imputing import fill_median, standardize
from formline.operators.quantiles import group_quantiles
from formline.operators.topk import first_rows, top_n
from formline.session import cut

_TIES = ("player_id", "team_id")


@dataclass(frozen=True)
class Query:
    """One replacement search; None switches a cap off."""

    player_name: str
    season: str | None = None
    top_n: int = 10
    cheaper_only: bool = False
    younger_only: bool = False
    same_position_group: bool = True
    salary_cap_share_max: float | None = None
    age_max: float | None = None
    minutes_min: float | None = None


_QUERY_SCHEMA = (
    "query_id int, player_name string, season string, top_n int, cheaper_only boolean, younger_only boolean, "
    "same_position_group boolean, salary_cap_share_max double, age_max double, minutes_min double"
)


def similarity_base(role: DataFrame, salary: DataFrame) -> DataFrame:
    """Role rows with the salary of the same player and start year."""
    context = salary.select(
        "player_id", "season_start_year", "salary_usd", "salary_cap_share", F.col("team_id").alias("salary_team_id")
    )
    base = role.withColumn("season_start_year", season_start_year("season", strict=True))
    return base.join(context, ["player_id", "season_start_year"], "left")


def _query_array(queries: Sequence[Query]) -> Column:
    """The caller's query list as a constant array of structs."""
    def entry(i: int, q: Query) -> Column:
        typed = {
            "query_id": F.lit(i), **{k: F.lit(v) for k, v in asdict(q).items()},
        }
        casts = dict(pair.rsplit(" ", 1) for pair in _QUERY_SCHEMA.split(", "))
        return F.struct(*[typed[k].cast(t).alias(k) for k, t in casts.items()])

    return F.array(*[entry(i, q) for i, q in enumerate(queries)])


def resolve_targets(base: DataFrame, queries: Sequence[Query], ties: Sequence[str] = _TIES) -> DataFrame:
    """Target row per query: name contains the text (case-insensitive), newest season, most minutes."""
    named = F.filter(_query_array(queries), lambda q: (
        F.contains(F.lower(F.col("player_name")), F.lower(q["player_name"]))
        & (q["season"].isNull() | (q["season"] == F.col("season")))
    ))
    hits = base.withColumn("__q", F.explode(named))
    order = [F.col("season_start_year").desc_nulls_last(), F.col("minutes").desc_nulls_last(), *[F.col(t).asc() for t in ties]]
    return first_rows(hits.withColumn("query_id", F.col("__q.query_id")), ["query_id"], order, 1)


def resolve_target(base: DataFrame, name: str, season: str | None = None, ties: Sequence[str] = _TIES) -> DataFrame:
    """The single target row of a query; ValueError when nothing matches."""
    target = resolve_targets(base, [Query(name, season)], ties).drop("__q", "query_id")
    if target.isEmpty():
        raise ValueError(f"No player-season row matched player_name={name!r}, season={season!r}")
    return target


def find_replacements_batch(
    base: DataFrame, queries: Sequence[Query], features: Sequence[str] = SIMILARITY_FEATURES,
    ties: Sequence[str] = _TIES, strict: bool = True,
) -> DataFrame:
    """Nearest same-season rows per query by standardised distance over the query's own pool.

    There is one target row per query, so the targets are as small as the caller's list and
    are broadcast; every base row meets only the queries of its season whose filters it
    passes. Pool statistics are aggregates per query and top-n is trimmed before the shuffle.
    """
    used = [f for f in features if f in base.columns]
    found = resolve_targets(base, queries, ties)
    context = ["player_id", "player_name", "season", "position", "salary_cap_share", "age"]
    targets = cut(found.select(
        "query_id", "__q", *[F.col(c).alias(f"t_{c}") for c in context],
        *[F.col(f).cast("double").alias(f"t__{f}") for f in used],
    ))
    if strict:
        missing = set(range(len(queries))) - {r["query_id"] for r in targets.select("query_id").take(len(queries))}
        if missing:
            raise ValueError(f"No player-season row matched: {[queries[i] for i in sorted(missing)]}")
    pool = base.join(F.broadcast(targets), base["season"] == targets["t_season"])
    q, inf = F.col("__q"), F.lit(float("inf"))
    share, age = F.coalesce(number("salary_cap_share"), inf), F.coalesce(number("age"), inf)

    def cap(active: Column, passes: Column) -> Column:
        return ~F.coalesce(active, F.lit(False)) | passes

    pool = pool.filter(
        (F.col("player_id") != F.col("t_player_id"))
        & cap(q["same_position_group"] & F.col("t_position").isNotNull(),
              F.contains(F.coalesce(F.col("position"), F.lit("")), F.substring("t_position", 1, 1)))
        & cap(q["cheaper_only"] & F.col("t_salary_cap_share").isNotNull(), share <= F.col("t_salary_cap_share"))
        & cap(q["younger_only"] & F.col("t_age").isNotNull(), age <= F.col("t_age"))
        & cap(q["salary_cap_share_max"].isNotNull(), share <= q["salary_cap_share_max"])
        & cap(q["age_max"].isNotNull(), age <= q["age_max"])
        & cap(q["minutes_min"].isNotNull(), F.coalesce(number("minutes"), F.lit(0.0)) >= q["minutes_min"])
    )
    raw = {f: F.col(f).cast("double") for f in used}
    cells = pool.select("query_id", *[c.alias(f) for f, c in raw.items()]).unionByName(
        targets.select("query_id", *[F.col(f"t__{f}").alias(f) for f in used])
    )
    medians = group_quantiles(cells, ["query_id"], used, [0.5])
    medians = cut(medians.select("query_id", *[F.coalesce(F.col(f"{f}__q")[0], F.lit(0.0)).alias(f"m__{f}") for f in used]))
    filled = cells.join(F.broadcast(medians), "query_id").select(
        "query_id", *[F.coalesce(f, F.col(f"m__{f}")).alias(f) for f in used]
    )
    std = filled.groupBy("query_id").agg(*[F.stddev_pop(f).alias(f"s__{f}") for f in used])
    fitted = pool.join(F.broadcast(medians), "query_id").join(F.broadcast(std), "query_id")

    def gap(f: str) -> Column:
        m, s = F.col(f"m__{f}"), F.col(f"s__{f}")
        scale = F.when(s > 0, s).otherwise(1.0)
        return (F.coalesce(raw[f], m) - F.coalesce(F.col(f"t__{f}"), m)) / scale

    squares = [gap(f) * gap(f) for f in used]
    distance = F.sqrt(sum(squares[1:], squares[0]) / len(used))
    scored = fitted.withColumn("similarity_distance", distance)
    order = [F.col("similarity_distance").asc(), *[F.col(t).asc() for t in ties]]
    widest = max(query.top_n for query in queries)
    ranked = first_rows(scored, ["query_id"], order, widest)
    if any(query.top_n != widest for query in queries):
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        ranked = ranked.withColumn("__n", place).filter(F.col("__n") <= F.col("__q.top_n")).drop("__n")
    shown = [c for c in (
        "player_id", "player_name", "season", "team_id", "position", "age", "minutes", "usage_pct", "points_per_100",
        "assists_per_100", "rebounds_per_100", "true_shooting_pct", "salary_usd", "salary_cap_share",
    ) if c in base.columns]
    return ranked.select(
        "query_id", F.col("t_player_name").alias("target_player_name"), F.col("t_player_id").alias("target_player_id"),
        F.col("t_season").alias("target_season"), *shown,
        (F.col("salary_cap_share") - F.col("t_salary_cap_share")).alias("salary_cap_share_gap"),
        (F.col("age") - F.col("t_age")).alias("age_gap"), "similarity_distance",
        (1 / (1 + F.col("similarity_distance"))).alias("similarity_score"), F.lit(", ".join(used)).alias("features_used"),
    )


def find_replacements(base: DataFrame, query: Query, features: Sequence[str] = SIMILARITY_FEATURES) -> DataFrame:
    return find_replacements_batch(base, [query], features).drop("query_id")


def cosine_similar(
    df: DataFrame, name: str, season: str | None = None, top_k: int = 10, weights: Mapping[str, float] | None = None,
    features: Sequence[str] = ROLE_DIMENSIONS, ties: Sequence[str] = ("player_id", "season", "team_id"),
) -> DataFrame:
    """Cosine similarity of standardised role dimensions to a named row, over all seasons.

    Weights apply after standardisation, where they change the angle.
    """
    used = [f for f in features if f in df.columns]
    filled = fill_median(df, used)
    z = standardize(filled, used)
    weighted = z.withColumns({f"{f}_z": F.col(f"{f}_z") * float((weights or {}).get(f, 1.0)) for f in used})
    vector = weighted.withColumn("__v", F.array(*[F.col(f"{f}_z") for f in used])).drop(*[f"{f}_z" for f in used])
    match = F.lower("player_name") == name.lower()
    if season is not None:
        match = match & (F.col("season") == season)
    target = vector.filter(match).orderBy(*[F.col(t).desc() for t in ties]).limit(1)
    row = target.select("__v", *ties).first()
    if row is None:
        raise ValueError(f"Target player not found: {name}, season={season}")
    goal = [float(x) for x in row["__v"]]

    def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
        return sum((x * y for x, y in zip(a[1:], b[1:])), a[0] * b[0])

    own = [F.col("__v")[i] for i in range(len(used))]
    constant = [F.lit(g) for g in goal]
    score = F.coalesce(F.try_divide(dot(own, constant), F.sqrt(dot(own, own)) * F.sqrt(dot(constant, constant))), F.lit(0.0))
    itself = reduce(lambda a, b: a & b, (F.col(t).eqNullSafe(F.lit(row[t])) for t in ties))
    others = vector.filter(~itself)
    return top_n(others.withColumn("similarity_score", score).drop("__v"), "similarity_score", top_k, ties)
