"""Joins of facts to dimensions. Nothing is broadcast without a bound on its size:
Spark's own threshold decides for dimensions, and only the dimension rows of hot keys
(one per key, few by construction) are broadcast explicitly."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.scalars import name_key, number
from formline.operators.ordered import PROBE, hot_groups, same_keys, split_hot
from formline.operators.topk import dedup_keep
from formline.session import broadcast_bytes, catalyst_bytes, cut


def lookup(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join a dimension that is unique by ``on``; NULL keys match nothing.

    A dimension Spark would broadcast anyway needs no care. Otherwise rows of hot keys skip
    the shuffle (their dimension rows are few), and rows with a NULL key are dealt out evenly.
    """
    if catalyst_bytes(dim) <= broadcast_bytes(df.sparkSession):
        return df.join(dim, list(on), "left")
    hot = hot_groups(df, on)
    if hot is None:
        return _dealt_nulls(df, dim, on)
    big, small = split_hot(df, on, hot)
    few, _ = split_hot(dim, on, hot)
    return _dealt_nulls(small, dim, on).unionByName(big.join(F.broadcast(few), list(on), "left"))


def _dealt_nulls(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join whose NULL keys, which match nothing, are spread over the partitions."""
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in on))
    spread = [F.col(c) for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = df.withColumn("__dealt", F.when(missing, F.pmod(F.xxhash64(*spread), F.lit(4096)) + 1).otherwise(F.lit(0).cast("long")))
    return dealt.join(dim.withColumn("__dealt", F.lit(0).cast("long")), [*on, "__dealt"], "left").drop("__dealt")


def join_same(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], hot: DataFrame | str | None = PROBE
) -> DataFrame:
    """Left join per-group results back to their rows; a NULL key is a group like any other."""
    names = [(k, f"__join_{i}") for i, k in enumerate(keys)]
    right = stats
    for k, alias in names:
        right = right.withColumnRenamed(k, alias)

    def attach(left: DataFrame, side: DataFrame) -> DataFrame:
        return left.join(side, same_keys(left, side, names), "left").drop(*[a for _, a in names])

    hot = hot_groups(df, keys, hot)
    if hot is None:
        return attach(df, right)
    big, small = split_hot(df, keys, hot)
    few, _ = split_hot(right, [a for _, a in names], hot.select(*[F.col(k).alias(a) for k, a in names]))
    return attach(small, right).unionByName(attach(big, F.broadcast(few)))


def enrich_left(
    df: DataFrame, dim: DataFrame, on: Sequence[str], columns: Sequence[str], order: Sequence[str | Column],
    suffix: str = "",
) -> DataFrame:
    """Left join chosen columns of a dimension, deduplicated by key in the given order."""
    kept = [c for c in columns if c in dim.columns]
    unique = dedup_keep(dim, on, order).select(*on, *[F.col(c).alias(c + suffix) for c in kept])
    return lookup(df, unique, on)


def coalesce_suffix(df: DataFrame, columns: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """First non-NULL of a column and its suffixed twins; the twins are dropped."""
    out, helpers = {}, []
    for c in columns:
        twins = [c + s for s in suffixes if c + s in df.columns]
        if not twins:
            continue
        present = [c] if c in df.columns else []
        out[c] = F.coalesce(*present, *twins)
        helpers += twins
    return (df.withColumns(out) if out else df).drop(*helpers)


def join_by_name_key(
    df: DataFrame, dim: DataFrame, columns: Sequence[str], order: Sequence[str | Column], name: str = "player_name",
    mode: str = "strict", suffix: str = "",
) -> DataFrame:
    """Left join on the normalised name."""
    left = df.withColumn("__name_key", name_key(name, mode))
    right = dim.withColumn("__name_key", name_key(name, mode)).filter(F.col("__name_key").isNotNull())
    return enrich_left(left, right, ["__name_key"], columns, order, suffix).drop("__name_key")


def join_cap(df: DataFrame, cap: DataFrame, season: str = "season_label") -> DataFrame:
    """Season cap and the salary's share of it. The caps, one row a season, are written, so the planner sees their size."""
    caps = cap.withColumn("salary_cap_usd", number("salary_cap_usd")).withColumnRenamed("season", season)
    unique = cut(dedup_keep(caps, [season], ["salary_cap_usd", *sorted(c for c in caps.columns if c not in (season, "salary_cap_usd"))]))
    joined = lookup(df, unique, [season])
    return joined.withColumn("salary_cap_share", F.try_divide(number("salary_usd"), F.col("salary_cap_usd")))


def join_role(
    salary: DataFrame, role: DataFrame, columns: Sequence[str], order: Sequence[str | Column],
    season: str = "season_label",
) -> DataFrame:
    """Role features of the same player-season; columns the salary side has get a ``_role`` twin."""
    kept = [c for c in columns if c in role.columns]
    unique = dedup_keep(role, ["player_id", "season"], order).select(
        "player_id", F.col("season").alias(season),
        *[F.col(c).alias(f"{c}_role" if c in salary.columns else c) for c in kept],
    )
    return lookup(salary, unique, ["player_id", season])


def enrich_with_fallback(
    base: DataFrame, adv: DataFrame, columns: Sequence[str], exact: Sequence[str] = ("player_id", "season", "team_id"),
    loose: Sequence[str] = ("player_id", "season"), weight: str = "minutes",
) -> DataFrame:
    """Fill columns from the exact match, then from the loose match with the largest weight."""
    kept = [c for c in columns if c in adv.columns]
    heaviest = [F.col(weight).desc_nulls_last(), *[F.col(k).asc() for k in exact if k not in loose]]
    ex = dedup_keep(adv, exact, heaviest).select(*exact, *[F.col(c).alias(f"{c}_advanced") for c in kept])
    fb = dedup_keep(adv, loose, heaviest).select(*loose, *[F.col(c).alias(f"{c}_fallback") for c in kept])
    joined = lookup(lookup(base, ex, exact), fb, loose)
    return coalesce_suffix(joined, kept, ["_advanced", "_fallback"])


def join_multi_source(
    adv: DataFrame, usage: DataFrame, defense: DataFrame, keys: Sequence[str], usage_columns: Sequence[str],
    defense_columns: Sequence[str],
) -> DataFrame:
    """Two left joins on the same keys, shared columns coalesced main -> usage -> defense."""
    out = enrich_left(adv, usage, keys, usage_columns, [*keys, *usage_columns], "_usage")
    out = enrich_left(out, defense, keys, defense_columns, [*keys, *defense_columns], "_defense")
    return coalesce_suffix(out, sorted({*usage_columns, *defense_columns}), ["_usage", "_defense"])


def lag_join_inner(
    df: DataFrame, hist: DataFrame, key: str, period: str, n: int = 1, prefix: str = "prev_"
) -> DataFrame:
    """Inner join on the same key n periods earlier; history columns get the prefix."""
    earlier = hist.select(
        key, (F.col(period) + n).alias(period),
        *[F.col(c).alias(prefix + c) for c in hist.columns if c not in (key, period)],
    )
    return df.join(earlier, [key, period], "inner")


def future_lookup_left(
    anchors: DataFrame, summary: DataFrame, key: str, year: str, horizon: int, columns: Sequence[str]
) -> DataFrame:
    """Columns of the row ``horizon`` periods later and a ``present_h`` flag."""
    later = summary.select(
        key, (F.col(year) - horizon).alias(year), F.lit(True).alias(f"present_h{horizon}"),
        *[F.col(c).alias(f"{c}_h{horizon}") for c in columns if c in summary.columns],
    )
    return lookup(anchors, later, [key, year]).withColumn(
        f"present_h{horizon}", F.coalesce(f"present_h{horizon}", F.lit(False))
    )


def merge_signal_tables(frames: Sequence[DataFrame], on: Sequence[str] = ("target", "feature")) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, list(on), "full")
    return out


def attach_test_metrics(
    selected: DataFrame, evaluations: DataFrame, identity: Sequence[str], metrics: Sequence[str], split: str = "split"
) -> DataFrame:
    """Test-split metrics (prefixed ``test_``) next to the selected models."""
    test = evaluations.filter(F.col(split) == "test").select(
        *identity, *[F.col(m).alias(f"test_{m}") for m in metrics]
    )
    return selected.join(test, list(identity), "left")
