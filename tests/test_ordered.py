"""Hot groups: chunked windows and bracketed quantiles equal plain ones on brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formline.operators.ordered import Frames, hot_groups, over_history, positions
from formline.operators.quantiles import group_quantiles
from formline.operators.topk import top_n_per_group
from formline.operators.windows import last_mean, next_mean, shifted


@pytest.fixture
def skewed(spark):
    """One key holds nine tenths of 3,000 rows; NULL is a key too; values hold NULLs and ties."""
    base = spark.range(3000).repartition(7)
    key = F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 20 == 9, "cold")
    value = F.when(F.col("id") % 13 != 0, (F.col("id") * 7919 % 101).cast("double"))
    return base.select("id", key.alias("k"), value.alias("v"))


def frames():
    return Frames(
        bounded={"mean3": last_mean("v", 3, 2), "next2": next_mean("v", 2), "before": shifted("id", 1)}, back=2, ahead=2,
        running={"total": ("sum", F.col("v")), "n": ("count", F.lit(1)), "top": ("max", F.col("v"))},
        suffix={"rest": ("count", F.col("v"))}, whole={"avg": F.avg("v")},
    )


def rows(df):
    def tidy(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(tidy(x) for x in r) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_chunked_windows_equal_plain_windows(spark, skewed, tiny_groups):
    chunked = rows(over_history(skewed, ["k"], ["id"], frames()))
    assert hot_groups(skewed, ["k"]) is not None
    assert chunked == rows(over_history(skewed, ["k"], ["id"], frames(), hot=None))


def test_no_task_sees_a_whole_hot_group(spark, skewed, tiny_groups):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = over_history(skewed, ["k"], ["id"], Frames(bounded={"mean3": last_mean("v", 3, 2)}, back=2)).filter("k = 'hot'")
    sizes = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes < 1000


def test_descending_positions(spark, skewed, tiny_groups):
    out = positions(skewed, ["k"], [F.col("id").desc()], "at").filter("k = 'hot'").toPandas()
    ranks = out.sort_values("id", ascending=False)["at"].tolist()
    assert ranks == list(range(1, len(out) + 1))


def test_global_positions(spark, skewed, tiny_groups):
    out = positions(skewed, [], ["id"], "at").toPandas().sort_values("id")
    assert out["at"].tolist() == list(range(1, 3001))


@pytest.mark.parametrize("fractions", [[0.5], [0.0, 0.2, 0.8, 1.0]])
def test_quantiles_of_hot_groups(spark, skewed, tiny_groups, fractions):
    got = {r["k"]: r["v__q"] for r in group_quantiles(skewed, ["k"], ["v"], fractions).collect()}
    pdf = skewed.toPandas()
    for key in ("hot", "cold", None):
        part = pdf[pdf["k"].isna()] if key is None else pdf[pdf["k"] == key]
        assert np.allclose(got[key], np.nanquantile(part["v"].astype(float), fractions))


def test_quantiles_of_continuous_hot_group(spark, tiny_groups):
    df = spark.range(20000).select(F.lit(1).alias("k"), F.sin(F.col("id") * 1.7).alias("v"))
    got = group_quantiles(df, ["k"], ["v"], [0.1, 0.5, 0.9]).first()["v__q"]
    assert np.allclose(got, np.quantile(df.toPandas()["v"], [0.1, 0.5, 0.9]), atol=1e-12)


def test_quantiles_of_a_column_without_values(spark):
    df = spark.range(5).select(F.lit("a").alias("k"), F.lit(None).cast("double").alias("v"))
    assert group_quantiles(df, ["k"], ["v"], [0.5]).first()["v__q"] is None


def test_long_top_n_uses_positions(spark, skewed, tiny_groups):
    out = top_n_per_group(skewed, ["k"], "v", 1500, ["id"])
    expect = skewed.toPandas().query("k == 'hot'").sort_values(["v", "id"], ascending=[False, True], na_position="last")["id"][:1500]
    assert sorted(out.filter("k = 'hot'").toPandas()["id"]) == sorted(expect)


def test_result_is_independent_of_partitioning(spark, skewed):
    one = rows(over_history(skewed.coalesce(1), ["k"], ["id"], frames()))
    assert one == rows(over_history(skewed.repartition(11), ["k"], ["id"], frames()))
