"""Redundant pairs and permutation importance against pandas and numpy, and the work they do."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from formline.operators import analysis, imputing, modelling


def table(n=400):
    rng = np.random.default_rng(0)
    base = rng.normal(size=n)
    df = pd.DataFrame({f"f{i}": np.round(base * (i % 3) + rng.normal(size=n) * 0.4, 1) for i in range(7)})
    df.loc[::7, ["f1", "f4"]] = np.nan
    df.loc[::5, "f2"] = np.nan
    return df.assign(constant=1.0, nothing=np.nan)


def frame(spark, df):
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in df.columns)).repartition(3)


@pytest.mark.parametrize("threshold", [0.5, 0.0])
def test_redundant_pairs_are_pairwise_spearman(spark, threshold):
    df = table()
    got = {(r["feature_a"], r["feature_b"]): r["abs_spearman_corr"] for r in analysis.redundant_pairs(frame(spark, df), list(df.columns), threshold).collect()}
    corr = df.corr(method="spearman").abs()
    want = {(a, b): corr.loc[a, b] for i, a in enumerate(df.columns) for b in df.columns[i + 1 :] if corr.loc[a, b] >= threshold}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k]) for k in want)


def test_redundant_pairs_of_an_empty_table(spark):
    df = table()
    assert analysis.redundant_pairs(frame(spark, df).limit(0), list(df.columns)).collect() == []


class Line:
    """Counts its passes; predicts 2 a + b."""

    passes = 0

    def transform(self, df):
        self.passes += 1
        return df.withColumn("prediction", 2 * F.col("a") + F.col("b"))


def test_permutation_importance_borrows_whole_columns_in_one_pass(spark):
    rng = np.random.default_rng(2)
    a, b, e = rng.normal(size=(3, 90))
    y = 2 * a + b + 0.1 * e
    df = spark.createDataFrame([(i, float(a[i]), float(b[i]), float(e[i]), float(y[i])) for i in range(90)], "id long, a double, b double, unused double, y double").repartition(4)
    orders = [[(F.col("id") * 7) % 97, F.col("id")], [(F.col("id") * 31) % 89, F.col("id")]]
    model = Line()
    got = {r["feature"]: (r["importance_mean"], r["importance_std"]) for r in modelling.permutation_importance(model, df, ["a", "b", "unused"], "y", ["id"], orders=orders).collect()}
    assert model.passes == 1
    places = [sorted(range(90), key=lambda i: ((i * m) % k, i)) for m, k in ((7, 97), (31, 89))]
    base = np.abs(y - 2 * a - b).mean()
    for name, change in (("a", lambda p: np.abs(y - 2 * a[p] - b)), ("b", lambda p: np.abs(y - 2 * a - b[p])), ("unused", lambda p: np.abs(y - 2 * a - b))):
        losses = [change(p).mean() - base for p in places]
        assert np.allclose(got[name], (np.mean(losses), np.std(losses)), atol=1e-12)


def test_hashed_permutations_do_not_depend_on_partitions(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("a"), F.lit(1.0).alias("b"), F.col("id").cast("double").alias("y"))
    one, other = (sorted(map(tuple, modelling.permutation_importance(Line(), d, ["a", "b"], "y", ["id"], repeats=3).collect())) for d in (df.repartition(1), df.repartition(5)))
    assert np.allclose([r[1:] for r in one], [r[1:] for r in other]) and one[1][0] == "b" and abs(one[1][1]) < 1e-12


def test_medians_are_taken_only_of_columns_with_gaps(spark, monkeypatch):
    asked = []
    real = imputing.global_quantiles
    monkeypatch.setattr(imputing, "global_quantiles", lambda df, columns, q: asked.append(list(columns)) or real(df, columns, q))
    df = spark.createDataFrame([(1.0, None, None), (3.0, 2.0, None)], "whole double, gap double, nothing double")
    assert [tuple(r) for r in imputing.fill_median(df, ["whole", "gap", "nothing"]).collect()] == [(1.0, 2.0, 0.0), (3.0, 2.0, 0.0)]
    assert asked == [["gap", "nothing"]] and [tuple(r) for r in imputing.fill_median(df, ["whole"]).collect()][0] == (1.0, None, None)
