"""Preprocessing, linear models from sums and training drivers against plain numpy and literal cases."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from formline.operators import linear
from formline.operators.preprocess import TabularPreprocessor, TabularPreprocessorModel, label_counts
from formline.plans import training

ROWS = [(1.0, None, "a", "x", True), (None, 2.0, "b", None, False), (3.0, 4.0, None, "y", None), (5.0, None, "b", "x", True)]
KINDS = "u double, v double, c string, d string, f boolean"


def vectors(df):
    return [r["x"] for r in df.select(vector_to_array("features").alias("x")).collect()]


def test_preprocessor_by_hand(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    model = TabularPreprocessor(["u", "v", "f"], ["c", "d"]).fit(df)
    assert vectors(model.transform(df)) == [
        [1, 3, 1, 1, 0, 1, 0], [3, 2, 0, 0, 1, 1, 0], [3, 4, 1, 0, 1, 0, 1], [5, 3, 1, 0, 1, 1, 0],
    ]
    assert [r["name"] for r in model.names().orderBy("position").collect()] == ["u", "v", "f", "c=a", "c=b", "d=x", "d=y"]
    unseen = spark.createDataFrame([(None, None, "zz", "q", None)], KINDS)
    assert vectors(model.transform(unseen)) == [[3, 3, 1, 0, 0, 0, 0]]


def test_preprocessor_scales_by_population_deviation(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    plain = np.array(vectors(TabularPreprocessor(["u", "v"], ["c", "d"]).fit(df).transform(df)))
    scaled = np.array(vectors(TabularPreprocessor(["u", "v"], ["c", "d"], "all").fit(df).transform(df)))
    want = plain / plain.std(axis=0)
    want[:, :2] -= plain[:, :2].mean(axis=0) / plain[:, :2].std(axis=0)
    assert np.allclose(scaled, want)


def test_most_frequent_label_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    model = TabularPreprocessor([], ["c"]).fit(df)
    assert model.modes == {"c": "a"} and vectors(model.transform(df)) == [[0, 1], [1, 0], [1, 0]]


def test_preprocessor_of_nothing(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    model = TabularPreprocessor(["u"], ["c"], "numeric").fit(df.limit(0))
    assert model.width == 1 and vectors(model.transform(df.limit(1))) == [[1.0]]
    bare = TabularPreprocessor(["u"], ["c"]).fit(df.withColumns({"u": F.lit(None).cast("double"), "c": F.lit(None).cast("string")}))
    assert vectors(bare.transform(df.limit(1))) == [[1.0]]


def test_label_counts_merge(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    one, two = label_counts(df.limit(2), ["c", "d"]), label_counts(df.limit(2), ["c", "d"])
    merged = one.unionByName(two).groupBy("column", "label").agg(F.sum("n").alias("n"))
    whole = label_counts(df.limit(2).unionByName(df.limit(2)), ["c", "d"])
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_saved_pipelines_score_alike(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KINDS).withColumn("label", F.col("u"))
    fitted = Pipeline(stages=[TabularPreprocessor(["v"], ["c", "d"], "all"), LinearRegression(regParam=0.1)]).fit(df.dropna(subset=["label"]))
    fitted.write().overwrite().save(f"{tmp_path}/p")
    again = PipelineModel.load(f"{tmp_path}/p")
    assert isinstance(again.stages[0], TabularPreprocessorModel)
    same = lambda m: [r["prediction"] for r in m.transform(df).orderBy("v", "c").collect()]
    assert same(again) == same(fitted)


def segment_rows(n=600):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2)) * [1, 50] + [0, 1e6]
    segment = rng.choice(["a", "b", "few"], n, p=[0.55, 0.40, 0.05])
    y = x @ [2.0, 0.02] + np.where(segment == "a", 3, -1) * x[:, 0] + rng.normal(size=n)
    return x, segment, y


def segment_frame(spark):
    x, segment, y = segment_rows()
    rows = [(float(a), float(b), str(s) if i % 50 else None, "train" if i % 4 else "test", float(v)) for i, ((a, b), s, v) in enumerate(zip(x, segment, y))]
    return spark.createDataFrame(rows, "a double, b double, s string, split string, label double").repartition(5)


def ridge(x, y, alpha):
    scale = x.std(axis=0)
    z = (x - x.mean(axis=0)) / scale
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return [y.mean() - x.mean(axis=0) @ b, *b]


@pytest.mark.parametrize("held", [64 << 20, 1])
def test_every_segment_has_its_own_ridge(spark, monkeypatch, held):
    monkeypatch.setattr(linear, "HELD_BYTES", held)
    scored, models = linear.ridge_by_segment(segment_frame(spark), ["a", "b"], "s", alpha=2.0)
    x, segment, y = segment_rows()
    train, named = np.arange(600) % 4 > 0, np.arange(600) % 50 > 0
    got = {r["segment"]: [r["intercept"], *r["coefficients"]] for r in models.collect()}
    for s in ("a", "b", "few"):
        assert np.allclose(got[s], ridge(x[train & named & (segment == s)], y[train & named & (segment == s)], 2.0), rtol=1e-6)
    assert np.allclose(got[None], ridge(x[train], y[train], 2.0), rtol=1e-6)
    for r in scored.collect():
        assert r["used_model"] == (r["s"] if r["s"] in ("a", "b") else "global_fallback")
        b = got[r["used_model"]] if r["used_model"] in got else got[None]
        assert np.isclose(r["prediction"], b[0] + b[1] * r["a"] + b[2] * r["b"])


def test_segments_without_training_rows(spark):
    df = segment_frame(spark).withColumn("split", F.lit("test"))
    scored, models = linear.ridge_by_segment(df, ["a", "b"], "s")
    assert models.collect() == [] and scored.filter("prediction is not null").count() == 0 and scored.count() == 600


def test_quantiles_cover_and_do_not_cross(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 4, 900)
    y = 1 + 2 * x + rng.normal(size=900) * (0.3 + x)
    df = spark.createDataFrame([(float(a), "train" if i % 3 else "test", float(v)) for i, (a, v) in enumerate(zip(x, y))], "a double, split string, label double")
    out, model = linear.quantile_regression(df, ["a"], [0.1, 0.5, 0.9])
    rows = out.collect()
    train = [r for r in rows if r["split"] == "train"]
    for q, c in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")):
        assert abs(np.mean([r["label"] <= r[c] for r in train]) - q) <= 0.01
    assert all(r["p10"] <= r["p50"] <= r["p90"] for r in rows)
    # the losses fall, and end near the least that a search over lines of two training points finds
    for before, now in zip(model.losses, model.losses[1:]):
        assert all(b <= a * 1.001 for a, b in zip(before, now))
    u, v = np.array([[r["a"], r["label"]] for r in train]).T
    i, j = rng.integers(0, len(u), (2, 20000))
    slope = (v[j] - v[i])[u[i] != u[j]] / (u[j] - u[i])[u[i] != u[j]]
    level = v[i][u[i] != u[j]] - slope * u[i][u[i] != u[j]]
    for k, q in enumerate((0.1, 0.5, 0.9)):
        least = min((np.abs(r).mean() / 2 + (q - 0.5) * r.mean()) for r in (v - level[m] - slope[m] * u for m in range(0, len(slope), 4)))
        assert model.losses[-1][k] <= least * 1.01
    assert out.select((F.col("p90") - F.col("p10") > 3).alias("w")).filter("w").count() > 0  # wider where the spread is


def task_rows(spark, n=240):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        a, lag = float(rng.normal()), float(20 + rng.normal())
        active = int(rng.random() < 0.7)
        rows.append((i, ("train", "train", "validation", "test")[i % 4], a, lag, str(i % 3), active, lag + a + float(rng.normal()) if active else None, 20 + 2 * a if active else None, (20 + 2 * a) * lag / 36 if active else None))
    kinds = "player_id long, split string, a double, minutes_per_game_lag_0 double, kind string, active_h1 int, minutes_per_game_h1 double, pts_per_36_h1 double, pts_per_game_h1 double"
    return spark.createDataFrame(rows, kinds).withColumns({
        "minutes_per_game_lag_1": F.lit(None).cast("double"), "minutes_per_game_lag_2": F.lit(None).cast("double"), "age_at_anchor": F.lit(25.0),
    })


def test_drivers_train_select_save_and_compose(spark, tmp_path):
    df = task_rows(spark)
    long = [t for t in training.long_term_tasks((1,), ("linear",), ("pts",)) if t.target in ("active_probability", "pts_per_36")]
    tasks = [*long, *training.minutes_tasks((1,), ("linear", "random_forest")), *training.per_game_tasks((1,), ("linear",), ("pts",))]
    trained = training.train_tasks(df, tasks, folder=str(tmp_path), trees=5, rounds=2)
    rows = trained.evaluations.collect()
    models = lambda family, target: {r["model"] for r in rows if (r["family"], r["target"]) == (family, target)}
    assert models("minutes", "minutes_per_game") == {"linear", "random_forest", *training.MINUTES_RULES}
    assert models("long_term", "active_probability") == {"linear"}
    # the label follows from one feature, so the linear candidate is nearly exact; a, its lag, kind and age don't look ahead
    assert all(r["mae"] < 0.2 and r["feature_count"] == 4 for r in rows if r["target"] == "pts_per_36")
    chosen = trained.selected.filter("target = 'minutes_per_game'").first()
    assert chosen["value"] == min(r["mae"] for r in rows if r["target"] == "minutes_per_game" and r["split"] == "validation")
    # loaded pipelines give the evaluated numbers
    again = training.predict(trained, long[1], "linear", df.filter("split = 'test' and active_h1 = 1"), "p")
    mae = again.agg(F.avg(F.abs(F.col("p") - F.col("pts_per_36_h1"))).alias("m")).first()["m"]
    evaluated = [r["mae"] for r in rows if r["target"] == "pts_per_36" and r["split"] == "test"][0]
    assert again.columns == [*df.columns, "p"] and np.isclose(mae, evaluated)
    composition, decision = training.compose_per_game(trained, tasks, df, ("pts",))
    assert composition.count() == 2 * 5 and decision.count() == 2


def test_tasks_without_rows_or_with_one_class_keep_their_rules(spark, tmp_path):
    df = task_rows(spark).withColumns({"active_h1": F.lit(1), "minutes_per_game_h1": F.when(F.col("split") != "train", F.col("minutes_per_game_h1"))})
    tasks = [training.long_term_tasks((1,), ("linear",))[0], *training.minutes_tasks((1,), ("linear",))]
    found = training.train_tasks(df, tasks, folder=str(tmp_path)).evaluations.collect()
    assert {r["model"] for r in found} == set(training.MINUTES_RULES)


def test_quantile_regressions_learn_from_written_rows(spark, monkeypatch):
    seen, plain = [], linear.described
    monkeypatch.setattr(linear, "described", lambda df, *rest: (seen.append(df), plain(df, *rest))[1])
    df = spark.createDataFrame([(float(i), "train", float(i % 7)) for i in range(60)], "a double, split string, label double")
    out, _ = linear.quantile_regression(df, ["a"])
    assert seen[0].inputFiles() and out.count() == 60


def test_tasks_of_the_same_rows_share_a_preprocessor(spark, tmp_path, monkeypatch):
    """Minutes, direct and per-36 labels are known for the same rows, activity for all."""
    fits, plain = [], TabularPreprocessor.fit
    monkeypatch.setattr(TabularPreprocessor, "fit", lambda self, df: (fits.append(df.count()), plain(self, df))[1])
    tasks = [*training.minutes_tasks((1,), ("linear",)), *training.per_game_tasks((1,), ("linear",), ("pts",)), training.long_term_tasks((1,), ("linear",))[0]]
    df = task_rows(spark)
    found = training.train_tasks(df, tasks, folder=str(tmp_path)).evaluations.collect()
    train = df.filter("split = 'train'")
    assert sorted(fits) == [train.filter("active_h1 = 1").count(), train.count()]
    known = df.filter("split = 'test' and active_h1 = 1").count()
    assert {r["rows"] for r in found if r["split"] == "test" and r["family"] != "long_term"} == {known}
    assert all((tmp_path / t.key / "preprocessor").exists() for t in tasks)
