"""Registered model queries that do the operators' whole job: nothing of what is learned is cut."""

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES, models
from catalog import training as queries
from formline.operators import modelling
from formline.plans import training


class Seen(Exception):
    pass


def asked(monkeypatch, module, name, query):
    """(positional, named) arguments that the query calls the operator with."""

    def stop(*given, **named):
        raise Seen(given, named)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Seen) as seen:
        QUERIES[query](None, "")
    return seen.value.args


def test_quantile_ranges_boost_all_rounds(monkeypatch):
    monkeypatch.setattr(models, "_salary_rows", lambda spark, d: None)
    _, named = asked(monkeypatch, modelling, "quantile_ranges", "quantile_ranges")
    build = named.get("build", modelling.gbt)
    assert build().getOrDefault("rounds") == modelling.gbt().getOrDefault("rounds") == 250


def test_minutes_are_trained_with_the_drivers_defaults(monkeypatch):
    monkeypatch.setattr(queries, "season_train", lambda spark, d: None)
    given, named = asked(monkeypatch, training, "train_tasks", "train_minutes")
    assert not named and len(given) == 2 and {m for t in given[1] for m in t.models} == set(training.LEARNED)


def test_the_grid_query_trains_every_estimator(monkeypatch):
    monkeypatch.setattr(models, "lagged", lambda spark, d: None)
    monkeypatch.setattr(models, "cut", lambda df: df)
    given, named = asked(monkeypatch, modelling, "train_grid", "train_grid")
    assert len(given) == 3 and named.get("models") is None


def test_a_grid_of_all_estimators(spark):
    rows = [(i, ("train", "train", "validation", "test")[i % 4], float(i % 13), "ab"[i % 2], 0.01 * (i % 13) + 0.001 * (i % 3), 1e8, "lo" if i % 13 < 6 else "hi") for i in range(160)]
    df = spark.createDataFrame(rows, "id long, split string, a double, kind string, salary_cap_share double, salary_cap_usd double, salary_segment string")
    df = df.withColumn("salary_usd", F.col("salary_cap_share") * F.col("salary_cap_usd"))
    evaluations, selected = modelling.train_grid(df, {"one": ["a", "kind"]}, ["cap_share"])
    found = {(r["model"], r["split"]): r for r in evaluations.collect()}
    names = set(modelling.estimators(1))
    assert names == {"ridge", "elasticnet", "random_forest", "gbt_absolute", "gbt_squared"}
    assert set(found) == {(m + end, s) for m in names for end in ("", "_segment_corrected") for s in ("validation", "test")}
    assert all(r["rows"] == 40 for r in found.values()) and found["gbt_squared", "test"]["cap_share_mae"] < 0.01
    assert selected.first()["cap_share_mae"] == min(r["cap_share_mae"] for (_, s), r in found.items() if s == "validation")
