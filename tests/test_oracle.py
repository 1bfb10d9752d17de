"""Every registered query with SQL equals that SQL on an independent engine."""

import pytest

from catalog import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"

HOT = [
    "rolling_mean", "form_features", "rest_days", "trailing_slope", "career_cumulative", "carry_fill", "sequence_windows",
    "robust_z", "fill_median", "consistency_stats", "recent_form", "horizon_targets", "horizon_targets_joined",
    "classification_metrics", "correlation_summary", "residual_correction", "enrich_left", "join_by_name_key",
]


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert compare(got, sql.sql(ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", HOT)
def test_equals_sql_when_groups_are_hot(spark, sql, name, tiny_groups):
    assert compare(QUERIES[name](spark, SF).toPandas(), sql.sql(ORACLE[name]).df()) is None


@pytest.mark.parametrize("name", ["fit_ridge", "fit_logistic", "tabular_preprocessor", "permutation_importance"])
def test_model_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_names_agree():
    assert set(ORACLE) <= set(QUERIES)
