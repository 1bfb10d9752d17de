"""Inputs that a builder reads several times are written once: what comes after reads the written tables."""

import pytest
from pyspark.sql import functions as F

from catalog.gold import gold_role, sparse_summary
from catalog.views import LONG_SPLIT, view
from formline.operators import labels
from formline.plans import builders

SF = "/root/testdata/sf0.001"


def read_by(df, table):
    return [f for f in df.inputFiles() if f.endswith(f"/{table}.parquet")]


def test_role_reads_written_stats(spark):
    out = builders.build_role_features(view(spark, SF, "v_players"), view(spark, SF, "v_season_stats"))
    assert not read_by(out, "lineitem")


def test_salary_reads_written_salaries_and_caps(spark):
    out = builders.build_salary_training(
        view(spark, SF, "v_salaries"), view(spark, SF, "v_cap"), view(spark, SF, "v_players"), gold_role(spark, SF), LONG_SPLIT)
    assert not read_by(out, "lineitem")


@pytest.mark.parametrize("itself", [True, False])
def test_joined_horizons_read_written_summary(spark, itself):
    s = sparse_summary(spark, SF)
    out = labels.horizon_targets(s, s if itself else sparse_summary(spark, SF))
    assert not read_by(out, "orders")
    assert out.count() == s.count() and out.filter(F.col("active_h1") == 1).count() > 0


def test_long_term_reads_written_logs(spark):
    logs, players, stats = (view(spark, SF, v) for v in ("v_logs_long", "v_players", "v_season_stats"))
    assert not read_by(builders.build_long_term_training(logs, players, stats, LONG_SPLIT), "lineitem")


def test_anchors_without_pace_read_written_totals(spark):
    assert not read_by(builders.season_anchors(view(spark, SF, "v_logs_long"), view(spark, SF, "v_players"), None), "lineitem")
