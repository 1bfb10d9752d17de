"""Physical plans: shuffles, pushdown and trimming stay as designed."""

from pyspark.sql import functions as F

from catalog.views import SHORT_SPLIT, table, view
from formline.operators import frames, topk
from formline.plans.builders import performance_features

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_form_features_need_one_shuffle(spark):
    text = plan(performance_features(view(spark, SF, "v_logs_short")))
    assert text.count("Exchange hashpartitioning") == 1
    assert text.count("Sort [") == 1


def test_top_k_is_trimmed_before_the_shuffle(spark):
    text = plan(topk.latest_per_key(view(spark, SF, "v_logs_short"), ["player_id"], ["as_of_date", "game_id"]))
    assert text.count("WindowGroupLimit") == 2


def test_top_n_takes_ordered(spark):
    assert "TakeOrderedAndProject" in plan(topk.top_n(table(spark, SF, "orders"), "o_totalprice", 5, ["o_orderkey"]))


def test_filters_and_columns_reach_the_scan(spark):
    low, high = F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz")
    df = frames.filter_period_between(table(spark, SF, "orders"), "o_orderdate", low, high).select("o_orderkey")
    text = plan(df)
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_totalprice" not in text


def test_no_python_in_signal_plans(spark):
    from catalog import QUERIES

    for name in ("trend_signals", "consistency_signals", "range_signals"):
        text = plan(QUERIES[name](spark, SF))
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
