"""Builders, signals, splits, metrics and quality on small frames, and the documented divergences."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from formline.config import QualityConfig, RangeConfig, SplitConfig
from formline.operators import aggregates, frames, imputing, labels, metrics, quality, similarity, splits, windows
from formline.plans import builders, signals
from formline.sources import tables

SEASONS = [f"{y}-{str(y + 1)[2:]}" for y in range(2016, 2025)]


@pytest.fixture
def players(spark):
    return spark.createDataFrame(
        [(1, "A. One", "1995-01-15", "G", 75, 190), (2, "B. Two", "1998-07-01", "F", 80, 220)],
        "player_id long, player_name string, birth_date string, position string, height int, weight int")


@pytest.fixture
def logs(spark):
    """One player, nine seasons of twelve games."""
    rows = []
    for s, season in enumerate(SEASONS):
        for g in range(12):
            day = dt.datetime(2016 + s, 11, 1) + dt.timedelta(days=2 * g)
            rows.append((1, "A. One", 100 * s + g, day, season, "BOS", 30, 10 + g, 3 + g % 4, 5 + g % 3, 12, 4, 5, 0.55, 2))
    return spark.createDataFrame(rows, (
        "player_id long, player_name string, game_id long, game_date timestamp_ntz, season string, team_id string, minutes int, points int, "
        "assists int, rebounds int, fga int, fta int, fg3a int, true_shooting_pct double, rest_days int"))


@pytest.fixture
def stats(spark):
    rate = dict(usage_pct=22.0, points_per_100=25.0, assists_per_100=6.0, rebounds_per_100=7.0, true_shooting_pct=58.0, three_point_attempt_rate=0.3,
                free_throw_rate=0.25, turnover_rate=0.12, steal_rate=1.2, block_rate=0.8, defensive_rebound_rate=15.0, foul_rate=2.5, pace=99.0,
                possessions=4000.0, offensive_rating=112.0, defensive_rating=108.0)
    rows = [dict(player_id=1, player_name="A. One", season=s, team_id="BOS", age=25.0 + i, minutes=2000.0, **rate) for i, s in enumerate(SEASONS[:7])]
    return spark.createDataFrame(rows)


@pytest.fixture
def cap(spark):
    return spark.createDataFrame([("2022-23", 100_000_000, 120_000_000)], "season string, salary_cap_usd long, tax_level_usd long")


@pytest.fixture
def salaries(spark):
    return spark.createDataFrame(
        [("a one", "brk", 2022, 2023, "2022-23", "$10,000,000")],
        "player_name string, team string, season_start_year int, season_end_year int, season_label string, salary_usd string")


def test_role_features(players, stats):
    role = builders.build_role_features(players, stats)
    row = role.filter("season = '2016-17'").first()
    assert row["usage_pct"] == pytest.approx(0.22) and row["position"] == "G" and row["height"] == 75
    assert row["two_way_impact"] == pytest.approx(4.0) and row["position_was_missing"] is False


def test_performance_training(logs):
    perf = builders.build_performance_training(logs)
    assert {r[0] for r in perf.select("split").distinct().collect()} == {"train", "validation", "test"}
    first = perf.filter("game_id = 4").first()
    assert first["pts_last_5"] == 12.0 and first["target_next_5_pts_avg"] == 17.0


def test_warm_up_modes_differ(logs):
    five = builders.performance_features(logs, 5).filter("game_id = 5").first()
    full = builders.performance_features(logs, "window").filter("game_id = 5").first()
    assert five["pts_last_10"] is not None and full["pts_last_10"] is None
    assert builders.performance_features(logs, "window").filter("game_id = 0").first()["pts_season_avg"] == 10.0


def test_point_in_time(logs):
    """Features at t do not change when later rows are removed."""
    names = ["game_id", "pts_last_5", "pts_last_10", "pts_season_avg", "min_last_5_minus_season_avg"]
    full = builders.performance_features(logs).filter("game_date < '2018-11-10'").select(*names)
    cut = builders.performance_features(logs.filter("game_date < '2018-11-10'")).select(*names)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, cut.collect()))


def test_salary_training(salaries, cap, players, stats):
    role = builders.build_role_features(players, stats)
    row = builders.build_salary_training(salaries, cap, players, role).first()
    assert row["salary_cap_share"] == pytest.approx(0.1) and row["team_id"] == "BKN" and row["player_id"] == 1
    assert row["split"] == "train" and row["age"] == pytest.approx(27.71, abs=0.01)


def test_calendar_and_row_horizons_differ(spark):
    years = spark.createDataFrame([(1, 2000, 70), (1, 2002, 60), (2, 2001, 10), (2, 2003, 0)], "player_id long, season_start_year int, games_played int")
    calendar = {(r["player_id"], r["season_start_year"]): r for r in labels.horizon_targets(years, horizons=(1,)).collect()}
    assert calendar[(1, 2000)]["active_h1"] == 0 and calendar[(1, 2000)]["games_played_h1"] == 0  # observed, absent
    assert calendar[(1, 2002)]["active_h1"] == 0  # season 2003 was observed
    assert calendar[(2, 2003)]["active_h1"] is None  # season 2004 was not
    joined = labels.horizon_targets(years, years, horizons=(1,)).select(*labels.horizon_targets(years, horizons=(1,)).columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, calendar.values()))
    by_row = {(r["player_id"], r["season_start_year"]): r for r in labels.horizon_targets_by_row(years, horizons=(1,)).collect()}
    assert by_row[(1, 2000)]["games_played_h1"] == 60 and by_row[(1, 2002)]["active_h1"] is None
    assert by_row[(2, 2001)]["active_h1"] == 0 and by_row[(2, 2001)]["low_availability_h1"] == 1


def test_sum_of_nothing_is_zero(spark):
    logs = spark.createDataFrame(
        [(1, "x", "2020-21", "T", 1, dt.datetime(2020, 11, 1), 0.0, None, None, None)],
        "player_id long, player_name string, season string, team_id string, game_id long, game_date timestamp_ntz, minutes double, points double, assists double, rebounds double")
    row = aggregates.season_summary(logs).first()
    assert row["points"] == 0.0 and row["pts_per_36"] is None


def test_last_value_skips_null(spark):
    logs = spark.createDataFrame(
        [(1, "x", "2020-21", "A", 1, dt.datetime(2020, 11, 1), 10.0, 1.0, 1.0, 1.0), (1, "x", "2020-21", None, 2, dt.datetime(2020, 11, 2), 10.0, 1.0, 1.0, 1.0)],
        "player_id long, player_name string, season string, team_id string, game_id long, game_date timestamp_ntz, minutes double, points double, assists double, rebounds double")
    assert aggregates.season_summary(logs).first()["team_id"] == "A"


def test_nan_becomes_null(spark, tmp_path):
    spark.createDataFrame([(1.0,), (float("nan"),)], "x double").write.parquet(str(tmp_path / "t.parquet"))
    assert tables.scan_table(spark, str(tmp_path / "t.parquet")).filter("x is null").count() == 1


def test_robust_z_fallbacks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 2.0), ("b", 2.0), ("c", None)], "g string, x double")
    got = {}
    for r in windows.robust_z(df, ["g"], {"x": "z"}).collect():
        got.setdefault(r["g"], []).append(r["z"])
    assert sorted(got["a"])[-1] == pytest.approx(3 / 3 ** 0.5) and got["b"] == [0.0, 0.0] and got["c"] == [0.0]


def test_split_labels(spark):
    df = spark.createDataFrame([("2022-23",), ("2023-24",), ("2024-25",), ("2025-26",), (None,)], "s string")
    assert [r[0] for r in df.select(splits.assign_split("s")).collect()] == ["train", "validation", "test", "ignore", "ignore"]
    noted = SplitConfig(train_end="2022-23", default="future_or_unassigned", null="unknown")
    assert df.select(splits.assign_split("s", noted).alias("x")).collect()[-1]["x"] == "unknown"


def test_split_errors(spark):
    df = spark.createDataFrame([("train", 1.0)], "split string, x double")
    with pytest.raises(KeyError):
        splits.validate_splits(df, "absent")
    with pytest.raises(ValueError):
        splits.validate_splits(df)
    with pytest.raises(KeyError):
        splits.feature_target_frame(df, ["absent"], "x")


def test_metrics(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 0.0, 2.0), (2.0, 2.0, 1.0, 3.0), (3.0, 4.0, 2.0, 4.0)], "y double, e double, lo double, hi double")
    row = metrics.range_metrics(df, "y", "e", "lo", "hi", by=[]).first()
    assert row["coverage_rate"] == 1.0 and row["avg_range_width"] == 2.0 and row["mae"] == pytest.approx(1 / 3)
    split = spark.createDataFrame(
        [("validation", 10.0, 9.0), ("validation", 12.0, 13.0), ("test", 20.0, 18.0), ("test", 22.0, 24.0)], "split string, y double, p double")
    got = {r["split"]: r["mae"] for r in metrics.evaluate_by_split(split, "y", "p", "points").collect()}
    assert got == {"validation": 1.0, "test": 2.0}
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2"] == 0.0
    one_class = spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, p double")
    assert metrics.classification_metrics(one_class, "y", "p").first()["roc_auc"] is None


def test_quality(spark):
    good = spark.createDataFrame([(1, 1, "train", 1.0, 1.0), (1, 2, "validation", 2.0, 2.0), (1, 3, "test", 3.0, 3.0)],
                                 "player_id long, game_id long, split string, feature_a double, target double")
    config = QualityConfig(required=("player_id",), features=("feature_a",), targets=("target",), keys=("player_id", "game_id"))
    assert quality.validate_training(good, config)[0].count() == 0
    quality.assert_valid(good, config)
    bad = spark.createDataFrame([(1, 1, "train", None, 1.0), (1, 1, "odd", float("inf"), None)], good.schema)
    checks = {r["check"] for r in quality.validate_training(bad, config)[0].collect()}
    assert checks == {"split_label", "split_presence", "feature_missing", "target_missing", "numeric_finite", "duplicate_key"}
    with pytest.raises(ValueError):
        quality.assert_valid(bad, config)
    with pytest.raises(ValueError):
        quality.assert_clean(bad, ["player_id", "game_id"])
    quality.assert_clean(good, ["player_id", "game_id"])
    assert quality.null_rate_gate(good, ["absent"]) and not quality.null_rate_gate(good, ["feature_a"])


def test_range_order_and_fallback(logs):
    perf = builders.build_performance_training(logs)
    out = labels.range_signals(perf)
    wrong = out.filter("floor_next_5_pts_avg > expected_next_5_pts_avg or expected_next_5_pts_avg > ceiling_next_5_pts_avg")
    assert out.count() > 0 and wrong.count() == 0
    none = labels.with_volatility(perf, RangeConfig(fallback=None)).select("game_id", "pts_sigma")
    period = labels.with_volatility(perf).select("game_id", "pts_sigma")
    assert none.subtract(period).count() > 0


def test_trend_tolerances_matter(logs):
    from formline.config import TrendConfig

    perf = builders.build_performance_training(logs)
    default = labels.trend_signals(perf)
    loose = labels.trend_signals(perf, TrendConfig(pts=0.1))
    assert default.count() == loose.count() == 9
    assert default.select("season", "pts_trend").subtract(loose.select("season", "pts_trend")).count() > 0


def test_similarity_filters(spark):
    role = spark.createDataFrame(
        [(1, "Target", "2022-23", "A", "G", 27.0, 2000.0, 20.0), (2, "Cheap", "2022-23", "B", "G", 25.0, 1800.0, 19.0),
         (3, "Dear", "2022-23", "C", "G/F", 26.0, 1900.0, 21.0)],
        "player_id long, player_name string, season string, team_id string, position string, age double, minutes double, points_per_100 double")
    pay = spark.createDataFrame(
        [(1, 2022, 20e6, 0.16, "A"), (2, 2022, 8e6, 0.06, "B"), (3, 2022, 40e6, 0.3, "C")],
        "player_id long, season_start_year int, salary_usd double, salary_cap_share double, team_id string")
    base = similarity.similarity_base(role, pay)
    cheap = similarity.find_replacements(base, similarity.Query("target", cheaper_only=True)).collect()
    assert [r["player_name"] for r in cheap] == ["Cheap"] and cheap[0]["features_used"] == "minutes, points_per_100"
    queries = [similarity.Query("target", top_n=1), similarity.Query("dear", "2022-23", same_position_group=False)]
    batch = similarity.find_replacements_batch(base, queries)
    singles = frames.union_all([similarity.find_replacements(base, q).withColumn("query_id", F.lit(i)) for i, q in enumerate(queries)])
    assert sorted(map(str, batch.collect())) == sorted(map(str, singles.select(*batch.columns).collect()))
    with pytest.raises(ValueError):
        similarity.find_replacements(base, similarity.Query("nobody"))


def test_cosine_weights_change_the_ranking(spark):
    df = spark.createDataFrame(
        [(i, f"p{i}", "s", "t", float(i % 3), float(i * i % 7), float(i % 5)) for i in range(12)],
        "player_id long, player_name string, season string, team_id string, a double, b double, c double")
    plain = similarity.cosine_similar(df, "P1", features=["a", "b", "c"], top_k=11)
    heavy = similarity.cosine_similar(df, "P1", features=["a", "b", "c"], top_k=11, weights={"b": 9.0})
    assert plain.count() == 11
    assert [r["player_id"] for r in plain.collect()] != [r["player_id"] for r in heavy.collect()]


def test_rising_threshold_is_a_ratio(spark):
    row = spark.createDataFrame([(0.05, 2000.0, 0.25, 24.0, 3.0)], "previous_salary_cap_share double, prev_minutes double, prev_usage_pct double, age double, prev_scoring_creation double")
    assert labels.salary_tiers(row).first()["salary_segment"] == "rising_candidate"
    assert labels.salary_tiers(row, rising_usage=20).first()["salary_segment"] == "rotation"


def test_imputation_can_fit_on_train_only(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("test", 100.0), ("test", None)], "split string, x double")
    everywhere = imputing.fill_median(df, ["x"]).filter("split = 'test'").agg(F.min("x")).first()[0]
    train = imputing.fill_median(df, ["x"], F.col("split") == "train").filter("split = 'test'").agg(F.min("x")).first()[0]
    assert (everywhere, train) == (3.0, 2.0)


def test_loader_contracts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "c.jsonl").write_text('{"x": 1, "y": 2}\n{"x": 3, "y": 4}\n')
    (tmp_path / "d.json").write_text('[{"x": 1, "y": 2}]')
    counts = [tables.scan_table(spark, str(tmp_path / n)).count() for n in ("a.csv", "b.tsv", "c.jsonl", "d.json")]
    assert counts == [1, 1, 2, 1]
    assert tables.scan_table(spark, str(tmp_path / "b.tsv")).columns == ["x", "y"]
    with pytest.raises(ValueError):
        tables.scan_table(spark, str(tmp_path / "e.xml"))
    with pytest.raises(KeyError):
        tables.require_columns(tables.scan_table(spark, str(tmp_path / "a.csv")), ["z"], "a")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "f.csv").write_text("x,y\n5,6\n")
    assert tables.scan_dir(spark, str(tmp_path), "csv").count() == 2


def test_gold_and_signals_end_to_end(spark, tmp_path, logs, players, stats, cap, salaries):
    layers = tables.Layers(str(tmp_path))
    players.write.parquet(layers.path("raw", "players.parquet"))
    stats.write.parquet(layers.path("raw", "player_season_stats.parquet"))
    logs.write.parquet(layers.path("silver", "player_game_logs.parquet"))
    salaries.write.parquet(layers.path("silver", "player_season_salaries.parquet"))
    cap.write.csv(layers.path("raw", "salary_cap/salary_cap_by_season.csv"), header=True)
    built = builders.build_all_gold(spark, str(tmp_path), {"performance_training_clean": "season"})
    assert set(built) == set(tables.GOLD)
    assert tables.load_gold(spark, layers, "long_term_player_forecast_training").count() > 0
    made = signals.build_all_signals(spark, str(tmp_path))
    assert tables.load_gold(spark, layers, "player_trend_signals").count() == 9 and len(made) == 4
