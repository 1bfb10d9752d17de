"""Literal cases of the scalar functions and their edges."""

import pytest
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.operators import labels


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("name, expected", [("Player Name!", "player_name"), ("trueShooting%", "true_shooting"), ("3PA", "3_pa"), ("__x__", "x")])
def test_snake_case(spark, name, expected):
    # "3PA" keeps its capitals together: a digit followed by a capital starts a new word
    assert S.snake_case(name) == expected
    assert value(spark, S.snake_case_text(F.lit(name))) == expected


def test_name_key(spark):
    assert value(spark, S.name_key(F.lit("LeBron James Jr."))) == "lebronjamesjr"
    assert value(spark, S.name_key(F.lit(" D'Angelo R. "), "light")) == "dangelo r"
    assert value(spark, S.name_key(F.lit(None).cast("string"))) is None
    with pytest.raises(ValueError):
        S.name_key("x", "other")


def test_codes_and_money(spark):
    assert value(spark, S.normalize_code(F.lit("BRK"))) == "BKN"
    assert value(spark, S.normalize_code(F.lit(" lal "))) == "LAL"
    assert value(spark, S.parse_money(F.lit("$12,345,678"))) == 12345678.0
    assert value(spark, S.parse_money(F.lit(""))) is None
    assert value(spark, S.parse_money(F.lit("1.2.3"))) is None
    assert value(spark, S.parse_money(F.lit("-$5"))) == 5.0


@pytest.mark.parametrize("text, expected", [
    ("2023-24", (2023, 2024, "2023-24")), ("1999-00", (1999, 2000, "1999-00")), ("2023-2024", (2023, 2024, "2023-24")),
    ("season 2016/17", (2016, 2017, "2016-17")), ("2024", (None, None, None)), (None, (None, None, None)),
])
def test_season(spark, text, expected):
    got = value(spark, S.normalize_season(F.lit(text).cast("string")))
    assert (got["start"], got["end"], got["label"]) == expected


def test_ratios_and_rates(spark):
    assert value(spark, S.percent_to_ratio(F.lit(55.0))) == pytest.approx(0.55)
    assert value(spark, S.percent_to_ratio(F.lit(0.55))) == 0.55
    assert value(spark, S.percent_to_ratio(F.lit("n/a"))) is None
    assert value(spark, S.percent_to_ratio(F.lit(float("nan")))) is None
    assert value(spark, S.per_unit(F.lit(10), F.lit(20), 36)) == 18.0
    assert value(spark, S.per_unit(F.lit(5), F.lit(0), 36)) is None
    assert value(spark, S.safe_divide(F.lit(10), F.lit(2))) == 5.0
    assert value(spark, S.true_shooting(F.lit(0), F.lit(0), F.lit(0))) is None


def test_minutes_dates_positions(spark):
    assert value(spark, S.parse_minutes(F.lit("34:30"))) == 34.5
    assert value(spark, S.parse_minutes(F.lit("12"))) == 12.0
    assert value(spark, S.season_label_from_end_year(F.lit(2000))) == "1999-00"
    assert value(spark, S.season_end_year_from_date(F.lit("2016-10-25").cast("date"))) == 2017
    assert value(spark, S.season_end_year_from_date(F.lit("2017-06-01").cast("date"))) == 2017
    assert value(spark, S.standardize_position(F.lit("g-f"))) == "G/F"
    assert value(spark, S.standardize_position(F.lit("  "))) == "UNK"
    assert value(spark, S.standardize_position(F.lit(None).cast("string"))) == "UNK"


def test_clamp_keeps_null(spark):
    assert value(spark, S.clamp(F.lit(None).cast("double"), 0, 1)) is None
    assert value(spark, S.clamp(F.lit(7.0), 0, 1)) == 1.0


def test_labels(spark):
    assert value(spark, labels.classify_direction(F.lit(3.1), 3.0)) == "improving"
    assert value(spark, labels.classify_direction(F.lit(-3.1), 3.0)) == "declining"
    assert value(spark, labels.classify_direction(F.lit(None).cast("double"), 3.0)) == "stable"
    assert [value(spark, labels.contract_band(F.lit(x))) for x in (0.029, 0.03, 0.08, 0.18)] == [
        "minimum_or_low", "rotation_contract", "starter_contract", "premium_contract"]
    assert [value(spark, labels.career_phase(F.lit(x))) for x in (24, 25, 29, 33, 34)] == ["early", "prime", "prime", "late_prime", "aging"]
    assert value(spark, labels.market_tier(F.lit(None).cast("double"))) == "unknown"
