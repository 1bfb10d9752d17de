"""Model queries: compared by shape and sanity, not by value, since training is not SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.gold import lagged
from catalog.history import performance
from catalog.registry import query
from formline.config import HORIZONS
from formline.operators import imputing, metrics, modelling
from formline.operators.frames import union_all
from formline.session import cut

FORM = ["pts_last_5", "pts_last_10", "pts_season_avg", "min_season_avg", "pts_last_5_minus_season_avg"]
IDS = ["game_id"]
TARGET = "target_next_5_pts_avg"
SALARY_SET = ["previous_salary_cap_share", "age", "prev_minutes", "prev_usage_pct", "previous_contract_band", "is_rising_candidate"]


def _rows(spark, d):
    df = performance(spark, d).select("player_id", *IDS, "season", "team_id", "split", *FORM, TARGET)
    return cut(modelling.prepared(df, FORM, F.col(TARGET)))


def _scored(spark, d, estimator, scale=False):
    df = _rows(spark, d)
    model = modelling.fit(df.filter(F.col("split") == "train"), [*FORM, "team_id"], estimator, scale)
    return metrics.evaluate_by_split(modelling.score(model, df), "label", "prediction", "points")


@query("fit_ridge")
def _(spark, d):
    df = _rows(spark, d)
    train = df.filter(F.col("split") == "train")
    model = modelling.fit(train, [*FORM, "team_id"], modelling.ridge(1.0, train.count()), True)
    return metrics.evaluate_by_split(modelling.score(model, df), "label", "prediction", "points")


@query("fit_elasticnet")
def _(spark, d):
    return _scored(spark, d, modelling.elasticnet(), True)


@query("fit_random_forest")
def _(spark, d):
    return _scored(spark, d, modelling.random_forest(trees=60, depth=12))


@query("fit_gbt")
def _(spark, d):
    return _scored(spark, d, modelling.gbt(loss="absolute", rounds=20))


@query("fit_logistic")
def _(spark, d):
    df = performance(spark, d).withColumn("up", (F.col(TARGET) > F.col("pts_season_avg")).cast("int"))
    df = cut(modelling.balanced_weights(modelling.prepared(df, FORM, F.col("up")), "label"))
    train = df.filter(F.col("split") == "train")
    model = modelling.fit(train, FORM, modelling.logistic(rows=train.count()), True)
    scored = modelling.score(model, df, "probability_up", probability=True)
    return metrics.classification_metrics(scored, "label", "probability_up", by=["split"])


@query("tabular_preprocessor")
def _(spark, d):
    df = _rows(spark, d)
    fitted = imputing.tabular_preprocessor(FORM, ["team_id"], scale=True).fit(df.filter(F.col("split") == "train"))
    from pyspark.ml.functions import vector_to_array

    out = fitted.transform(df).select("split", F.size(vector_to_array("features")).alias("width"))
    return out.groupBy("split", "width").agg(F.count(F.lit(1)).alias("rows"))


def _salary_rows(spark, d):
    from formline.operators.labels import target_mode

    return cut(modelling.prepared(lagged(spark, d), SALARY_SET, target_mode("log_salary_usd")))


@query("fit_by_segment")
def _(spark, d):
    scored = modelling.fit_by_segment(_salary_rows(spark, d), SALARY_SET, "salary_segment", lambda: modelling.gbt(rounds=5))
    return metrics.regression_metrics(scored.filter(F.col("split") != "train"), "label", "prediction", ["split", "used_model"])


@query("quantile_ranges")
def _(spark, d):
    ranged = modelling.quantile_ranges(_salary_rows(spark, d), SALARY_SET)
    return metrics.interval_metrics(ranged.filter(F.col("split") != "train"), "salary_usd", "p10_usd", "p50_usd", "p90_usd")


@query("train_grid")
def _(spark, d):
    df = cut(lagged(spark, d))
    sets = {"contract_age": SALARY_SET[:3], "contract_age_role": SALARY_SET}
    evaluations, _ = modelling.train_grid(df, sets, ["cap_share", "delta_cap_share", "log_salary_usd"])
    return evaluations


@query("train_grid_selection")
def _(spark, d):
    _, selected = modelling.train_grid(cut(lagged(spark, d)), {"contract_age": SALARY_SET[:3]}, ["cap_share", "delta_cap_share", "log_salary_usd"], ["ridge"])
    return selected


@query("univariate_signal_scan")
def _(spark, d):
    df = cut(performance(spark, d).select(*IDS, *FORM, TARGET))
    return modelling.univariate_signal_scan(df, TARGET, FORM, IDS, min_rows=100, rounds=20)


@query("permutation_importance")
def _(spark, d):
    df = _rows(spark, d)
    train, valid = modelling.holdout(df, IDS)
    model = modelling.fit(train, FORM, modelling.random_forest(trees=10, leaf=8, depth=8))
    return modelling.permutation_importance(model, valid, FORM, "label", IDS, repeats=2)


class _Linear:
    """A fixed scorer that SQL can repeat."""

    def transform(self, df):
        return df.withColumn("prediction", 0.7 * F.coalesce("pts_last_5", F.lit(0.0)) + 0.2 * F.coalesce("min_season_avg", F.lit(0.0)))


@query("permutation_importance_linear", """
    with r as (select game_id, pts_last_5, min_season_avg, target_next_5_pts_avg as y, row_number() over (order by game_id) as p0, row_number() over (order by (game_id * 7919) % 10007, game_id) as p1,
                      row_number() over (order by (game_id * 104729) % 9973, game_id) as p2 from performance),
         v as (select r.y, r.pts_last_5 as a, r.min_season_avg as b, s.pts_last_5 as a1, s.min_season_avg as b1, t.pts_last_5 as a2, t.min_season_avg as b2 from r join r s on s.p1 = r.p0 join r t on t.p2 = r.p0),
         l as (select avg(abs(y - 0.7 * a - 0.2 * b)) as base, avg(abs(y - 0.7 * a1 - 0.2 * b)) as x1, avg(abs(y - 0.7 * a2 - 0.2 * b)) as x2, avg(abs(y - 0.7 * a - 0.2 * b1)) as z1, avg(abs(y - 0.7 * a - 0.2 * b2)) as z2 from v)
    select 'pts_last_5' as feature, (x1 + x2) / 2 - base as importance_mean, abs(x1 - x2) / 2 as importance_std from l
    union all select 'min_season_avg', (z1 + z2) / 2 - base, abs(z1 - z2) / 2 from l""", doubles="importance_mean importance_std", needs="performance")
def _(spark, d):
    df = performance(spark, d).select(*IDS, "pts_last_5", "min_season_avg", TARGET)
    orders = [[(F.col("game_id") * a) % b, F.col("game_id")] for a, b in ((7919, 10007), (104729, 9973))]
    return modelling.permutation_importance(_Linear(), df, ["pts_last_5", "min_season_avg"], TARGET, IDS, orders=orders)


@query("long_term_minutes_models", " union all ".join(
    f"select split, {h} as horizon, 'minutes' as task, count(*) as rows, 1 as fits_better_than_nothing from season_train where split in ('validation', 'test') and minutes_per_game_h{h} is not null group by split"
    for h in HORIZONS), needs="season_train")
def _(spark, d):
    """Ridge minutes at every horizon, each learned on the rows whose own horizon is known."""
    from catalog.training import season_train
    from formline.operators.labels import clip_prediction

    rows = cut(season_train(spark, d))
    features = ["minutes_per_game_lag_0", "minutes_per_game_lag_1", "age_at_anchor", "games_played"]
    parts = []
    for h in HORIZONS:
        df = modelling.prepared(rows, features, F.col(f"minutes_per_game_h{h}"))
        train = df.filter(F.col("split") == "train")
        model = modelling.fit(train, features, modelling.ridge(10.0, train.count()), True)
        scored = modelling.score(model, df).withColumn("prediction", clip_prediction("prediction", "minutes"))
        # least squares never does worse than the mean on the rows it learned from
        better = metrics.regression_metrics(scored.filter(F.col("split") == "train"), "label", "prediction").select((F.col("r2") >= -1e-9).cast("int")).scalar()
        found = metrics.evaluate_by_split(scored, "label", "prediction", "minutes")
        parts.append(found.select("split", F.lit(h).alias("horizon"), "task", "rows", better.alias("fits_better_than_nothing")))
    return union_all(parts)
