"""Models trained with spark.ml on split-labelled tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions.scalars import clamp
from formline.operators.boost import TableBoost
from formline.operators.forest import TableForest
from formline.operators.frames import numeric_columns, union_all
from formline.operators.imputing import tabular_preprocessor
from formline.operators.joins import join_same
from formline.operators.labels import prediction_to_share, residual_correction, target_mode
from formline.operators.metrics import classification_metrics, model_selection, regression_metrics, salary_metrics
from formline.operators.ordered import positions
from formline.operators.quantiles import group_quantiles
from formline.session import cut

SEED = 42


# --- estimators ---------------------------------------------------------------------------
def ridge(alpha: float, rows: int, label: str = "label") -> LinearRegression:
    """Ridge with a penalty on the summed squared error, expressed per row."""
    return LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=alpha / max(rows, 1))


def elasticnet(label: str = "label", alpha: float = 0.001, l1: float = 0.2) -> LinearRegression:
    return LinearRegression(labelCol=label, elasticNetParam=l1, regParam=alpha)


def random_forest(label: str = "label", trees: int = 250, leaf: int = 10, depth: int = 30, classify: bool = False) -> Estimator:
    """Depth 30 is the deepest that spark.ml grows; ``leaf`` ends growth earlier. The grid has ``TableForest``, whose nodes stay off the driver."""
    kind = RandomForestClassifier if classify else RandomForestRegressor
    return kind(labelCol=label, numTrees=trees, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", maxDepth=depth, seed=SEED)


def gbt(
    label: str = "label", loss: str = "squared", rounds: int = 250, step: float = 0.05, leaf: int = 20, depth: int = 5, classify: bool = False,
    held: str | None = None, tolerance: float = 1e-3,
) -> Estimator:
    """``held``, a boolean column, keeps rows out of the trees and ends boosting once their loss stops falling."""
    return TableBoost(rounds, step, leaf, depth, "logistic" if classify else loss, tolerance, labelCol=label, heldCol=held or "")


def logistic(label: str = "label", strength: float = 0.5, rows: int = 1) -> LogisticRegression:
    return LogisticRegression(labelCol=label, weightCol="__weight", regParam=1.0 / (strength * max(rows, 1)))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Class weights rows / (classes x class rows), from one aggregate."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg((F.sum("n") / F.count(F.lit(1))).alias("t")).scalar()
    return join_same(df, counts.withColumn("__weight", total / F.col("n")).drop("n"), [label])


# --- fitting ------------------------------------------------------------------------------
def prepared(df: DataFrame, features: Sequence[str], target: Column, split: str = "split") -> DataFrame:
    """Labelled rows with booleans as numbers, written once before many fits."""
    kinds = dict(df.dtypes)
    flags = {f: F.col(f).cast("int") for f in features if kinds[f] == "boolean"}
    out = (df.withColumns(flags) if flags else df).withColumn("label", target.cast("double"))
    return out.filter(F.col("label").isNotNull() & F.col(split).isNotNull())


def fit(df: DataFrame, features: Sequence[str], estimator: Estimator, scale: bool = False):
    """Preprocess and fit on the given (training) rows."""
    numeric = numeric_columns(df, features)
    categorical = [f for f in features if f not in numeric]
    stages = tabular_preprocessor(numeric, categorical, scale).getStages()
    return Pipeline(stages=[*stages, estimator]).fit(df)


def score(model, df: DataFrame, name: str = "prediction", probability: bool = False) -> DataFrame:
    keep = df.columns
    out = model.transform(df)
    value = vector_to_array("probability")[1] if probability else F.col("prediction")
    return out.select(*keep, value.alias(name)) if name not in keep else out.withColumn(name, value).select(*keep)


def estimators(rows: int) -> dict[str, tuple[Estimator, bool]]:
    """Regressors of a grid and whether they want scaled inputs."""
    return {
        "ridge": (ridge(5.0, rows), True), "elasticnet": (elasticnet(), True),
        "random_forest": (TableForest(), False), "gbt_absolute": (gbt(loss="absolute"), False), "gbt_squared": (gbt(), False),
    }


def fit_by_segment(
    df: DataFrame, features: Sequence[str], segment: str, build, min_rows: int = 80, split: str = "split", most: int = 50,
) -> DataFrame:
    """One model per segment with enough training rows, a global model for the rest.

    Segments are a handful of labels, ``most`` of them at most (more are an error); each slice
    is scored by its model and the slices unioned.
    """
    train = df.filter(F.col(split) == "train")
    counts = train.dropna(subset=[segment]).groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
    large = sorted(r[segment] for r in counts.filter(F.col("n") >= min_rows).limit(most + 1).collect())
    if len(large) > most:
        raise ValueError(f"{segment} has more than {most} segments")
    overall = fit(train, features, build())
    parts = []
    for s in large:
        model = fit(train.filter(F.col(segment) == s), features, build())
        parts.append(score(model, df.filter(F.col(segment) == s)).withColumn("used_model", F.lit(str(s))))
    rest = df.filter(~F.coalesce(F.col(segment).isin(*large), F.lit(False))) if large else df
    parts.append(score(overall, rest).withColumn("used_model", F.lit("global_fallback")))
    return union_all(parts)


def quantile_ranges(
    df: DataFrame, features: Sequence[str], alphas: Sequence[float] = (0.10, 0.50, 0.90), segment: str = "salary_segment",
    split: str = "split", build=gbt,
) -> DataFrame:
    """p10/p50/p90 salary in USD: a point model on log1p(usd) plus training-residual quantiles per segment."""
    train = df.filter(F.col(split) == "train")
    scored = score(fit(train, features, build()), df, "log_prediction")
    residual = scored.filter(F.col(split) == "train").withColumn("__res", F.col("label") - F.col("log_prediction"))
    per = group_quantiles(residual, [segment], ["__res"], alphas)
    whole = group_quantiles(residual, [], ["__res"], alphas).select("__res__q").scalar()
    out = join_same(scored, per, [segment]).withColumn("__q", F.coalesce("__res__q", whole))
    made = {
        f"p{round(a * 100)}_usd": clamp(F.expm1(F.col("log_prediction") + F.col("__q")[i]), 0, None)
        for i, a in enumerate(alphas)
    }
    return out.withColumns(made).drop("__q", "__res__q")


def train_grid(
    df: DataFrame, feature_sets: Mapping[str, Sequence[str]], modes: Sequence[str], models: Sequence[str] | None = None,
    correct: bool = True, split: str = "split", parallel: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Every feature set x target mode x model, scored on validation and test; and the selection.

    The loop is over model settings, never over data; the input should be a written table. Models of a set and mode learn
    from the same stored vectors; ``parallel`` fits run at a time.
    """
    spark = df.sparkSession
    train_rows = df.filter(F.col(split) == "train").count()
    corrects = correct and "salary_segment" in df.columns
    wanted = [(name, scale) for name, (_, scale) in estimators(train_rows).items() if models is None or name in models]

    def vectors(setting: tuple[str, str, bool]) -> DataFrame:
        set_name, mode, scale = setting
        features = [f for f in feature_sets[set_name] if f in df.columns]
        labelled = prepared(df, features, target_mode(mode), split)
        numeric = numeric_columns(labelled, features)
        stages = tabular_preprocessor(numeric, [f for f in features if f not in numeric], scale)
        return cut(stages.fit(labelled.filter(F.col(split) == "train")).transform(labelled))

    def candidate(work: tuple[tuple[str, str, bool], DataFrame, str]) -> DataFrame:
        (set_name, mode, _), rows, name = work
        model = estimators(train_rows)[name][0].fit(rows.filter(F.col(split) == "train"))
        scored = cut(score(model, rows, "raw").drop("features").withColumn("pred", prediction_to_share("raw", mode)))
        variants = {name: "pred"}
        if corrects:
            scored = residual_correction(scored, F.col(split) == "train", "salary_cap_share", "pred")
            variants[f"{name}_segment_corrected"] = "corrected"
        held_out = scored.filter(F.col(split).isin("validation", "test"))
        return cut(union_all([
            salary_metrics(held_out, column, [split]).withColumns({"model": F.lit(label), "target_mode": F.lit(mode), "feature_set": F.lit(set_name)})
            for label, column in variants.items()
        ]))

    with ThreadPoolExecutor(parallel) as pool:
        settings = [(s, mode, scale) for s in feature_sets for mode in modes for scale in sorted({scale for _, scale in wanted})]
        stored = dict(zip(settings, pool.map(inheritable_thread_target(spark)(vectors), settings)))
        fits = [(at, rows, name) for at, rows in stored.items() for name, scale in wanted if scale == at[2]]
        results = list(pool.map(inheritable_thread_target(spark)(candidate), fits))
    evaluations = cut(union_all(results))
    identity = ["target_mode", "model", "feature_set"]
    ranked = evaluations.withColumn("experiment", F.lit("salary"))
    selected = model_selection(ranked, "cap_share_mae", ["experiment"], identity, ["cap_share_mae", "usd_mae", "r2"])
    return evaluations, selected


# --- importance ---------------------------------------------------------------------------
def holdout(df: DataFrame, ids: Sequence[str], share: float = 0.25, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(train, valid) by a hash of the row key, the same however the data is partitioned."""
    bucket = F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(10_000)) / 10_000
    return df.filter(bucket >= share), df.filter(bucket < share)


def univariate_signal_scan(
    df: DataFrame, target: str, features: Sequence[str], ids: Sequence[str], min_rows: int = 500, classify: bool = False,
    rounds: int = 250,
) -> DataFrame:
    """Linear against boosted-tree score of each feature alone on a holdout."""
    checks = df.dropna(subset=[target]).agg(*[F.count(f).alias(f) for f in features]).first()
    rows = []
    for f in [f for f in features if checks[f] >= min_rows]:
        pair = df.select(*ids, F.col(f).cast("double").alias(f), F.col(target).cast("double").alias("label")).dropna()
        train, valid = holdout(pair, ids)
        linear = logistic(rows=int(checks[f]), strength=1.0) if classify else ridge(1.0, int(checks[f]))
        fit_rows = train.withColumn("__weight", F.lit(1.0)) if classify else train
        scores = {}
        for name, estimator in (("linear_score", linear), ("tree_score", gbt(classify=classify, rounds=rounds))):
            scored = score(fit(fit_rows, [f], estimator, name == "linear_score"), valid, "__p", classify)
            metric = classification_metrics(scored, "label", "__p").select(F.col("roc_auc").alias(name)) if classify \
                else regression_metrics(scored, "label", "__p").select(F.col("r2").alias(name))
            scores[name] = metric
        gap = F.col("tree_score") - F.col("linear_score")
        one = scores["linear_score"].withColumn("tree_score", scores["tree_score"].scalar())
        rows.append(one.withColumns({
            "target": F.lit(target), "feature": F.lit(f), "metric": F.lit("roc_auc" if classify else "r2"),
            "tree_minus_linear": gap,
            "relationship_hint": F.when(gap > 0.03, "nonlinear_or_threshold").otherwise("mostly_linear_or_weak"),
        }))
    return union_all(rows)


def permutation_importance(
    model, df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str], repeats: int = 5, seed: int = SEED,
    orders: Sequence[Sequence[Column]] | None = None,
) -> DataFrame:
    """(feature, importance_mean, importance_std): rise of the MAE when one feature is shuffled, over the repeats.

    A shuffle gives the row at each place of the key order the values of the row at the same place of another
    order: of a hash of the key, or each of ``orders`` (which must be total). Every row goes to its places in all orders
    in one shuffle; the stored rows hold their own values next to the borrowed ones, and one scoring pass takes every
    feature and repeat as variants of the row inside the task. ``model`` has ``transform`` giving ``prediction``.
    """
    orders = orders or [[F.xxhash64(*ids, F.lit(seed + r)), *[F.col(c) for c in ids]] for r in range(repeats)]
    placed = positions(df.select(*ids, *features, label), [], list(ids), "__p0")
    for r, order in enumerate(orders, 1):
        placed = positions(placed, [], order, f"__p{r}")
    placed = cut(placed)
    kinds = dict(placed.dtypes)
    # place 0 keeps the row itself, place r lends its values to another row
    goes = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(f"__p{r}").alias("at")) for r in range(len(orders) + 1)])).alias("g")
    values = F.struct(*features, F.col(label).cast("double").alias("__y")).alias("v")
    meets = placed.select(goes, values).select("g.at", "g.r", "v").groupBy("at")
    rows = cut(meets.agg(*[F.max(F.when(F.col("r") == r, F.col("v"))).alias(f"v{r}") for r in range(len(orders) + 1)]).drop("at"))

    def variant(feature: str | None, r: int) -> Column:
        cells = [F.col(f"v{r if f == feature else 0}")[f].cast(kinds[f]).alias(f) for f in features]
        return F.struct(F.lit(feature).cast("string").alias("feature"), F.lit(r).alias("repeat"), F.col("v0")["__y"].alias("label"), *cells)

    every = [variant(None, 0), *[variant(f, r) for r in range(1, len(orders) + 1) for f in features]]
    scored = model.transform(rows.select(F.explode(F.array(*every)).alias("e")).select("e.*"))
    losses = cut(scored.groupBy("feature", "repeat").agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae")))
    base = losses.filter("feature is null").select("mae").scalar()
    loss = F.col("mae") - base
    return losses.filter("feature is not null").groupBy("feature").agg(F.avg(loss).alias("importance_mean"), F.stddev_pop(loss).alias("importance_std"))
