"""Training drivers: every candidate of every task, its metrics, the selection, and what is composed from them.

A task is a target with a row filter, features, candidates and a metric. All tasks read one stored table; tasks
of the same features and rows share one preprocessor and one stored table of vectors. Candidates are fitted on them by a bounded number of driver
threads, so small fits run side by side while each one's data stays distributed. A fitted candidate is saved
as a pipeline and scored as loaded back. Loops are over settings; the driver sees a few metric rows a candidate.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.config import HORIZONS, STAT_TARGETS, STATS
from formline.functions.scalars import clamp, number
from formline.operators.frames import infer_features
from formline.operators.forest import TableForest
from formline.operators.labels import clip_prediction, minutes_heuristic, naive_last_n, season_average
from formline.operators.metrics import classification_metrics, composition_eval, model_selection, per_game_decision, regression_metrics
from formline.operators.modelling import balanced_weights, gbt, logistic, ridge, score
from formline.operators.preprocess import TabularPreprocessor, TabularPreprocessorModel, numbers_and_flags
from formline.operators.splits import SPLITS
from formline.session import cut, shared_folder

METRICS = ["mae", "rmse", "r2", "brier", "roc_auc", "f1", "accuracy", "precision", "recall", "positive_rate"]
LEARNED = ("linear", "random_forest", "gbt")
MINUTES_RULES = ("last_mpg", "weighted_lag_mpg", "age_decay_weighted_mpg")


@dataclass(frozen=True)
class Task:
    """What to learn.

    family and target name it, ``column`` holds its label; ``where`` (SQL) keeps rows that may teach or be scored.
    features: columns used, or None for all that don't look ahead. classify: probability of label 1.
    rules: candidates that need no fit, name to expression. penalty: of the linear candidate.
    """

    family: str
    target: str
    column: str
    horizon: int = 0
    where: str = "true"
    features: tuple[str, ...] | None = None
    classify: bool = False
    metric: str = "mae"
    models: tuple[str, ...] = LEARNED
    rules: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    penalty: float = 5.0
    clip: str | None = None

    @property
    def key(self) -> str:
        return f"{self.family}/{self.target}/h{self.horizon}"


@dataclass(frozen=True)
class Trained:
    """Evaluations of all candidates, the selection, and the folder of their pipelines."""

    evaluations: DataFrame
    selected: DataFrame
    folder: str

    def pipeline(self, task: Task, model: str) -> PipelineModel:
        return PipelineModel.load(f"{self.folder}/{task.key}/{model}")


# --- task families ------------------------------------------------------------------------
def short_term_tasks(features: Mapping[str, Sequence[str]], models: Sequence[str] = LEARNED) -> list[Task]:
    """Next-games averages of each stat; ``features`` by stat. Form averages are rules."""
    return [
        Task("short_term", stat, STAT_TARGETS[stat], features=tuple(features[stat]), models=tuple(models), penalty=1.0,
             rules={"naive_last_5": lambda s=stat: naive_last_n(s), "season_average": lambda s=stat: season_average(s)})
        for stat in features
    ]


def long_term_tasks(horizons: Sequence[int] = HORIZONS, models: Sequence[str] = LEARNED, stats: Sequence[str] = STATS) -> list[Task]:
    """Activity, and the rates of those active, at each horizon."""
    out = []
    for h in horizons:
        out.append(Task("long_term", "active_probability", f"active_h{h}", h, classify=True, metric="brier", models=tuple(models)))
        for unit in (36, 100):
            out += [Task("long_term", f"{s}_per_{unit}", f"{s}_per_{unit}_h{h}", h, f"active_h{h} = 1", models=tuple(models), clip="rate") for s in stats]
    return out


def minutes_tasks(horizons: Sequence[int] = HORIZONS, models: Sequence[str] = LEARNED) -> list[Task]:
    rules = {r: lambda r=r: minutes_heuristic(r) for r in MINUTES_RULES}
    return [Task("minutes", "minutes_per_game", f"minutes_per_game_h{h}", h, models=tuple(models), rules=rules, penalty=10.0, clip="minutes") for h in horizons]


def per_game_tasks(horizons: Sequence[int] = HORIZONS, models: Sequence[str] = LEARNED, stats: Sequence[str] = STATS) -> list[Task]:
    return [Task("per_game", s, f"{s}_per_game_h{h}", h, models=tuple(models), penalty=10.0) for h in horizons for s in stats]


def availability_tasks(horizons: Sequence[int] = HORIZONS, models: Sequence[str] = LEARNED) -> list[Task]:
    """Few and many games at each horizon; the table needs ``availability_risk``'s labels."""
    return [
        Task("availability", risk, f"{risk}_h{h}", h, classify=True, metric="brier", models=tuple(models))
        for h in horizons for risk in ("low_availability", "high_availability")
    ]


# --- training -----------------------------------------------------------------------------
def estimator_of(name: str, task: Task, rows: int, trees: int = 300, rounds: int = 250):
    """Estimator of a candidate; the linear one is a ridge, or a balanced logistic regression."""
    if name == "linear":
        return logistic(strength=0.5, rows=rows) if task.classify else ridge(task.penalty, rows)
    if name == "random_forest":
        return TableForest(trees=trees, leaf=8, classify=task.classify, weightCol="__weight" if task.classify else "")
    if name == "gbt":
        out = gbt(rounds=rounds, classify=task.classify, held="__held")
        return out._set(weightCol="__weight") if task.classify else out
    raise ValueError(f"Unknown candidate: {name}")


def _named(df: DataFrame, task: Task, model: str, features: int) -> DataFrame:
    given = {"family": F.lit(task.family), "target": F.lit(task.target), "horizon": F.lit(task.horizon), "model": F.lit(model),
             "primary_metric": F.lit(task.metric), "feature_count": F.lit(features)}
    present = [F.col(m) if m in df.columns else F.lit(None).cast("double").alias(m) for m in METRICS]
    return df.withColumns(given).select(*given, "split", "rows", *present)


def evaluate(task: Task, scored: DataFrame, model: str, features: int) -> DataFrame:
    """Metric rows of validation and test for a ``prediction``; a split with one class has no row in a classification."""
    held = scored.filter(F.col("split").isin("validation", "test"))
    if not task.classify:
        clipped = held.withColumn("prediction", clip_prediction("prediction", task.clip)) if task.clip else held
        return _named(regression_metrics(clipped, "label", "prediction", ["split"]), task, model, features)
    out = classification_metrics(held, "label", "prediction", by=["split"])
    return _named(out.filter(F.col("roc_auc").isNotNull()), task, model, features)


def train_tasks(
    df: DataFrame, tasks: Sequence[Task], parallel: int = 8, folder: str | None = None, trees: int = 300, rounds: int = 250,
) -> Trained:
    """Fit, save, load, score and compare all candidates of all tasks on ``df``, which has ``split`` and the labels.

    A task without training rows, or a classification of one class, has only its rules. ``parallel`` fits run at a
    time. Without a folder the pipelines go to the shared checkpoint folder.
    """
    spark = df.sparkSession
    folder = folder or f"{shared_folder(spark)}/pipelines-{uuid.uuid4().hex}"
    stored = cut(df.filter(F.col("split").isin(*SPLITS)))
    keyed = [F.col(c) for c, kind in stored.dtypes if "map<" not in kind]
    guarded = infer_features(stored, [t.column for t in tasks], ["split"], horizon_guard=True, observed_only=True)

    def features_of(task: Task) -> list[str]:
        return [f for f in (task.features or guarded) if f in stored.columns]

    def alike(group: list[Task]) -> list[list[tuple[Task, int, bool]]]:
        """Tasks of one filter and one set of features, by equal rows: (task, training rows, whether it can be learned)."""
        labels = [number(t.column) for t in group]
        train = F.col("split") == "train"
        wanted = []
        for i, label in enumerate(labels):
            taught = F.when(train, label)
            wanted += [F.count(taught).alias(f"n{i}"), F.min(taught).alias(f"lo{i}"), F.max(taught).alias(f"hi{i}")]
            wanted += [F.count_if(labels[j].isNull() != label.isNull()).alias(f"apart{j}_{i}") for j in range(i)]
        found, out = stored.filter(group[0].where).agg(*wanted).first(), {}
        for i, t in enumerate(group):
            learns = bool(found[f"n{i}"]) and bool(t.models) and not (t.classify and found[f"lo{i}"] == found[f"hi{i}"])
            same = next((j for j in out if found[f"apart{j}_{i}"] == 0), i)
            out.setdefault(same, []).append((t, found[f"n{i}"], learns))
        return list(out.values())

    def prepare(batch: list[tuple[Task, int, bool]]) -> list[tuple[Task, DataFrame, int, int]]:
        """One preprocessor and one table of vectors for tasks of the same rows."""
        first, features = batch[0][0], features_of(batch[0][0])
        labels = {f"__label_{i}": number(t.column) for i, (t, _, _) in enumerate(batch)}
        rows = stored.filter(first.where).withColumns(labels).filter("__label_0 is not null")
        rules = [r().alias(f"__rule_{i}_{name}") for i, (t, _, _) in enumerate(batch) for name, r in t.rules.items()]
        kept = ["split", *labels, *rules]
        if any(learns for _, _, learns in batch):
            numeric = numbers_and_flags(rows, features)
            stage = TabularPreprocessor(numeric, [f for f in features if f not in numeric], "all").fit(rows.filter(F.col("split") == "train"))
            for task in [t for t, _, learns in batch if learns]:
                stage.write().overwrite().save(f"{folder}/{task.key}/preprocessor")
            # a tenth of the training rows ends boosting; the same rows however the table is partitioned
            held = (F.pmod(F.xxhash64(*keyed), F.lit(10)) == 0) & (F.col("split") == "train")
            rows, kept = stage.transform(rows.withColumn("__held", held)), [*kept, "features", "__held"]
        written, out = cut(rows.select(*kept)), []
        for i, (task, n, learns) in enumerate(batch):
            own = [F.col("split"), F.col(f"__label_{i}").alias("label"), *[F.col(f"__rule_{i}_{name}").alias(f"rule_{name}") for name in task.rules]]
            vectors = written.select(*own, *(["features", "__held"] if learns else []))
            weighed = learns and task.classify
            out.append((task, cut(balanced_weights(vectors, "label")) if weighed else vectors, n if learns else 0, len(features)))
        return out

    def candidate(task: Task, vectors: DataFrame, n: int, features: int, name: str) -> list:
        held = vectors.filter(F.col("split").isin("validation", "test"))
        if name in task.rules:
            scored = held.withColumn("prediction", F.col(f"rule_{name}"))
        else:
            fitted = estimator_of(name, task, n, trees, rounds).fit(vectors.filter(F.col("split") == "train"))
            path = f"{folder}/{task.key}/{name}"
            PipelineModel([fitted]).write().overwrite().save(path)
            scored = score(PipelineModel.load(path), held, probability=task.classify)
        return evaluate(task, scored, name, features).collect()  # a row for validation, one for test

    with ThreadPoolExecutor(parallel) as pool:
        groups: dict[tuple, list[Task]] = {}
        for t in tasks:
            groups.setdefault((t.where, tuple(features_of(t))), []).append(t)
        batches = [b for found in pool.map(inheritable_thread_target(spark)(alike), groups.values()) for b in found]
        ready = [r for made in pool.map(inheritable_thread_target(spark)(prepare), batches) for r in made]
        fits = [(t, v, n, f, name) for t, v, n, f in ready for name in (*(t.models if n else ()), *t.rules)]
        found = list(pool.map(inheritable_thread_target(spark)(lambda work: candidate(*work)), fits))
    schema = ("family string, target string, horizon int, model string, primary_metric string, feature_count int, split string, rows long, "
              + ", ".join(f"{m} double" for m in METRICS))
    evaluations = cut(spark.createDataFrame([tuple(r) for rows in found for r in rows], schema))
    return Trained(evaluations, select(evaluations), folder)


def primary(evaluations: DataFrame) -> Column:
    return F.when(F.col("primary_metric") == "brier", F.col("brier")).otherwise(F.col("mae"))


def select(evaluations: DataFrame) -> DataFrame:
    """The candidate with the lowest validation value of its task's metric, ties by name, and its test values."""
    valued = evaluations.withColumn("value", primary(evaluations))
    identity = ["family", "target", "horizon", "model"]
    return model_selection(valued, "value", identity[:3], identity, ["value", "rows", "r2", "roc_auc"])


def predict(trained: Trained, task: Task, model: str, df: DataFrame, name: str) -> DataFrame:
    """``df`` with the saved candidate's prediction, for any rows that have the task's features."""
    stage = TabularPreprocessorModel.load(f"{trained.folder}/{task.key}/preprocessor")
    out = score(trained.pipeline(task, model), stage.transform(df), name, task.classify)
    if task.clip:
        out = out.withColumn(name, clip_prediction(name, task.clip))
    return out.select(*df.columns, name)


# --- composition --------------------------------------------------------------------------
def compose_per_game(trained: Trained, tasks: Sequence[Task], df: DataFrame, stats: Sequence[str] = STATS) -> tuple[DataFrame, DataFrame]:
    """(composition, decision): per-game output as the selected rate times every minutes candidate, against direct models.

    For every horizon with a minutes task: validation and test rows are scored by the saved pipelines.
    """
    chosen = {(r["family"], r["target"], r["horizon"]): r["model"] for r in trained.selected.collect()}
    by = {(t.family, t.target, t.horizon): t for t in tasks}
    parts = []
    held = df.filter(F.col("split").isin("validation", "test"))
    for h in sorted({t.horizon for t in tasks if t.family == "minutes"}):
        minutes = by["minutes", "minutes_per_game", h]
        scored, rates = held, {}
        for s in stats:
            key = ("long_term", f"{s}_per_36", h)
            if key in chosen:
                rates[s] = f"rate_{s}"
                scored = predict(trained, by[key], chosen[key], scored, rates[s])
                # only those whose rate is known were scored by the rate's model
                scored = scored.withColumn(rates[s], F.when(number(by[key].column).isNotNull(), F.col(rates[s])))
        columns = {name: rule() for name, rule in minutes.rules.items()}
        done = [r["model"] for r in trained.evaluations.filter((F.col("family") == "minutes") & (F.col("horizon") == h)).select("model").distinct().collect()]
        for name in sorted(set(done) & set(minutes.models)):
            scored = predict(trained, minutes, name, scored, f"minutes_{name}")
            columns[name] = F.when(number(minutes.column).isNotNull(), clamp(f"minutes_{name}", 0, 48))
        if rates:
            parts.append(composition_eval(scored, h, columns, rates))
    if not parts:
        raise ValueError("No horizon has both minutes and rates")
    composition = parts[0]
    for part in parts[1:]:
        composition = composition.unionByName(part)
    composition = cut(composition)
    direct = trained.evaluations.filter(F.col("family") == "per_game").select("horizon", "split", F.col("target").alias("stat"), "model", "mae")
    return composition, per_game_decision(composition, direct, stats)

