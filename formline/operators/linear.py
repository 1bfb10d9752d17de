"""Linear models from sums: ridge regressions of every segment, and quantile regressions.

Both need only sums over the rows of outer products of (1, features, label), which tasks add up batch by batch
and Spark adds up over tasks. A segment's ridge is solved from its own sums, group by group, so any number of
segments takes one pass and one shuffle of sums. A quantile regression repeats the pass with weights of one over the
absolute residual (the majorising quadratic of the pinball loss) for all levels at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.operators.joins import join_same
from formline.operators.preprocess import TabularPreprocessor, TabularPreprocessorModel, numbers_and_flags
from formline.operators.quantiles import global_quantiles
from formline.session import cut

#: Sums that a task holds before it passes them on.
HELD_BYTES = 64 << 20
#: Dimensions up to which sums of products are formed; their number is its square.
MOST_DIMENSIONS = 2000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def gram_sums(rows: DataFrame, width: int, segment: str | None = None) -> DataFrame:
    """(segment, whole, g): partial sums of outer products of (1, x, label) of rows with ``x`` and ``label``.

    Sums of single segments have ``whole`` false; one sum of all rows of a task has it true. A missing
    segment is in the latter only. Partial sums of a segment come from several tasks, and more than once from one
    that sees more segments than it can hold.
    """
    if width > MOST_DIMENSIONS:
        raise ValueError(f"{width} dimensions; sums of products are formed up to {MOST_DIMENSIONS}")
    side = width + 2
    most = max(1, HELD_BYTES // (8 * side * side))
    schema = pa.schema([("segment", pa.string()), ("whole", pa.bool_()), ("g", pa.list_(pa.float64()))])

    def sent(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.bool_()), pa.array([g.ravel() for g in held.values()], schema.field("g").type),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            y = batch["label"].to_numpy(zero_copy_only=False)
            z = np.column_stack((np.ones(len(y)), _matrix(batch["x"], width), y))
            held[None, True] = held.get((None, True), 0) + z.T @ z
            coded = batch["segment"].dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            bounds = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
            for k, name in enumerate(coded.dictionary.to_pylist()):
                own = z[order[bounds[k] : bounds[k + 1]]]
                if len(held) > most:
                    yield sent(held)
                    held = {}
                held[name, False] = held.get((name, False), 0) + own.T @ own
        if held:
            yield sent(held)

    named = F.col(segment).cast("string") if segment else F.lit(None).cast("string")
    return rows.select(named.alias("segment"), "x", "label").mapInArrow(run, "segment string, whole boolean, g array<double>")


def ridge_of(g: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of the ridge on standardised features, its penalty on the summed squared error."""
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    centred = g[1:, 1:] - n * np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(centred)[:-1], 0) / n)
    scale = np.where(spread > 1e-9 * np.maximum(1.0, np.abs(mean[:-1])), spread, 1.0)
    a = centred[:-1, :-1] / np.outer(scale, scale) + alpha * np.eye(len(scale))
    b = np.linalg.lstsq(a, centred[:-1, -1] / scale, rcond=None)[0] / scale
    return float(mean[-1] - mean[:-1] @ b), b


def ridges(sums: DataFrame, width: int, alpha: float) -> DataFrame:
    """(segment, whole, rows, intercept, coefficients) of every segment and of all rows, solved where Spark grouped them."""
    side = width + 2

    def solve(group: pa.Table) -> pa.Table:
        parts = np.sort(_matrix(group["g"].combine_chunks(), side * side), axis=0)  # the same sum in any order of arrival
        g = parts.sum(axis=0).reshape(side, side)
        intercept, b = ridge_of(g, alpha)
        return pa.table({
            "segment": group["segment"].slice(0, 1), "whole": group["whole"].slice(0, 1), "rows": pa.array([round(g[0, 0])], pa.int64()), "intercept": [intercept], "coefficients": [b.tolist()],
        })

    return sums.groupBy("segment", "whole").applyInArrow(solve, "segment string, whole boolean, rows long, intercept double, coefficients array<double>")


def dot(x: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(x, b, lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v)


def described(df: DataFrame, features: Sequence[str], fit_where: Column, scale: str = "none") -> tuple[DataFrame, TabularPreprocessorModel]:
    """Rows with the preprocessed features as an array ``x``; what fills gaps and codes labels is learned where asked."""
    numeric = numbers_and_flags(df, features)
    stage = TabularPreprocessor(numeric, [f for f in features if f not in numeric], scale, "__v").fit(df.filter(fit_where))
    return stage.transform(df).withColumn("x", vector_to_array("__v")).drop("__v"), stage


def _unscaled(models: DataFrame, stage: TabularPreprocessorModel) -> DataFrame:
    """Coefficients of the features as they were before scaling; codes were not scaled."""
    numeric = stage.getOrDefault("numeric")
    codes = stage.width - len(numeric)
    scales = F.array(*[F.lit(float(v)) for v in [*[stage.scales[c] for c in numeric], *[1.0] * codes]])
    means = F.array(*[F.lit(float(v)) for v in [*[stage.means[c] for c in numeric], *[0.0] * codes]])
    out = models.withColumn("coefficients", F.zip_with("coefficients", scales, lambda b, s: b / s))
    return out.withColumn("intercept", F.col("intercept") - dot("coefficients", means))


def ridge_by_segment(
    df: DataFrame, features: Sequence[str], segment: str, alpha: float = 5.0, min_rows: int = 80, split: str = "split",
) -> tuple[DataFrame, DataFrame]:
    """(scored rows, models): a ridge for each segment with enough training rows, one of all training rows for the rest.

    ``df`` has a ``label``; rows without one do not teach. Scored rows get ``prediction`` and ``used_model``
    (the segment, or ``global_fallback`` for small, unseen and missing segments).
    """
    train = (F.col(split) == "train") & F.col("label").isNotNull()
    # sums of scaled features lose no digits to large means; each segment scales by its own spread again
    rows, stage = described(df, features, train, "numeric")
    solved = cut(ridges(gram_sums(rows.filter(train), stage.width, segment), stage.width, alpha))
    models = _unscaled(solved, stage)
    whole = solved.filter("whole").select("intercept", "coefficients").first()
    own = solved.filter(~F.col("whole") & (F.col("rows") >= min_rows))
    own = own.select(F.col("segment").alias("__segment"), F.col("intercept").alias("__i"), F.col("coefficients").alias("__b"))
    named = join_same(rows.withColumn("__segment", F.col(segment).cast("string")), own, ["__segment"])
    if whole is None:
        return named.select(*df.columns, F.lit(None).cast("double").alias("prediction"), F.lit("global_fallback").alias("used_model")), models
    fallback = F.lit(whole["intercept"]) + dot("x", F.array(*[F.lit(b) for b in whole["coefficients"]]))
    found = F.col("__b").isNotNull()
    scored = named.withColumns({
        "prediction": F.when(found, F.col("__i") + dot("x", "__b")).otherwise(fallback),
        "used_model": F.when(found, F.col("__segment")).otherwise(F.lit("global_fallback")),
    })
    return scored.select(*df.columns, "prediction", "used_model"), models


# --- quantile regression ------------------------------------------------------------------
@dataclass(frozen=True)
class QuantileModel:
    """Intercept and coefficients of each level, and the mean pinball loss after each pass."""

    levels: tuple[float, ...]
    coefficients: np.ndarray  # one row a level, the intercept first
    losses: tuple[tuple[float, ...], ...]

    def predictions(self, x: str) -> list[Column]:
        return [F.lit(float(b[0])) + dot(x, F.array(*[F.lit(float(v)) for v in b[1:]])) for b in self.coefficients]


def fit_quantiles(rows: DataFrame, width: int, levels: Sequence[float], passes: int = 60, tolerance: float = 1e-5) -> QuantileModel:
    """Linear quantile regression of ``label`` on ``x`` by majorisation: each pass solves weighted least squares.

    The pinball loss of a residual r at level t is |r|/2 + (t - 1/2) r, and |r| lies below r^2 / (2|s|) + |s| / 2
    for any s, here the residual of the pass before; so the loss never rises. Passes end when no level's loss falls by
    more than ``tolerance`` of it. ``rows`` should be a written table.
    """
    side, m = width + 1, len(levels)
    taus = np.array(levels, float)
    start = rows.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s"), F.count("label").alias("n")).first()
    if not start["n"]:
        return QuantileModel(tuple(levels), np.zeros((m, side)), ())
    smooth = 1e-4 * (start["s"] or 1.0)
    beta, first, losses = np.zeros((m, side)), global_quantiles(rows, ["label"], list(levels))["label"], []
    beta[:, 0] = first

    def weighted(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, loss, n = np.zeros((m, side, side)), np.zeros((m, side)), np.zeros(m), 0
            for batch in batches:
                y = batch["label"].to_numpy(zero_copy_only=False)
                z = np.column_stack((np.ones(len(y)), _matrix(batch["x"], width)))
                n += len(y)
                for k in range(m):
                    r = y - z @ beta[k]
                    loss[k] += (np.abs(r) / 2 + (taus[k] - 0.5) * r).sum()
                    w = 1 / (smooth + np.abs(r))
                    a[k] += (z * w[:, None]).T @ z
                    b[k] += z.T @ (w * y) + (2 * taus[k] - 1) * z.sum(axis=0)
            if n:
                packed = np.concatenate((a.ravel(), b.ravel(), loss, [n]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(packed)).astype(np.int32)), pa.array(packed)], names=["at", "v"])

        sums = rows.select("x", "label").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
        got = sums.toPandas().sort_values("at")["v"].to_numpy()  # levels x dimensions^2 numbers
        ends = np.cumsum([m * side * side, m * side, m])
        a, b, loss, n = np.split(got, ends)
        return a.reshape(m, side, side), b.reshape(m, side), loss / n[0]

    for _ in range(passes):
        a, b, loss = weighted(beta)
        losses.append(tuple(loss.tolist()))
        if len(losses) > 1 and all(before - now <= tolerance * max(before, 1e-12) for before, now in zip(losses[-2], losses[-1])):
            break
        for k in range(m):
            beta[k] = np.linalg.lstsq(a[k] + 1e-9 * np.trace(a[k]) / side * np.eye(side), b[k], rcond=None)[0]
    return QuantileModel(tuple(levels), beta, tuple(losses))


def quantile_regression(
    df: DataFrame, features: Sequence[str], levels: Sequence[float] = (0.10, 0.50, 0.90), split: str = "split", names: Mapping[float, str] | None = None,
) -> tuple[DataFrame, QuantileModel]:
    """(rows with one column a level, model) for rows with a ``label``, learned on training rows.

    Each level is moved to the exact quantile of its training residuals, so its share of training rows below
    is the level but for ties; then the levels of a row are put in order, so they never cross.
    Columns are ``p10``, ``p50`` and so on unless named.
    """
    train = (F.col(split) == "train") & F.col("label").isNotNull()
    # medians, spreads, labels and vectors all read the rows
    df = cut(df)
    rows, stage = described(df, features, train, "all")
    rows = cut(rows)
    learn = rows.filter(train)
    model = fit_quantiles(learn, stage.width, levels)
    raw = [f"__q{i}" for i in range(len(levels))]
    scored = rows.withColumns(dict(zip(raw, model.predictions("x"))))
    rest = scored.filter(train).select(*[(F.col("label") - F.col(q)).alias(q) for q in raw])
    found = global_quantiles(rest, raw, list(levels))  # all levels' residuals in one pass
    shifts = {q: (found[q] or [0.0] * len(levels))[i] or 0.0 for i, q in enumerate(raw)}
    ordered = F.array_sort(F.array(*[F.col(q) + F.lit(shifts[q]) for q in raw]))
    named = names or {level: f"p{round(level * 100)}" for level in levels}
    rank = {level: i for i, level in enumerate(sorted(levels))}
    out = scored.withColumn("__sorted", ordered)
    return out.select(*df.columns, *[F.col("__sorted")[rank[level]].alias(named[level]) for level in levels]), model
