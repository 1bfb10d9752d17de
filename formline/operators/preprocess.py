"""Tabular preprocessing as a spark.ml stage: exact medians, most frequent labels, one-hot codes, scaling.

The label table of the categorical columns (column, label, index, share) stays a table: it is counted by one
aggregate, numbered by Spark, stored next to the model and joined to the rows, so neither a column of many labels
nor its counts pass through the driver. The driver holds three numbers a numeric column, one label a
categorical column and, where codes are scaled too, one number a label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions.scalars import number
from formline.operators.frames import numeric_columns
from formline.operators.joins import lookup
from formline.operators.ordered import positions
from formline.operators.quantiles import global_quantiles
from formline.session import cut

SCALES = ("none", "numeric", "all")
#: Scaled codes are kept as one vector of the driver; columns of more labels are an error under ``all``.
MOST_SCALED_LABELS = 1_000_000


def numbers_and_flags(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns among these that are numbers or booleans; booleans count as 0 and 1."""
    numeric, kinds = set(numeric_columns(df, columns)), dict(df.dtypes)
    return [c for c in columns if c in numeric or kinds.get(c) == "boolean"]


class _Settings(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    scale = Param(Params._dummy(), "scale", "none, numeric (numeric columns) or all (codes too)", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)


class TabularPreprocessor(_Settings, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns what ``TabularPreprocessorModel`` applies.

    Numeric columns: the exact median fills gaps (0 where nothing was observed); mean and population deviation
    of the filled column scale it, 1 where it does not vary. Categorical columns: the most frequent label fills gaps
    (the smallest of equals); labels are coded in ascending order. An empty table gives no codes and zeros.
    """

    def __init__(self, numeric: Sequence[str] = (), categorical: Sequence[str] = (), scale: str = "none", outputCol: str = "features"):
        super().__init__()
        if scale not in SCALES:
            raise ValueError(f"scale is one of {SCALES}, not {scale}")
        self._set(numeric=list(numeric), categorical=list(categorical), scale=scale, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> "TabularPreprocessorModel":
        numeric, categorical = self.getOrDefault("numeric"), self.getOrDefault("categorical")
        model = TabularPreprocessorModel._of(self)
        model.medians, model.means, model.scales = _numeric_state(dataset, numeric)
        model.labels = label_table(dataset, categorical)
        top = model.labels.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("most"), F.col("label"))).alias("label"))
        found = {r["column"]: r for r in top.collect()}  # one row a column
        model.widths = {c: found[c]["n"] if c in found else 0 for c in categorical}
        model.modes = {c: found[c]["label"] if c in found else None for c in categorical}
        return model


def _numeric_state(df: DataFrame, columns: Sequence[str]) -> tuple[dict, dict, dict]:
    if not columns:
        return {}, {}, {}
    clean = df.select(*[number(c).alias(c) for c in columns])
    medians = {c: (q[0] if q and q[0] is not None else 0.0) for c, q in global_quantiles(clean, columns, [0.5]).items()}
    filled = {c: F.coalesce(F.col(c), F.lit(medians[c])) for c in columns}
    row = clean.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(filled.values())], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled.values())]).first()
    means = {c: row[f"m{i}"] or 0.0 for i, c in enumerate(columns)}
    return medians, means, {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)}


def label_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, label, n), a state that merges by adding up: counts of two tables are the union's sums."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, label string, n long")
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label")) for c in columns]
    long = df.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")
    return long.groupBy("column", "label").agg(F.count(F.lit(1)).alias("n"))


def label_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, label, ix, share, most): labels numbered from 0 in ascending order, their shares after gaps are filled."""
    counts = cut(label_counts(df, columns))
    total = F.sum("n").alias("total")
    gaps = F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))), F.lit(0)).alias("gaps")
    most = F.max(F.when(F.col("label").isNotNull(), F.col("n"))).alias("top")
    whole = counts.groupBy("column").agg(total, gaps, most)
    top = counts.join(whole, "column").filter(F.col("n") == F.col("top")).groupBy("column").agg(F.min("label").alias("most_label"))
    numbered = positions(counts.filter("label is not null"), ["column"], ["label"], "__at")
    out = numbered.join(whole, "column").join(top, "column")
    is_most = F.col("label") == F.col("most_label")
    share = (F.col("n") + F.when(is_most, F.col("gaps")).otherwise(0)) / F.col("total")
    return cut(out.select("column", "label", (F.col("__at") - 1).cast("int").alias("ix"), share.alias("share"), is_most.alias("most")))


class TabularPreprocessorModel(_Settings, Model, MLWritable, MLReadable):
    """Adds the vector: numeric columns in order, then each categorical column's codes. Labels not learned are all zeros."""

    medians: dict
    means: dict
    scales: dict
    widths: dict
    modes: dict
    labels: DataFrame

    @classmethod
    def _of(cls, settings: _Settings) -> "TabularPreprocessorModel":
        model = cls()
        model._set(**{p: settings.getOrDefault(p) for p in ("numeric", "categorical", "scale", "outputCol")})
        return model

    @property
    def width(self) -> int:
        return len(self.getOrDefault("numeric")) + sum(self.widths.values())

    def names(self) -> DataFrame:
        """(position, name) of every dimension of the vector."""
        spark, start, parts = self.labels.sparkSession, len(self.getOrDefault("numeric")), []
        numeric = spark.createDataFrame(list(enumerate(self.getOrDefault("numeric"))), "position int, name string")
        for c in self.getOrDefault("categorical"):
            own = self.labels.filter(F.col("column") == c)
            parts.append(own.select((F.col("ix") + start).alias("position"), F.concat(F.lit(f"{c}="), "label").alias("name")))
            start += self.widths[c]
        for part in parts:
            numeric = numeric.unionByName(part)
        return numeric

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept, scale, out = dataset.columns, self.getOrDefault("scale"), dataset
        numeric = self.getOrDefault("numeric")
        made = {}
        for c in numeric:
            filled = F.coalesce(number(c), F.lit(self.medians[c]))
            made[f"__n_{c}"] = filled if scale == "none" else (filled - self.means[c]) / self.scales[c]
        out = out.withColumns(made) if made else out
        inputs = list(made)
        for c in [c for c in self.getOrDefault("categorical") if self.widths[c]]:
            size = self.widths[c]
            dim = self.labels.filter(F.col("column") == c).select(F.col("label").alias(f"__k_{c}"), F.col("ix").alias(f"__i_{c}"))
            out = lookup(out.withColumn(f"__k_{c}", F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))), dim, [f"__k_{c}"])
            index = F.coalesce(F.col(f"__i_{c}"), F.lit(size)).cast("double")
            # the size is known, so the encoder reads no rows; what is beyond it is the last category, which is dropped
            coded = out.withColumn(f"__i_{c}", index).withMetadata(f"__i_{c}", {"ml_attr": {"type": "nominal", "num_vals": size, "name": f"__i_{c}"}})
            encoder = OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__o_{c}", handleInvalid="keep", dropLast=True)
            out = encoder.fit(coded).transform(coded)
            inputs.append(f"__o_{c}")
            if scale == "all":
                out = ElementwiseProduct(inputCol=f"__o_{c}", outputCol=f"__z_{c}", scalingVec=Vectors.dense(self._code_scales(c))).transform(out)
                inputs[-1] = f"__z_{c}"
        vector = self.getOrDefault("outputCol")
        out = VectorAssembler(inputCols=inputs, outputCol=vector).transform(out.drop(vector))
        return out.select(*[c for c in kept if c != vector], vector)

    def _code_scales(self, column: str) -> list[float]:
        """One over the population deviation of each code; codes are not centred, which only moves the intercept."""
        if self.widths[column] > MOST_SCALED_LABELS:
            raise ValueError(f"{column} has more than {MOST_SCALED_LABELS} labels; scale numeric columns only")
        p = F.col("share")
        deviation = F.sqrt(p * (1 - p))
        rows = self.labels.filter(F.col("column") == column).select("ix", F.when(deviation > 0, 1 / deviation).otherwise(1.0).alias("w")).collect()
        weights = [1.0] * self.widths[column]
        for r in rows:
            weights[r["ix"]] = r["w"]
        return weights

    def write(self) -> "_ModelWriter":
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> "_ModelReader":
        return _ModelReader()


_STATE = ("medians", "means", "scales", "widths", "modes")


class _ModelWriter(MLWriter):
    """Parameters and small state as metadata, the labels as a table."""

    def __init__(self, model: TabularPreprocessorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata={"state": {s: getattr(self.model, s) for s in _STATE}})
        self.model.labels.write.parquet(f"{path}/labels")


class _ModelReader(MLReader):
    def load(self, path: str) -> TabularPreprocessorModel:
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = TabularPreprocessorModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        for s in _STATE:
            setattr(model, s, metadata["state"][s])
        model.labels = spark.read.parquet(f"{path}/labels")
        return model
