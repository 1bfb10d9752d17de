"""Data-quality checks as plain aggregates over columns, keys and split labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.config import QualityConfig
from formline.functions.scalars import number
from formline.operators.aggregates import value_counts
from formline.operators.frames import union_all
from formline.session import cut

_ISSUES = "severity string, check string, column string, message string"


def missing_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return sorted(set(columns) - set(df.columns))


def missing_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Type, missing count and share, and distinct values per column; an absent column misses all.

    Values are counted per (column, value) before they are counted per column, so the
    shuffle is spread over values.
    """
    present = [c for c in columns if c in df.columns]
    kinds = dict(df.dtypes)
    spark = df.sparkSession
    names = spark.createDataFrame([(c, kinds.get(c, "MISSING_COLUMN")) for c in columns], "column string, dtype string")
    if not present:
        rows = df.agg(F.count(F.lit(1))).scalar()
        return names.select("column", "dtype", rows.alias("missing_count"), F.lit(1.0).alias("missing_pct"), F.lit(0).cast("long").alias("n_unique"))
    long = df.select(*[number(c).cast("string").alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) for c in present])
    counted = long.unpivot([], present, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("observed"), F.count("value").alias("n_unique"),
        F.sum("n").alias("__rows"),
    )
    out = names.join(per, "column", "left")
    if len(present) < len(columns):
        out = out.withColumn("__rows", F.coalesce("__rows", per.agg(F.max("__rows")).scalar()))
    out = out.withColumn("__rows", F.coalesce("__rows", F.lit(0)))  # an empty table misses nothing
    missing = F.col("__rows") - F.coalesce("observed", F.lit(0))
    share = F.when(F.col("dtype") == "MISSING_COLUMN", 1.0).otherwise(F.try_divide(missing, F.col("__rows")))
    return out.select("column", "dtype", missing.alias("missing_count"), share.alias("missing_pct"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"))


def missingness_ranking(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing share per column, most missing first."""
    shares = df.agg(*[F.avg(F.isnull(c).cast("double")).alias(c) for c in columns])
    return shares.unpivot([], list(columns), "feature", "missing_pct").orderBy(F.col("missing_pct").desc(), "feature")


def finite_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite cells per numeric column; NaN is missing, not infinite."""
    present = [c for c in columns if c in df.columns]
    infinite = {c: F.count_if(F.abs(number(c)) == float("inf")) for c in present}
    wide = df.agg(*[agg.alias(c) for c, agg in infinite.items()])
    out = wide.unpivot([], present, "column", "inf_count")
    return out.withColumn("non_finite_count", F.col("inf_count"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key, and their share."""
    spark, label = df.sparkSession, ", ".join(keys)
    schema = "key_columns string, duplicate_count long, duplicate_rate double, missing_key_columns string"
    if not keys:
        return spark.createDataFrame([("", 0, 0.0, None)], schema)
    missing = missing_columns(df, keys)
    if missing:
        return spark.createDataFrame([(label, None, None, ", ".join(missing))], schema)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return counts.agg(
        F.lit(label).alias("key_columns"), extra.alias("duplicate_count"),
        F.coalesce(F.try_divide(extra, F.sum("n")), F.lit(0.0)).alias("duplicate_rate"),
        F.lit(None).cast("string").alias("missing_key_columns"),
    )


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    if split not in df.columns:
        return df.sparkSession.createDataFrame([], f"{split} string, rows long, row_pct double")
    return value_counts(df, split).orderBy(split)


def validate_training(df: DataFrame, config: QualityConfig) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Issue table (severity, check, column, message) and the audit tables behind it."""
    spark = df.sparkSession
    wanted = {*config.required, *config.features, *config.targets, config.split}
    absent = missing_columns(df, wanted)
    frames = [spark.createDataFrame([("error", "required_column", c, f"Missing required column: {c}") for c in absent], _ISSUES)]
    values = list(dict.fromkeys([*config.features, *config.targets]))
    missing = cut(missing_summary(df, values))
    # audit tables are a few rows each: materialised once, read by the checks and the caller
    audit = {
        "split_summary": cut(split_summary(df, config.split)),
        "feature_missing_summary": missing.filter(F.col("column").isin(*config.features)),
        "target_missing_summary": missing.filter(F.col("column").isin(*config.targets)),
        "numeric_finite_summary": cut(finite_summary(df, values)),
        "duplicate_key_summary": cut(duplicate_keys(df, config.keys)),
    }

    def issues(rows: DataFrame, severity: str, check: str, column, message) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), column.alias("column"), message.alias("message"))

    if config.split in df.columns:
        labels = audit["split_summary"].select(F.col(config.split).cast("string").alias("label")).dropna()
        odd = labels.filter(~F.col("label").isin(*config.allowed_splits))
        frames.append(issues(odd, "error", "split_label", F.lit(config.split), F.concat(F.lit("Unexpected split label: "), F.col("label"))))
        if config.require_all_splits:
            allowed = spark.createDataFrame([(s,) for s in config.allowed_splits], "label string")
            lost = allowed.join(labels, "label", "left_anti")
            frames.append(issues(lost, "error", "split_presence", F.lit(config.split), F.concat(F.lit("Missing required split: "), F.col("label"))))
    for kind, limit in (("feature", config.max_feature_missing), ("target", config.max_target_missing)):
        over = audit[f"{kind}_missing_summary"].filter(F.col("missing_pct") > limit)
        text = F.format_string(f"{kind.title()} missing pct %.4f exceeds {limit:.4f}", F.col("missing_pct"))
        frames.append(issues(over, "error", f"{kind}_missing", F.col("column"), text))
    bad = audit["numeric_finite_summary"].filter(F.col("inf_count") > 0)
    text = F.concat(F.lit("Column contains non-finite numeric values: "), F.col("inf_count").cast("string"))
    frames.append(issues(bad, "error", "numeric_finite", F.col("column"), text))
    twice = audit["duplicate_key_summary"].filter(F.col("duplicate_count") > 0)
    text = F.concat(F.lit("Duplicate key rows found: "), F.col("duplicate_count").cast("string"))
    frames.append(issues(twice, "warning", "duplicate_key", F.col("key_columns"), text))
    return union_all(frames), audit


def assert_valid(df: DataFrame, config: QualityConfig) -> None:
    """Raise on any error-severity issue (issues are bounded by columns and labels)."""
    issues, _ = validate_training(df, config)
    errors = issues.filter(F.col("severity") == "error").select("message").distinct().orderBy("message").collect()
    if errors:
        raise ValueError("Training dataframe failed validation:\n" + "\n".join(r["message"] for r in errors))


def assert_clean(df: DataFrame, keys: Sequence[str], name: str = "table") -> None:
    """Not empty, keys present, no NULL key, no duplicate key."""
    missing = missing_columns(df, keys)
    if missing:
        raise ValueError(f"{name} is missing key columns: {missing}")
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("extra"),
        F.max(F.greatest(*[F.isnull(k).cast("int") for k in keys], F.lit(0))).alias("nulls"),
    ).first()
    if not found["rows"]:
        raise ValueError(f"{name} is empty after cleaning.")
    if found["nulls"]:
        raise ValueError(f"{name} has missing key values.")
    if found["extra"]:
        raise ValueError(f"{name} has {found['extra']} duplicate key rows.")


def null_rate_gate(df: DataFrame, columns: Sequence[str], limit: float = 0.25, ratio_columns: Sequence[str] = ()) -> bool:
    """True when a refresh is due: a column is absent, too much is missing, or a ratio is off scale."""
    if missing_columns(df, columns):
        return True
    return bool(null_rate_report(df, columns, limit, ratio_columns).first()["refresh"])


def null_rate_report(df: DataFrame, columns: Sequence[str], limit: float = 0.25, ratio_columns: Sequence[str] = ()) -> DataFrame:
    share = sum((F.avg(F.isnull(c).cast("double")) for c in columns), F.lit(0.0)) / len(columns)
    off = F.lit(False)
    for c in ratio_columns:
        off = off | F.coalesce(F.max(number(c)) > 1.5, F.lit(False))
    empty = F.count(F.lit(1)) == 0
    return df.agg(share.alias("missing_share"), off.alias("off_scale"), (empty | (share > limit) | off).alias("refresh"))


def schema_report(frames: dict[str, DataFrame], expected: dict[str, Sequence[str]]) -> DataFrame:
    """Rows, missing and extra columns per table."""
    parts = []
    for name, df in frames.items():
        want = expected.get(name, ())
        lost, extra = ", ".join(missing_columns(df, want)), ", ".join(sorted(set(df.columns) - set(want)))
        parts.append(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(lost).alias("missing_columns"), F.lit(extra).alias("extra_columns")))
    return union_all(parts)


def dataframe_fingerprint(df: DataFrame, season: str, split: str = "split") -> DataFrame:
    """One row: rows, columns, season range and distinct seasons, and split counts as text."""
    columns = ", ".join(df.columns)
    counts = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    label = F.concat(F.coalesce(F.col(split), F.lit("null")), F.lit("="), F.col("n").cast("string"))
    splits = counts.agg(F.array_join(F.array_sort(F.collect_list(label)), ";"))
    base = df.agg(
        F.count(F.lit(1)).alias("rows"), F.min(season).alias("season_min"), F.max(season).alias("season_max"),
        F.countDistinct(season).alias("season_count"),
    )
    return base.select("*", F.lit(columns).alias("columns"), splits.scalar().alias("split_counts"))
