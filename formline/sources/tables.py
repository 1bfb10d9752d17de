"""Table scans with column contracts, and parquet sinks."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.config import SALARY_CAPS
from formline.operators.frames import overlay

_FORMATS = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet", ".json": "json", ".jsonl": "jsonl"}

# column contracts: table -> (layer, path below it, required columns)
CONTRACTS = {
    "players": ("raw", "players.parquet", ("player_id", "player_name")),
    "player_game_logs": (
        "silver", "player_game_logs.parquet", ("player_id", "game_id", "game_date", "season", "team_id", "minutes"),
    ),
    "player_season_stats": ("raw", "player_season_stats.parquet", ("player_id", "season")),
    "player_season_salaries": (
        "silver", "player_season_salaries.parquet", ("player_name", "season_label", "salary_usd"),
    ),
    "salary_cap_by_season": ("raw", "salary_cap/salary_cap_by_season.csv", ("season", "salary_cap_usd")),
}
GOLD = (
    "player_role_features_clean", "performance_training_clean", "salary_training_clean",
    "long_term_player_forecast_training",
)


@dataclass(frozen=True)
class Layers:
    """Folders (or URIs) of the data layers below one root."""

    root: str

    def path(self, layer: str, name: str = "") -> str:
        return "/".join(p for p in (self.root.rstrip("/"), layer, name) if p)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values have one form: NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def scan_table(
    spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None, **options
) -> DataFrame:
    """Read csv, tsv, parquet, json (one document) or jsonl, chosen by suffix or ``fmt``."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    kind = fmt or _FORMATS.get(suffix)
    if kind not in _FORMATS.values():
        raise ValueError(f"Unsupported file extension: {suffix}")
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if kind in ("csv", "tsv"):
        separator = {"sep": "\t"} if kind == "tsv" else {}
        df = reader.options(header=True, inferSchema=schema is None, **separator).csv(path)
    elif kind == "json":
        df = reader.option("multiLine", True).json(path)
    elif kind == "jsonl":
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    return nan_to_null(df)


def scan_dir(
    spark: SparkSession, folder: str, kinds: str | Sequence[str] = "parquet", schema=None, pattern: str = "*", **options
) -> DataFrame:
    """All files of the given kinds below a folder whose names match ``pattern``, each row tagged with its ``source_file``.

    Files of several kinds are united by column name; a column that a kind lacks is NULL in its rows.
    """
    out = None
    for kind in [kinds] if isinstance(kinds, str) else kinds:
        if kind not in _FORMATS.values():
            raise ValueError(f"Unsupported file kind: {kind}")
        found = scan_table(spark, folder, kind, schema, recursiveFileLookup=True, pathGlobFilter=f"{pattern}.{kind}", **options)
        found = found.withColumn("source_file", F.input_file_name())
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    if out is None:
        raise ValueError("name at least one kind of file")
    return out


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Check a minimum schema on the analysed plan; runs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{name} is missing required columns: {missing}")
    return df


def load(spark: SparkSession, layers: Layers, table: str) -> DataFrame:
    layer, name, columns = CONTRACTS[table]
    return require_columns(scan_table(spark, layers.path(layer, name)), columns, table)


def load_players(spark: SparkSession, layers: Layers) -> DataFrame:
    return load(spark, layers, "players")


def load_game_logs(spark: SparkSession, layers: Layers) -> DataFrame:
    return load(spark, layers, "player_game_logs")


def load_season_stats(spark: SparkSession, layers: Layers) -> DataFrame:
    return load(spark, layers, "player_season_stats")


def load_salaries(spark: SparkSession, layers: Layers) -> DataFrame:
    return load(spark, layers, "player_season_salaries")


def load_salary_cap(spark: SparkSession, layers: Layers) -> DataFrame:
    return load(spark, layers, "salary_cap_by_season")


def load_gold(spark: SparkSession, layers: Layers, name: str) -> DataFrame:
    return scan_table(spark, layers.path("gold", f"{name}.parquet"))


def write_gold(layers: Layers, frames: Mapping[str, DataFrame], partition_by: Mapping[str, str] | None = None) -> None:
    """Overwrite one parquet table per frame, optionally partitioned by a period column."""
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        period = (partition_by or {}).get(name)
        if period is not None:
            writer = writer.partitionBy(period)
        writer.parquet(layers.path("gold", f"{name}.parquet"))


def salary_cap_defaults(spark: SparkSession) -> DataFrame:
    schema = "season string, salary_cap_usd long, tax_level_usd long"
    return spark.createDataFrame(SALARY_CAPS, schema).withColumn("source", F.lit("curated_salary_cap_history"))


def complete_salary_cap(spark: SparkSession, cap: DataFrame | None) -> DataFrame:
    """Defaults overlaid with the given table, per season."""
    default = salary_cap_defaults(spark)
    if cap is None:
        return default
    if "salary_cap" in cap.columns and "salary_cap_usd" not in cap.columns:
        cap = cap.withColumnRenamed("salary_cap", "salary_cap_usd")
    wanted = ["season", "salary_cap_usd", "tax_level_usd", "source"]
    for c in wanted[2:]:
        if c not in cap.columns:
            cap = cap.withColumn(c, F.lit(None))
    return overlay(default, cap.select(*wanted), "season", ["salary_cap_usd"])
