"""Leakage-safe temporal splits."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.config import SHORT_TERM_SPLIT, SPLITS, SplitConfig
from formline.functions.scalars import season_start_year


def assign_split(c: Column | str, config: SplitConfig = SHORT_TERM_SPLIT) -> Column:
    """Split label of a season label: named sets win, then start year <= train end, then default."""
    season = F.col(c) if isinstance(c, str) else c
    out = F.when(season.isNull() & F.lit(config.null is not None), config.null)
    for label in ("validation", "test", "train"):
        members = getattr(config, label)
        if members:
            out = out.when(season.isin(*members), label)
    if config.train_end is not None:
        out = out.when(season_start_year(season) <= int(config.train_end[:4]), "train")
    return out.otherwise(config.default)


def assign_split_sets(c: Column | str, train: Sequence[str], validation: Sequence[str], test: Sequence[str]) -> Column:
    return assign_split(c, SplitConfig(train=tuple(train), validation=tuple(validation), test=tuple(test)))


def assign_split_year(c: Column | str, train_max: int, validation: int, test: int) -> Column:
    year = F.col(c) if isinstance(c, str) else c
    return (
        F.when(year <= train_max, "train").when(year == validation, "validation").when(year == test, "test")
        .otherwise("ignore")
    )


def validate_splits(df: DataFrame, split: str = "split", required: Sequence[str] = SPLITS) -> None:
    if split not in df.columns:
        raise KeyError(f"Missing split column: {split}")
    found = df.agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in required]).first()
    missing = sorted(s for s in required if not found[s])
    if missing:
        raise ValueError(f"Missing required split labels: {missing}")


def split_by_column(df: DataFrame, split: str = "split", labels: Sequence[str] = SPLITS) -> tuple[DataFrame, ...]:
    validate_splits(df, split, labels)
    return tuple(df.filter(F.col(split) == s) for s in labels)


def feature_target_frame(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    missing = sorted({*features, target} - set(df.columns))
    if missing:
        raise KeyError(f"Missing feature/target columns: {missing}")
    return df.dropna(subset=[*features, target]).select(*features, target)


class SupervisedSplits(NamedTuple):
    train: DataFrame
    validation: DataFrame
    test: DataFrame


def make_supervised_splits(df: DataFrame, features: Sequence[str], target: str, split: str = "split") -> SupervisedSplits:
    return SupervisedSplits(*(feature_target_frame(f, features, target) for f in split_by_column(df, split)))
