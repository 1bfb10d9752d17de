"""Signal tables from the gold layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from formline.operators.labels import consistency_signals, range_signals, trend_signals
from formline.operators.metrics import evaluate_ranges
from formline.operators.similarity import Query, find_replacements_batch, similarity_base
from formline.sources.tables import Layers, load_gold, write_gold


def build_all_signals(spark: SparkSession, root: str, queries: Sequence[Query] = ()) -> dict[str, DataFrame]:
    """Trend, consistency and range signals, their evaluation and replacement examples, written as parquet."""
    layers = Layers(root)
    performance = load_gold(spark, layers, "performance_training_clean")
    ranges = range_signals(performance)
    frames = {
        "player_trend_signals": trend_signals(performance),
        "player_consistency_signals": consistency_signals(performance),
        "short_term_floor_ceiling_signals": ranges,
        "short_term_floor_ceiling_evaluation": evaluate_ranges(ranges),
    }
    if queries:
        role = load_gold(spark, layers, "player_role_features_clean")
        base = similarity_base(role, load_gold(spark, layers, "salary_training_clean"))
        frames["replacement_candidate_examples"] = find_replacements_batch(base, queries)
    write_gold(layers, frames)
    return frames
