"""Corpus pipeline: quality filter, line and near-duplicate removal, decontamination, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written
and read again as the next one's ``docs``. All but the last return the columns of ``documents``; the last adds
the token ids. ``docs`` may have further columns, which pass through, and repeated or missing ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm import bpe, contamination, jaccard, lines, quality_model
from formline.llm.common import quoted, remainder, table
from formline.session import MADE, cut, discard, shared_folder

#: Texts whose quality score is below this go: the mark of the quality contract.
KEEP_SCORE = 0.3
#: Share of words in benchmark passages from which a text is contaminated.
CONTAMINATED = 20

#: Words of a shingle, and the percentage of common ones from which two texts are near-duplicates.
SHINGLE, ALIKE = 5, 80


def _row() -> F.Column:
    """Key of a row: equal ids and texts are one document to every stage."""
    return F.xxhash64(quoted("doc_id"), quoted("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, text): the operators' view of ``docs``, by row key."""
    return docs.select(_row().alias("row"), quoted("text").alias("text"))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text the discriminant keeps; labels are learned from the fitting rows alone.

    Without labels of both classes nothing is rejected. A text without words gives no evidence and stays.
    """
    described = cut(quality_model.features(docs.select(_row().alias("row"), quoted("doc_id").alias("doc_id"), quoted("text").alias("text")).select(
        F.struct("row", "doc_id").alias("key"), "text"), id_col="key"))
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    labelled = described.select(F.col("id.doc_id").alias("doc_id"), "x").join(labels, "doc_id").select("label", "x")
    if labelled.select("label").distinct().filter("label in (0, 1)").count() < 2:
        return docs
    scores = quality_model.score(described, quality_model.fit(labelled), id_col="key").join(
        described.select(F.col("id").alias("key"), (F.col("x")[0] == 0).alias("silent")), "key"
    )
    rejected = scores.filter((F.col("score") < KEEP_SCORE) & ~F.col("silent")).select(F.col("key.row").alias("__rejected")).distinct()
    return docs.join(rejected, _row() == F.col("__rejected"), "left_anti")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text without the lines that an earlier line repeats; a row that loses all its text goes."""
    kept = lines.dedup_lines(docs, min_words=0, drop_emptied=True)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group of near-duplicates; rows of equal id and text stay or go together."""
    gone = jaccard.near_duplicates(docs.select("doc_id", "text"), n=SHINGLE, percent=ALIKE).filter("not kept").select(F.col("row").alias("__gone")).distinct()
    return docs.join(gone, _row() == F.col("__gone"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with less than a twentieth of their words in passages of the benchmark."""
    found = contamination.decontaminate(_keyed(docs), table(spark, sf_dir, "benchmark"), id_col="row")
    hit = found.filter((F.col("n_hit") > 0) & (CONTAMINATED * F.col("n_hit") >= F.col("n_words"))).select(F.col("row").alias("__hit")).distinct()
    return docs.join(hit, _row() == F.col("__hit"), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: its ids, and the bytes they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


_LEFT: list[str] = []


def _clearing(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, after deleting the scratch tables of the stage before: its result is written by then."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _LEFT)
        before = len(MADE)
        result = stage(spark, docs, sf_dir)
        _LEFT[:] = MADE[before:]
        return result

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _clearing(filter_quality)),
    ("line_dedup", _clearing(dedup_lines)),
    ("near_duplicates", _clearing(drop_near_duplicates)),
    ("decontamination", _clearing(decontaminate)),
    ("tokens", _clearing(tokenize)),
]

#: SQL can express neither the discriminant nor the SimHash lines nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    discard(spark, _LEFT)
    return docs
