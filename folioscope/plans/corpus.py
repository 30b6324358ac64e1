"""The unified corpus: metadata joined to texts, filtered on its labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.labels import DUAL_LABELS, drop_labels, keep_frequent_labels, keep_round, keep_valid_labels
from folioscope.sources.files import metadata_csv, text_folder


def unified_corpus(
    metadata: DataFrame, texts: DataFrame, key: str = "id", label: str = "support", round_col: str = "round",
    keep: Sequence[str] = ("date",), min_label_docs: int | None = 30, keep_unlabelled: bool = False,
    drop: Sequence[str] = (),
) -> DataFrame:
    """Metadata of the first round, left-joined to the texts.

    Labels are filtered before the join: a key names one text, so the number of rows per label is the same before
    and after, and the big side meets only the rows that stay.
    """
    rows = keep_round(metadata.select(key, round_col, label, *keep), round_col)
    if not keep_unlabelled:
        rows = keep_valid_labels(rows, label)
    if min_label_docs is not None:
        rows = keep_frequent_labels(rows, label, min_label_docs)
    if drop:
        rows = drop_labels(rows, label, drop)
    return rows.join(texts, key, "left")


def unmatched_keys(metadata: DataFrame, texts: DataFrame, key: str = "id") -> DataFrame:
    """Keys found on one side only, with the side they are missing from."""
    no_text = metadata.select(key).join(texts.select(key), key, "left_anti").withColumn("missing_from", F.lit("texts"))
    no_row = texts.select(key).join(metadata.select(key), key, "left_anti").withColumn("missing_from", F.lit("metadata"))
    return no_text.unionByName(no_row)


def corpus_from_files(spark: SparkSession, csv_path: str, text_path: str, threshold: int = 30) -> DataFrame:
    return unified_corpus(metadata_csv(spark, csv_path), text_folder(spark, text_path), min_label_docs=threshold)


def corpus_without_dual_labels(spark: SparkSession, csv_path: str, text_path: str, threshold: int = 30) -> DataFrame:
    return unified_corpus(
        metadata_csv(spark, csv_path), text_folder(spark, text_path), min_label_docs=threshold, drop=DUAL_LABELS
    )


def corpus_for_readability(spark: SparkSession, csv_path: str, text_path: str) -> DataFrame:
    """Rare labels and rows without a label stay."""
    return unified_corpus(
        metadata_csv(spark, csv_path), text_folder(spark, text_path), min_label_docs=None, keep_unlabelled=True
    )
