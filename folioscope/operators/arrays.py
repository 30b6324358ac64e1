"""Small helpers for columns that hold arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, array_col: str | Column, item: str, keep: list[str]) -> DataFrame:
    """One row per array element, next to the ``keep`` columns.

    The outer form is used on purpose. For a plain explode Spark infers a filter ``size(array) > 0`` and pushes it
    to the scan, which evaluates the expression behind the array (a tokeniser, here) a second time.
    """
    return df.select(*keep, F.explode_outer(array_col).alias(item)).where(F.col(item).isNotNull())


def with_term_counts(df: DataFrame, tokens_col: str, out_col: str = "terms") -> DataFrame:
    """Add ``array<struct<term, tf>>``, the counts of each row's tokens, without a shuffle.

    The tokens are sorted inside the row and the ends of equal runs are located; the distance between two ends is
    a count. Grouping exploded tokens by (document, term) would ship every token over the network instead.
    """
    runs = df.withColumn("_sorted", F.sort_array(tokens_col))
    positions = F.when(F.size("_sorted") > 0, F.sequence(F.lit(1), F.size("_sorted"))).otherwise(
        F.array().cast("array<int>")
    )
    runs = runs.withColumn(
        "_ends",
        F.filter(positions, lambda i: ~F.get("_sorted", i - 1).eqNullSafe(F.get("_sorted", i))),
    )
    counts = F.transform(
        "_ends",
        lambda end, i: F.struct(
            F.get("_sorted", end - 1).alias("term"),
            (end - F.coalesce(F.get("_ends", i - 1), F.lit(0))).cast("long").alias("tf"),
        ),
    )
    return runs.withColumn(out_col, counts).drop("_sorted", "_ends")
