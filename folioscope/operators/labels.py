"""Label audit, filters and distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import measured_broadcast

# The placeholder for a missing label, the bins of group sizes and the dual-support labels.
PLACEHOLDER = "non mentionné"
BIN_EDGES = [0, 10, 20, 30, 40, 50]
BIN_NAMES = ["0-10", "10-20", "20-30", "30-40", "40-50", "50+"]
DUAL_LABELS = [
    "Parti socialiste;Mouvement des radicaux de gauche",
    "Rassemblement pour la République;Union pour la démocratie française",
    "Union pour la démocratie française;Rassemblement pour la République",
]


def is_valid_label(label: str, placeholder: str = PLACEHOLDER) -> Column:
    column = F.col(label)
    return column.isNotNull() & (column != "") & (column != placeholder)


def keep_valid_labels(df: DataFrame, label: str, placeholder: str = PLACEHOLDER) -> DataFrame:
    return df.where(is_valid_label(label, placeholder))


def keep_round(df: DataFrame, round_col: str = "round", value: int = 1) -> DataFrame:
    return df.where(F.col(round_col) == value)


def drop_labels(df: DataFrame, label: str, excluded: Sequence[str]) -> DataFrame:
    """Remove exact labels; a null label is kept."""
    return df.where(F.coalesce(~F.col(label).isin(list(excluded)), F.lit(True)))


def label_counts(df: DataFrame, label: str, count_col: str = "n") -> DataFrame:
    """Label and number of rows; the null label is left out."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias(count_col))


def keep_frequent_labels(df: DataFrame, label: str, threshold: int = 30) -> DataFrame:
    """Keep the rows of labels with at least ``threshold`` rows.

    Only the label column takes part in the count, and the kept labels come back through a measured semi-join, so
    the other columns (whole texts) are not shuffled when the label list is small.
    """
    kept = label_counts(df, label, "_n").where(F.col("_n") >= threshold).select(label)
    return df.join(measured_broadcast(kept), label, "left_semi")


def missing_label_audit(df: DataFrame, columns: Sequence[str], placeholder: str = PLACEHOLDER) -> DataFrame:
    """Nulls, empty strings and placeholders of several columns in one pass, one row per column."""
    measures = []
    for i, name in enumerate(columns):
        column = F.col(name)
        measures += [
            F.count_if(column.isNull()).alias(f"_null{i}"),
            F.count_if(column == "").alias(f"_empty{i}"),
            F.count_if(column == placeholder).alias(f"_placeholder{i}"),
        ]
    totals = df.agg(F.count("*").alias("_rows"), *measures)
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.col(f"_null{i}").alias("n_null"),
            F.col(f"_empty{i}").alias("n_empty"),
            F.col(f"_placeholder{i}").alias("n_placeholder"),
            (F.col(f"_null{i}") + F.col(f"_empty{i}") + F.col(f"_placeholder{i}")).alias("n_missing"),
            F.col("_rows").alias("n_rows"),
        )
        for i, name in enumerate(columns)
    ]
    return totals.select(F.inline(F.array(*rows)))


def frequent_label_count(df: DataFrame, label: str, threshold: int = 30) -> DataFrame:
    return label_counts(df, label).agg(F.count_if(F.col("n") >= threshold).alias("n_frequent"))


def _bin_measures(n: Column) -> list[tuple[str, Column, Column]]:
    measures = []
    for i, name in enumerate(BIN_NAMES):
        inside = n >= BIN_EDGES[i]
        if i + 1 < len(BIN_EDGES):
            inside = inside & (n < BIN_EDGES[i + 1])
        measures.append((name, F.count_if(inside), F.coalesce(F.sum(F.when(inside, n)), F.lit(0))))
    return measures


def group_size_bins(df: DataFrame, label: str, total: bool = False) -> DataFrame:
    """Number of labels and of rows per bin of label size; every bin shows, ``total`` adds a last row.

    The bins are a handful of conditional sums over the label counts, so no join against a bin table is needed.
    """
    measures = _bin_measures(F.col("n"))
    if total:
        measures.append(("Total", F.count("*"), F.coalesce(F.sum("n"), F.lit(0))))
    wide = label_counts(df, label).agg(
        *[m.alias(f"_m{i}") for i, (_, m, _r) in enumerate(measures)],
        *[r.alias(f"_r{i}") for i, (_, _m, r) in enumerate(measures)],
    )
    rows = [
        F.struct(
            F.lit(i).alias("bin_order"),
            F.lit(name).alias("bin"),
            F.col(f"_m{i}").alias("n_modalities"),
            F.col(f"_r{i}").cast("long").alias("n_documents"),
        )
        for i, (name, _, _r) in enumerate(measures)
    ]
    return wide.select(F.inline(F.array(*rows)))


def append_total(bins: DataFrame) -> DataFrame:
    """Row-wise concatenation of a bin table with its total."""
    total = bins.agg(
        F.lit(len(BIN_NAMES)).alias("bin_order"),
        F.lit("Total").alias("bin"),
        F.sum("n_modalities").alias("n_modalities"),
        F.sum("n_documents").alias("n_documents"),
    )
    return bins.unionByName(total)


def label_distribution(
    df: DataFrame, columns: Sequence[str], threshold: int = 30, cumulative: bool = True
) -> DataFrame:
    """Bins, total and number of frequent labels for several label columns.

    With ``cumulative`` the second column is analysed on the rows already valid in the first, and so on.
    """
    parts, working = [], df
    for name in columns:
        valid = keep_valid_labels(working if cumulative else df, name)
        if cumulative:
            working = valid
        measures = _bin_measures(F.col("n")) + [("Total", F.count("*"), F.coalesce(F.sum("n"), F.lit(0)))]
        wide = label_counts(valid, name).agg(
            F.count_if(F.col("n") >= threshold).alias("_frequent"),
            *[m.alias(f"_m{i}") for i, (_, m, _r) in enumerate(measures)],
            *[r.alias(f"_r{i}") for i, (_, _m, r) in enumerate(measures)],
        )
        rows = [
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(i).alias("bin_order"),
                F.lit(bin_name).alias("bin"),
                F.col(f"_m{i}").alias("n_modalities"),
                F.col(f"_r{i}").cast("long").alias("n_documents"),
                F.col("_frequent").alias("n_frequent"),
            )
            for i, (bin_name, _, _r) in enumerate(measures)
        ]
        parts.append(wide.select(F.inline(F.array(*rows))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def size_frequency(df: DataFrame, label: str, below: int = 30) -> DataFrame:
    """Among labels of fewer than ``below`` rows, how many have each size."""
    return (
        label_counts(df, label, "label_size")
        .where(F.col("label_size") < below)
        .groupBy("label_size")
        .agg(F.count("*").alias("n_modalities"))
    )
