"""File sources. Schemas are explicit: nothing is inferred from a pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import document_name

# The columns of the metadata file and the names used after ingestion.
METADATA_COLUMNS = {
    "id": "id",
    "contexte-tour": "round",
    "contexte-election": "election",
    "titulaire-soutien": "support",
    "titulaire-liste": "list_name",
    "date": "date",
}


def metadata_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Header CSV with quoted multi-line fields; columns are matched by name and renamed for SQL use.

    Matching by name needs the header, so the header line alone is read first. An empty field is null.
    """
    columns = METADATA_COLUMNS if columns is None else columns
    header = spark.read.option("header", True).option("escape", '"').csv(path).columns
    schema = T.StructType(
        [T.StructField(c, T.IntegerType() if columns.get(c) == "round" else T.StringType()) for c in header]
    )
    frame = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", "UTF-8")
        .csv(path)
    )
    return frame.select([F.col(f"`{c}`").alias(columns[c]) for c in header if c in columns])


def text_folder(
    spark: SparkSession, path: str, id_col: str = "id", text_col: str = "text_content", recursive: bool = False,
    key_pattern: str | None = None,
) -> DataFrame:
    """One row per ``*.txt`` file. The key is the file name without extension, or the first group of
    ``key_pattern`` in the file's path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=recursive)
    if key_pattern is None:
        key = document_name(F.col("_metadata.file_name"))
    else:
        key = F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1)
    return files.select(key.alias(id_col), F.col("value").alias(text_col))


def preview(df: DataFrame, id_col: str, text_col: str, n: int = 3, n_chars: int = 800) -> DataFrame:
    """The first ``n`` documents by key, cut for display. Undecodable bytes were replaced by the reader."""
    return df.orderBy(id_col).limit(n).select(id_col, F.substring(text_col, 1, n_chars).alias("raw_preview"))


def head(df: DataFrame, columns: list[str], order_col: str, n: int = 5) -> DataFrame:
    return df.select(columns).orderBy(order_col).limit(n)


def column_names(df: DataFrame) -> DataFrame:
    """The schema as rows, one per column."""
    rows = [(i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string")
