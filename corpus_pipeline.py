"""The training-data pipeline over ``documents``: each stage applies one operator to all that the stage before kept.

A stage takes ``(spark, docs, sf_dir)``. The stages but the last return the columns of documents; what they decide has
taken effect in these rows. Rows without an id are kept by the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.catalog import remainder, table, tokenizer_file
from folioscope.llm.common import materialised, row_key
from folioscope.llm.decontamination import contamination
from folioscope.llm.line_dedup import dedup_lines
from folioscope.llm.packing import packed_documents
from folioscope.llm.similarity_join import classed_rows
from folioscope.llm.toxicity import fit_toxicity

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go. Labels of a quarter of the ids are not learnt from."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder(4) != 2)
    name = unused(docs, "toxicity")
    return columns_of(docs, model.with_scores(docs, "text", name).where(F.col(name) < TOXIC_FROM))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned common blocks go from the later document; a document that loses all its lines goes."""
    found = dedup_lines(docs)
    text = F.col("text")
    emptied = (F.col("n_removed") > 0) & (F.length(F.regexp_replace(text, "\\s+", "")) == 0)
    kept = found.where(~F.coalesce(emptied, F.lit(False)))
    n_chars = F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the first one by id stays; rows alike in id and text are one document."""
    name, found = unused(docs, "row_key"), classed_rows(docs)
    later = (F.col("doc_id") != F.col("class_id")) | (F.col("row") != F.col("class_row"))
    gone = found.where(later).select("doc_id", F.col("row").alias(name)).distinct()
    return columns_of(docs, docs.withColumn(name, row_key()).join(gone, ["doc_id", name], "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    name = unused(docs, "hits")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), name=name)
    return columns_of(docs, found.where(F.size(name) == 0))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packed_documents(docs, tokenizer_file())


def columns_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever their names."""
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = "_" + name
    return name


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Fitting, alignment and packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = materialised(stage(spark, docs, sf_dir), f"pipeline_{place}")
    return docs
