"""Lexical statistics and corpus-wide word filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import clean_tokens, lexical_tokens, ratio, sentence_count
from folioscope.operators.arrays import unnest, with_term_counts
from folioscope.session import MAX_BROADCAST_ROWS, materialised

METRICS = ["nb_words", "nb_sentences", "words_per_sentence", "vocab_size_doc", "ttr", "hapax_ratio"]

#: Longer words, in bytes, are never part of a shared dictionary.
LONGEST = 128


def lexical_metrics(df: DataFrame, text_col: str, keep_tokens: bool = False) -> DataFrame:
    """Add the six document measures. One narrow pass: the counts are made inside each row."""
    out = df.withColumn("tokens", lexical_tokens(text_col)).withColumn("nb_sentences", sentence_count(text_col))
    out = with_term_counts(out, "tokens", "_terms")
    out = out.withColumns({"nb_words": F.size("tokens"), "vocab_size_doc": F.size("_terms")})
    out = out.withColumns(
        {
            "words_per_sentence": ratio(F.col("nb_words"), F.col("nb_sentences")),
            "ttr": ratio(F.col("vocab_size_doc"), F.col("nb_words")),
            "hapax_ratio": F.coalesce(
                ratio(F.size(F.filter("_terms", lambda t: t["tf"] == 1)), F.col("nb_words")), F.lit(0.0)
            ),
        }
    )
    return out.drop("_terms") if keep_tokens else out.drop("_terms", "tokens")


def metric_means(df: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    return df.agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics])


def term_totals(df: DataFrame, tokens_col: str) -> DataFrame:
    """``(term, total, n_docs)``: one shuffle, of per-task partial sums.

    The tokens of a row are unnested next to its distinct ones; both counts are made by compiled code.
    """
    both = F.array(F.col(tokens_col), F.array_distinct(tokens_col))
    lists = df.select(tokens_col).select(F.posexplode(both).alias("distinct", "words"))
    long = unnest(lists, "words", "term", ["distinct"])
    return long.groupBy("term").agg(
        F.count_if(F.col("distinct") == 0).alias("total"), F.count_if(F.col("distinct") == 1).alias("n_docs")
    )


def corpus_statistics(df: DataFrame, text_col: str) -> DataFrame:
    """Total words, vocabulary, corpus hapaxes and corrected type-token ratio V / sqrt(2N)."""
    totals = term_totals(df.select(lexical_tokens(text_col).alias("tokens")), "tokens")
    stats = totals.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_words"),
        F.count("*").alias("vocab_size"),
        F.count_if(F.col("total") == 1).alias("hapax_corpus"),
    )
    return stats.withColumn(
        "corrected_ttr",
        F.coalesce(ratio(F.col("vocab_size"), F.sqrt(2 * F.col("total_words"))), F.lit(0.0)),
    )


def document_frequency(df: DataFrame, tokens_col: str) -> DataFrame:
    """``(term, n_docs)``: the number of documents that hold each word."""
    return (
        unnest(df.select(F.array_distinct(tokens_col).alias("_set")), "_set", "term", [])
        .groupBy("term")
        .agg(F.count("*").alias("n_docs"))
    )


def class_terms(df: DataFrame, label: str, tokens_col: str, k: int) -> DataFrame:
    """The ``k`` most used words of each class, with their weight relative to the first.

    Words are counted per (class, word) without ever merging the texts of a class, and the rank filter is applied
    by every task before the shuffle, so a class with a third of the corpus sends ``k`` rows per task.
    """
    counted = with_term_counts(df.select(label, tokens_col), tokens_col)
    sums = (
        unnest(counted, "terms", "t", [label])
        .groupBy(label, F.col("t.term").alias("term"))
        .agg(F.sum("t.tf").alias("n"))
    )
    by_weight = Window.partitionBy(label).orderBy(F.desc("n"), "term")
    top = sums.withColumn("rank", F.row_number().over(by_weight)).where(F.col("rank") <= k)
    return top.withColumn("rel_freq", ratio(F.col("n"), F.max("n").over(Window.partitionBy(label))))


def with_words_replaced(
    df: DataFrame, id_col: str, tokens_col: str, table: DataFrame, out_col: str, keep_unknown: bool, max_rows: int
) -> DataFrame:
    """``(id, out_col)``, one row per row of ``df``: tokens replaced by a table ``(word, value, n_docs)``, in place.

    The ``max_rows`` most frequent words, nearly all of the tokens, are one shared dictionary; they are looked up inside
    the row. Only if the table has more words, the distinct other words of each document are joined with it, where no
    word is frequent, and what is found comes back to the document by its key: tokens are never exchanged one by one.
    Words stay in Arrow buffers, a few rows at a time: no token becomes a Python object.
    """
    spark = df.sparkSession
    table = materialised(table.select("word", "value", "n_docs"), "words")
    frequent = table.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n_docs"), "word").limit(max_rows)
    head = frequent.select("word", "value").toArrow().combine_chunks()
    known = spark.sparkContext.broadcast(
        tuple(pa.concat_arrays([pa.array([], pa.string()), *head.column(i).cast(pa.string()).chunks]) for i in (0, 1))
    )

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _ = known.value
        for some in slices(batches):
            row, flat = flattened(some.column(1))
            open_ = pc.is_null(pc.index_in(flat, value_set=words))
            code = flat.filter(open_).dictionary_encode()
            row = row[open_.to_numpy(zero_copy_only=False)]
            at = pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row, at = row[at >= 0], at[at >= 0]
            pairs = np.unique(row * max(len(code.dictionary), 1) + at)
            row, at = np.divmod(pairs, max(len(code.dictionary), 1))
            yield pa.RecordBatch.from_arrays(
                [some.column(0).take(pa.array(row)), code.dictionary.take(pa.array(at))], names=["_row", "word"]
            )

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = known.value
        for some in slices(batches):
            row, flat = flattened(some.column(1))
            at = pc.index_in(flat, value_set=words)
            new = values.take(at)
            if some.num_columns > 2:
                # A word has one value, so what one document found serves the others of the slice too.
                more, their = (flattened(some.column(i))[1] for i in (2, 3))
                new = pc.coalesce(new, their.take(pc.index_in(flat, value_set=more)))
            if keep_unknown:
                new = pc.coalesce(new, flat)
            else:
                there = pc.is_valid(new)
                row, new = row[there.to_numpy(zero_copy_only=False)], new.filter(there)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=some.num_rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.ListArray.from_arrays(pa.array(ends), new)], names=[id_col, out_col]
            )

    fields = T.StructType([df.schema[id_col], T.StructField(out_col, T.ArrayType(T.StringType()))])
    docs = df.select(id_col, tokens_col)
    if table.count() == len(known.value[0]):
        return docs.mapInArrow(replaced, fields)
    # Rows are named once and for all: keys may repeat or be null.
    docs = materialised(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    open_words = docs.select("_row", tokens_col).mapInArrow(others, "_row long, word string")
    found = open_words.join(table.select("word", "value"), "word").groupBy("_row").agg(
        F.collect_set(F.struct("word", "value")).alias("_found")
    )
    joined = docs.join(found, "_row", "left").select(id_col, tokens_col, "_found.word", "_found.value")
    return joined.mapInArrow(replaced, fields)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def flattened(lists: pa.ListArray) -> tuple[np.ndarray, pa.StringArray]:
    """The row of each element, and the elements; a null list has none."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().cast(pa.string())


def keep_vocabulary(
    df: DataFrame, id_col: str, tokens_col: str, vocabulary: DataFrame, out_col: str, max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """``(id, out_col)``: each document's tokens that are in ``vocabulary (term, n_docs)``; order and repeats kept.

    Documents that lose every word stay, empty.
    """
    table = vocabulary.select(F.col("term").alias("word"), F.col("term").alias("value"), "n_docs")
    return with_words_replaced(df, id_col, tokens_col, table, out_col, False, max_rows)


def filter_rare_words(
    df: DataFrame, id_col: str, tokens_col: str, min_docs: int = 5, out_col: str = "tokens_filtered"
) -> DataFrame:
    """``(id, out_col)``: tokens of words found in at least ``min_docs`` documents."""
    frequent = document_frequency(df, tokens_col).where(F.col("n_docs") >= min_docs)
    return keep_vocabulary(df, id_col, tokens_col, frequent, out_col)


def lemmatise(
    df: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame, out_col: str = "lemmas",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``(id, out_col)``: tokens replaced by their lemma from a table ``(form, lemma)``; unknown forms stay.

    Of several lemmas of a form the first by name counts; a null lemma leaves the form. Of a table with more than
    ``max_rows`` forms, those that no document uses are left out and the others ordered by document frequency.
    """
    known = F.col("form").isNotNull() & F.col("lemma").isNotNull()
    table = lemmas.where(known).groupBy(F.col("form").alias("word")).agg(F.min("lemma").alias("value"))
    table = materialised(table, "lemmas")
    if table.count() <= max_rows:
        table = table.withColumn("n_docs", F.lit(1))
    else:
        table = table.join(document_frequency(df, tokens_col).withColumnRenamed("term", "word"), "word")
    return with_words_replaced(df, id_col, tokens_col, table, out_col, True, max_rows)


def preprocess_text(
    df: DataFrame, id_col: str, text_col: str, use_lemma: bool = True, lemmas: DataFrame | None = None,
    out_col: str = "clean_text",
) -> DataFrame:
    """``(id, out_col)``: the cleaned and filtered tokens, joined by blanks, as lemmas or as they stand.

    The filters look at the form; ``lemmas`` is a table ``(form, lemma)`` with one row per form.
    """
    if use_lemma and lemmas is None:
        raise ValueError("use_lemma needs a table (form, lemma)")
    tokens = df.select(id_col, clean_tokens(text_col).alias("_tokens"))
    if use_lemma:
        tokens = lemmatise(tokens, id_col, "_tokens", lemmas, "_tokens")
    return tokens.select(id_col, F.array_join("_tokens", " ").alias(out_col))
