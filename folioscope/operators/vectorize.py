"""TF-IDF: capped vocabulary, smoothed idf, unit rows; as an Estimator and as a long table."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.arrays import unnest
from folioscope.operators.lexical import term_totals


def with_bigrams(df: DataFrame, tokens_col: str, out_col: str) -> DataFrame:
    """Words followed by adjacent pairs."""
    pairs = NGram(n=2, inputCol=tokens_col, outputCol="_pairs").transform(df)
    return pairs.withColumn(out_col, F.concat(tokens_col, "_pairs")).drop("_pairs")


def capped_vocabulary(df: DataFrame, tokens_col: str, max_features: int) -> DataFrame:
    """``(term, total, n_docs)`` of the ``max_features`` most used terms; equal counts go by term.

    The ordered limit keeps ``max_features`` rows per task: there is no global sort of the vocabulary.
    """
    return term_totals(df, tokens_col).orderBy(F.desc("total"), "term").limit(max_features)


def smoothed_idf(n_docs: Column, corpus_size: Column) -> Column:
    return F.log((corpus_size + 1) / (n_docs + 1)) + 1


class TfidfVectorizer(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Tokens to unit TF-IDF vectors over a vocabulary of at most ``maxFeatures`` terms.

    The fitted object is an ordinary ``PipelineModel`` of built-in stages, so it saves, loads and transforms inside
    the JVM with no shuffle.
    """

    maxFeatures = Param(Params._dummy(), "maxFeatures", "vocabulary size", TypeConverters.toInt)
    ngramMax = Param(Params._dummy(), "ngramMax", "1: words, 2: words and pairs", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="tokens", outputCol="features", maxFeatures=5000, ngramMax=1):
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="features", maxFeatures=5000, ngramMax=1)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        tokens, out = self.getInputCol(), self.getOutputCol()
        stages, source, temporary = [], tokens, [f"{out}_tf", f"{out}_raw"]
        if self.getOrDefault(self.ngramMax) == 2:
            pairs, grams = f"{out}_pairs", f"{out}_grams"
            stages = [
                NGram(n=2, inputCol=tokens, outputCol=pairs),
                SQLTransformer(statement=f"SELECT *, concat(`{tokens}`, `{pairs}`) AS `{grams}` FROM __THIS__"),
            ]
            source, temporary = grams, temporary + [pairs, grams]
        counted = PipelineModel(stages).transform(dataset)
        corpus_size = dataset.count()
        rows = (
            capped_vocabulary(counted, source, self.getOrDefault(self.maxFeatures))
            .select("term", smoothed_idf(F.col("n_docs"), F.lit(corpus_size)).alias("idf"))
            .collect()
        )
        if not rows:
            raise ValueError("the documents hold no token, so there is no vocabulary to fit")
        dropped = ", ".join(f"`{c}`" for c in temporary)
        stages += [
            CountVectorizerModel.from_vocabulary([r.term for r in rows], inputCol=source, outputCol=f"{out}_tf"),
            ElementwiseProduct(
                scalingVec=Vectors.dense([r.idf for r in rows]), inputCol=f"{out}_tf", outputCol=f"{out}_raw"
            ),
            Normalizer(p=2.0, inputCol=f"{out}_raw", outputCol=out),
            SQLTransformer(statement=f"SELECT * EXCEPT ({dropped}) FROM __THIS__"),
        ]
        return PipelineModel(stages)


def vocabulary_of(model: PipelineModel) -> list[str]:
    for stage in model.stages:
        if isinstance(stage, CountVectorizerModel):
            return list(stage.vocabulary)
        if isinstance(stage, PipelineModel):
            return vocabulary_of(stage)
    raise ValueError("no vectoriser in this model")


def term_array(vocabulary: list[str]) -> Column:
    """The vocabulary as one constant array; terms never hold a line break."""
    return F.split(F.lit("\n".join(vocabulary)), "\n")


def feature_names(df: DataFrame, model: PipelineModel) -> DataFrame:
    """``(idx, term)``; bounded by ``maxFeatures``."""
    terms = list(enumerate(vocabulary_of(model)))
    return df.sparkSession.createDataFrame(terms, "idx int, term string")


def vector_entries(vector_col: str) -> Column:
    """``array<struct<idx, w>>`` of a vector column, without making sparse vectors dense."""
    v = F.unwrap_udt(vector_col)
    size = F.size(v["values"])
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.arrays_zip(F.coalesce(v["indices"], every).alias("idx"), v["values"].alias("w"))


def postings(df: DataFrame, vector_col: str, keep: list[str]) -> DataFrame:
    """Long view ``(keep…, idx, w)`` of a vector column; a row without entries has no posting."""
    long = unnest(df.select(*keep, vector_entries(vector_col).alias("_e")), "_e", "e", keep)
    return long.select(*keep, F.col("e.idx").alias("idx"), F.col("e.w").alias("w"))
