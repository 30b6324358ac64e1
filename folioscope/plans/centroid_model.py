"""A classifier that both engines can compute: class centroids of TF-IDF as coefficients.

Its probabilities are the softmax of the cosines to the centroids. It stands in for a trained model wherever a query
is checked against SQL; the operators it feeds take real model output in the same form.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.distance import class_sums, dense_rows
from folioscope.operators.outliers import coefficient_rows, predicted_class
from folioscope.operators.vectorize import TfidfVectorizer, postings, term_array, vector_entries, vocabulary_of
from folioscope.session import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, class_list, materialised, measured_broadcast


@dataclass
class CentroidModel:
    documents: DataFrame
    vocabulary: list[str]
    classes: list[str]
    sums: DataFrame
    key: str
    label: str

    @property
    def size(self) -> int:
        return len(self.vocabulary)

    def long_coefficients(self) -> DataFrame:
        """``(class, idx, coef)``: the mean vector of each class."""
        n = self.documents.groupBy(self.label).agg(F.count("*").alias("n"))
        return self.sums.join(measured_broadcast(n), self.label).select(
            F.col(self.label).alias("class"), "idx", (F.col("w") / F.col("n")).alias("coef")
        )

    def coefficient_table(self) -> DataFrame:
        """``(class, feature, coef)``."""
        terms = term_array(self.vocabulary)
        return self.long_coefficients().select("class", F.get(terms, F.col("idx")).alias("feature"), "coef")

    def rows(self) -> DataFrame:
        """``(class, coefs, terms)`` for the explanation operators."""
        return coefficient_rows(dense_rows(self.long_coefficients(), "class", self.size, "coef"), self.vocabulary)

    def scored(self) -> DataFrame:
        """Documents with ``features``, the ``proba`` map and ``predicted_label``.

        The dense unit vectors of all classes are classes x vocabulary numbers. While these are few, they are sent to
        the tasks and a document's cosines are taken inside its own row, without an exchange.
        """
        small = len(self.classes) * self.size <= MAX_BROADCAST_BYTES // 8
        joined = self.with_cosines() if small else self.with_cosines_by_join()
        powers = F.transform(names_of(self.classes), lambda c: F.exp(F.coalesce(F.try_element_at("_cosines", c), F.lit(0.0))))
        joined = joined.withColumn("_powers", powers)
        total = F.aggregate("_powers", F.lit(0.0), lambda a, x: a + x)
        shares = F.transform("_powers", lambda x: x / F.col("_total"))
        out = joined.withColumn("_total", total).withColumn("proba", F.map_from_arrays(names_of(self.classes), shares))
        return out.drop("_powers", "_total", "_cosines").withColumn("predicted_label", predicted_class("proba"))

    def with_cosines(self) -> DataFrame:
        """Add ``_cosines``, a map from class to the cosine with its centroid. The unit vectors of the classes are sent
        to the tasks once, and the entries of a batch of documents are weighed together."""
        rows = dense_rows(self.sums, self.label, self.size)
        norm = F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x))
        rows = rows.withColumn("_norm", norm).withColumn(
            "values", F.transform("values", lambda x: F.coalesce(F.try_divide(x, F.col("_norm")), F.lit(0.0)))
        )
        units = {r[0]: np.array(r[1]) for r in rows.select(self.label, "values").collect()}

        @F.arrow_udf("array<double>")
        def weighed(idx: pa.Array, w: pa.Array) -> pa.Array:
            sizes = pc.fill_null(pc.list_value_length(idx), 0).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            at, weight = idx.flatten().to_numpy(), w.flatten().to_numpy()
            sums = [np.bincount(row, weight * unit[at], len(sizes)) for unit in units.values()]
            ends = np.arange(len(sizes) + 1, dtype=np.int32) * len(units)
            return pa.ListArray.from_arrays(ends, np.ravel(sums, order="F") if sums else pa.array([], pa.float64()))

        entries = vector_entries("features")
        names = names_of(list(units)).cast(T.ArrayType(self.documents.schema[self.label].dataType))
        return self.documents.withColumn(
            "_cosines", F.map_from_arrays(names, weighed(entries["idx"], entries["w"]))
        )

    def with_cosines_by_join(self) -> DataFrame:
        """The same for a matrix too large for one row: each posting meets the weights of its term."""
        by_class = Window.partitionBy(self.label)
        unit = self.sums.withColumn("u", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_class)))
        weights = unit.groupBy("idx").agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(self.label), F.col("u")))).alias("m")
        )
        weights = measured_broadcast(weights, min(MAX_BROADCAST_ROWS, 2_000_000 // max(1, len(self.classes))))
        long = postings(self.documents, "features", [self.key]).join(weights, "idx")
        long = long.select(self.key, "w", F.explode("m").alias("name", "u"))
        cosines = long.groupBy(self.key, "name").agg(F.sum(F.col("w") * F.col("u")).alias("cosine"))
        maps = cosines.groupBy(self.key).agg(
            F.map_from_entries(F.collect_list(F.struct("name", "cosine"))).alias("_cosines")
        )
        return self.documents.join(maps, self.key, "left")


def names_of(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def fit_centroid_model(docs: DataFrame, key: str, label: str, tokens: str, max_features: int) -> CentroidModel:
    """``docs`` holds key, label and tokens. Tokens and vectors are written once: cleaning text is the dear step."""
    docs = materialised(docs, "tokens")
    model = TfidfVectorizer(inputCol=tokens, maxFeatures=max_features).fit(docs)
    vectors = materialised(model.transform(docs).drop(tokens), "vectors")
    return CentroidModel(
        vectors, vocabulary_of(model), class_list(docs, label), class_sums(vectors, label, "features"), key, label
    )
