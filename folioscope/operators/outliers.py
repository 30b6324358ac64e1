"""Probability-based outliers, explanations and outlier reports.

Class probabilities are a ``map<string, double>``; coefficients are one dense row per class. Everything about one
document is computed inside its row.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import ratio, with_percent
from folioscope.operators.distance import broadcast_rows
from folioscope.operators.vectorize import term_array, vector_entries
from folioscope.session import measured_broadcast

# Names of the detection methods and of the two states of an outlier.
METHODS = {
    "KNN (Local)": "is_outlier_knn",
    "Centroid (Global)": "is_outlier_centroid",
    "Probas (Confiance)": "is_outlier_proba",
    "Hésitation (2 partis)": "is_hesitation_2",
    "Hésitation (3 partis)": "is_hesitation_3",
}
STATUS_ERROR = "❌ Erreur"
STATUS_ATYPICAL = "✅ Atopique"


# -- probabilities ----------------------------------------------------------------------------------------------------


def ranked_classes(proba: str | Column) -> Column:
    """``array<struct<p, class>>`` by falling probability, ties by class name; sorted inside the row."""
    entries = F.transform(
        F.map_entries(proba), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("class"))
    )
    return F.transform(F.sort_array(entries), lambda e: F.struct((-e["p"]).alias("p"), e["class"].alias("class")))


def status_text(label: Column, predicted: Column) -> Column:
    return F.when(label.eqNullSafe(predicted), F.lit(STATUS_ATYPICAL)).otherwise(F.lit(STATUS_ERROR))


def predicted_class(proba: str | Column) -> Column:
    return F.get(ranked_classes(proba), F.lit(0))["class"]


def true_class_probability(df: DataFrame, label: str, proba: str, out_col: str = "proba_parti_reel") -> DataFrame:
    """Probability of the row's own class; null for a class the model does not know."""
    return df.withColumn(out_col, F.try_element_at(F.col(proba), F.col(label)))


def low_confidence(df: DataFrame, label: str, proba: str, threshold: float = 0.30) -> DataFrame:
    """Add ``proba_parti_reel`` and ``is_outlier_proba``: own class below ``threshold``."""
    out = true_class_probability(df, label, proba)
    return out.withColumn("is_outlier_proba", F.coalesce(F.col("proba_parti_reel") < threshold, F.lit(False)))


def hesitation(df: DataFrame, proba: str, threshold: float = 0.10) -> DataFrame:
    """Add ``is_hesitation_2`` and ``is_hesitation_3``: first and second (third) class closer than ``threshold``."""
    ranked = df.withColumn("_ranked", ranked_classes(proba))

    def gap(i: int) -> Column:
        return F.get("_ranked", F.lit(0))["p"] - F.get("_ranked", F.lit(i))["p"]

    return ranked.withColumns(
        {
            "is_hesitation_2": F.coalesce(gap(1) < threshold, F.lit(False)),
            "is_hesitation_3": F.coalesce(gap(2) < threshold, F.lit(False)),
        }
    ).drop("_ranked")


# -- reports ----------------------------------------------------------------------------------------------------------


def outlier_report(outliers: DataFrame, label: str, predicted: str) -> DataFrame:
    """Outliers and misclassified ones per class, in percent with two decimals."""
    wrong = F.count_if(~F.col(label).eqNullSafe(F.col(predicted)))
    counted = outliers.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count("*").alias("total_outliers"), wrong.alias("nb_mal_classes")
    )
    share = F.round(ratio(F.col("nb_mal_classes"), F.col("total_outliers")) * 100, 2)
    return counted.withColumn("proportion_misclassification_%", share).orderBy(F.desc("total_outliers"), label)


def method_summary(
    scored: DataFrame, label: str, predicted: str, methods: Mapping[str, str | None] = METHODS
) -> DataFrame:
    """Per method: number of outliers and percentage misclassified; 0 and 0.0 for a method without outliers.

    Methods are flag columns of one scored table (None: not run), so the table is read once for all of them.
    """
    wrong = ~F.col(label).eqNullSafe(F.col(predicted))
    measures = []
    for i, flag in enumerate(methods.values()):
        on = F.lit(False) if flag is None else F.coalesce(F.col(flag), F.lit(False))
        measures += [F.count_if(on).alias(f"_n{i}"), F.count_if(on & wrong).alias(f"_e{i}")]
    totals = scored.agg(*measures)
    rows = [
        F.struct(
            F.lit(name).alias("Méthode"),
            F.col(f"_n{i}").alias("Nb Outliers"),
            F.round(F.coalesce(ratio(F.col(f"_e{i}"), F.col(f"_n{i}")) * 100, F.lit(0.0)), 2).alias("% Mal Classés"),
        )
        for i, name in enumerate(methods)
    ]
    return totals.select(F.inline(F.array(*rows)))


# -- explanations -----------------------------------------------------------------------------------------------------


def coefficient_rows(coefficients: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``(class, coefs, terms)``: one dense row per class from ``(class, idx, coef)`` or ``(class, values)``."""
    terms = term_array(vocabulary)
    rows = measured_broadcast(coefficients.select("class", "values"), broadcast_rows(2 * max(1, len(vocabulary))))
    return rows.select("class", F.col("values").alias("coefs"), terms.alias("terms"))


def contributions(entries: Column, coefs: Column, terms: Column) -> Column:
    """``array<struct<rank_key, mot, tfidf_val, poids_coeff, contribution>>``, strongest support first, ties by word."""

    def one(e):
        weight = F.get(coefs, e["idx"])
        return F.struct(
            (-e["w"] * weight).alias("rank_key"),
            F.get(terms, e["idx"]).alias("mot"),
            e["w"].alias("tfidf_val"),
            weight.alias("poids_coeff"),
            (e["w"] * weight).alias("contribution"),
        )

    return F.sort_array(F.transform(F.filter(entries, lambda e: e["w"] > 0), one))


def explain(df: DataFrame, key: str, target: str, vector_col: str, rows: DataFrame, ends: int | None = None) -> DataFrame:
    """``(key, class, rank, mot, tfidf_val, poids_coeff, contribution)`` for the class named in ``target``.

    ``ends`` keeps the strongest words for and against. All documents at once, or one after a filter on the key. A
    document whose class the model does not know keeps one row, without a word.
    """
    named = rows.withColumnRenamed("class", "_class")
    joined = df.join(named, F.col(target) == F.col("_class"), "left").withColumn("_entries", vector_entries(vector_col))
    known = F.col("_class").isNotNull()
    words = F.when(known, contributions(F.col("_entries"), F.col("coefs"), F.col("terms")))
    listed = joined.select(key, F.col(target).alias("class"), known.alias("_known"), words.alias("_words"))
    long = listed.select(
        key, "class", "_known", F.size("_words").alias("_n"), F.posexplode_outer("_words").alias("_pos", "_w")
    )
    long = long.where(~F.col("_known") | F.col("_w").isNotNull())
    if ends is not None:
        long = long.where(~F.col("_known") | (F.col("_pos") < ends) | (F.col("_pos") >= F.col("_n") - ends))
    return long.select(
        key, "class", (F.col("_pos") + 1).alias("rank"), "_w.mot", "_w.tfidf_val", "_w.poids_coeff", "_w.contribution"
    )


def top_words(words: Column, n: int) -> Column:
    """Names of the first ``n`` words that contribute more than zero."""
    return F.transform(F.filter(F.slice(words, 1, n), lambda w: w["contribution"] > 0), lambda w: w["mot"])


def dossier(
    df: DataFrame, key: str, label: str, proba: str, vector_col: str, rows: DataFrame, top_n: int = 5,
    max_rows: int | None = None,
) -> DataFrame:
    """One line per outlier: true class and its probability, prediction, challenger, anchor and defector words, status.

    The challenger is the second class if the model is right and the first if it is wrong. A class that the model does
    not know has no anchor words, a model of one class no challenger; the document keeps its line. ``max_rows`` keeps
    the first documents by key, as a display limit.
    """
    if max_rows is not None:
        df = df.orderBy(key).limit(max_rows)
    ranked = df.withColumns({"_ranked": ranked_classes(proba), "_entries": vector_entries(vector_col)})
    first = F.get("_ranked", F.lit(0))
    second = F.get("_ranked", F.lit(1))
    ranked = ranked.withColumn("_predicted", first["class"]).withColumn(
        "_challenger", F.when(F.col("_predicted") == F.col(label), second).otherwise(first)
    )
    own = rows.select(F.col("class").alias("_own"), F.col("coefs").alias("_own_coefs"), F.col("terms").alias("_terms"))
    other = rows.select(
        F.col("class").alias("_other"), F.col("coefs").alias("_other_coefs"), F.col("terms").alias("_other_terms")
    )
    joined = ranked.join(own, F.col(label) == F.col("_own"), "left").join(
        other, F.col("_challenger.class") == F.col("_other"), "left"
    )
    anchors = contributions(F.col("_entries"), F.col("_own_coefs"), F.col("_terms"))
    defectors = contributions(F.col("_entries"), F.col("_other_coefs"), F.col("_other_terms"))

    def shown(name, p):
        return F.when(p.isNull(), name).otherwise(with_percent(name, p))

    return joined.select(
        F.col(key).alias("ID"),
        shown(F.col(label), F.try_element_at(F.col(proba), F.col(label))).alias("Vrai Parti"),
        F.col("_predicted").alias("Prédit"),
        shown(F.col("_challenger.class"), F.col("_challenger.p")).alias("Challenger (2nd)"),
        F.array_join(top_words(anchors, top_n), ", ").alias("Mots Ancres (Confirmant)"),
        F.array_join(top_words(defectors, top_n), ", ").alias("Mots Transfuges (Vers Challenger)"),
        status_text(F.col(label), F.col("_predicted")).alias("Statut"),
    )


# -- coefficients -----------------------------------------------------------------------------------------------------


def top_coefficients(coefficients: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` coefficients of largest size per class, with their sign; ties by feature."""
    order = Window.partitionBy("class").orderBy(F.desc(F.abs("coef")), "feature")
    ranked = coefficients.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.select("class", "rank", "feature", "coef")


def side_by_side(top: DataFrame, classes: list[str]) -> DataFrame:
    """One line per rank with a word and a coefficient column for each of a block of classes."""
    wide = top.where(F.col("class").isin(classes)).groupBy("rank").pivot("class", classes).agg(
        F.max("feature").alias("mot"), F.max("coef").alias("coef")
    )
    renamed = [F.col("rank")]
    for c in classes:
        renamed += [F.col(f"`{c}_mot`").alias(f"{c} - mot"), F.col(f"`{c}_coef`").alias(f"{c} - coef")]
    return wide.select(renamed)


def side_by_side_blocks(top: DataFrame, classes: list[str], n_cols: int = 3) -> list[DataFrame]:
    """All classes, ``n_cols`` of them to a table."""
    return [side_by_side(top, classes[i : i + n_cols]) for i in range(0, len(classes), n_cols)]
