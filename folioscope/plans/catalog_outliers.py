"""Queries for metrics, probability outliers, explanations and reports."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import distance as D
from folioscope.operators import metrics as M
from folioscope.operators import outliers as O
from folioscope.operators.models import melt_coefficients, with_probability_columns
from folioscope.operators.neighbours import neighbour_outliers
from folioscope.plans import sql as Q
from folioscope.plans.catalog_geometry import FLAGGED, MODEL, centroid_model
from folioscope.plans.catalog_text import MAX_FEATURES
from folioscope.plans.registry import Tables, register
from folioscope.session import materialised

# Softmax of cosines over a few languages is flat, so the thresholds of these queries lie closer to its values.
CONFIDENCE = 0.30
GAP = 0.05


def pairs(t: Tables) -> DataFrame:
    """``labels.quality`` as the truth and ``labels.toxic`` as the prediction."""
    return t.labels


@register(
    "a15_confusion_matrix",
    """WITH k AS (SELECT quality::VARCHAR AS c FROM labels UNION SELECT toxic::VARCHAR FROM labels)
    SELECT a.c AS y_true, b.c AS y_pred, (SELECT count(*) FROM labels WHERE quality::VARCHAR = a.c AND toxic::VARCHAR = b.c) AS n
    FROM k a CROSS JOIN k b""",
)
def _(t: Tables) -> DataFrame:
    return M.confusion_matrix(M.confusion_counts(pairs(t), "quality", "toxic"))


REPORT_SQL = """k AS (SELECT y AS label FROM pr UNION SELECT p FROM pr),
per AS (SELECT label, (SELECT count(*) FROM pr WHERE y = label) AS support, (SELECT count(*) FROM pr WHERE p = label) AS guessed,
        (SELECT count(*) FROM pr WHERE y = label AND p = label) AS tp FROM k),
pre AS (SELECT label, support, tp, coalesce(tp / nullif(guessed, 0)::DOUBLE, 0) AS precision,
        coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall FROM per),
rep AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pre)"""


@register(
    "a16_classification_report",
    f"""WITH pr AS (SELECT quality::VARCHAR AS y, toxic::VARCHAR AS p FROM labels), {REPORT_SQL}
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM rep
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM rep
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM rep""",
)
def classification_report(t: Tables) -> DataFrame:
    report = M.classification_report(pairs(t), "quality", "toxic")
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@register(
    "a17_weighted_f1",
    f"""WITH pr AS (SELECT quality::VARCHAR AS y, toxic::VARCHAR AS p FROM labels), {REPORT_SQL}
    SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep""",
)
def _(t: Tables) -> DataFrame:
    return M.weighted_f1(pairs(t), "quality", "toxic").select(F.round("f1_weighted", 6).alias("f1_weighted"))


@register("a18_accuracy", "SELECT round(avg((quality = toxic)::INTEGER), 6) AS accuracy FROM labels")
def _(t: Tables) -> DataFrame:
    return M.accuracy(pairs(t), "quality", "toxic").select(F.round("accuracy", 6).alias("accuracy"))


@register(
    "m1_class_weights",
    """SELECT lang, count(*) AS n, round((SELECT count(*) FROM documents) / ((SELECT count(DISTINCT lang) FROM documents) * count(*))::DOUBLE, 6)
    AS weight FROM documents GROUP BY lang""",
)
def _(t: Tables) -> DataFrame:
    return M.class_weights(t.documents, "lang").withColumn("weight", F.round("weight", 6))


@register(
    "m3_stratified_folds",
    """SELECT lang, f AS fold, (count(*) + 4 - f) // 5 AS n FROM documents CROSS JOIN (SELECT unnest(range(5)) AS f)
    GROUP BY lang, f""",
)
def _(t: Tables) -> DataFrame:
    folds = M.stratified_folds(t.documents, "doc_id", "lang", 5, 42)
    joined = t.documents.select("doc_id", "lang").join(folds, "doc_id")
    return joined.groupBy("lang", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


# -- probabilities ----------------------------------------------------------------------------------------------------


def scored(t: Tables) -> DataFrame:
    return centroid_model(t).scored()


@register(
    "w3_ranked_classes",
    MODEL + " SELECT doc_id, c1 AS first, c2 AS second, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM top",
)
def _(t: Tables) -> DataFrame:
    ranked = scored(t).select("doc_id", O.ranked_classes("proba").alias("r"))
    at = lambda i: F.get("r", F.lit(i))
    return ranked.select(
        "doc_id", at(0)["class"].alias("first"), at(1)["class"].alias("second"),
        *[F.round(at(i)["p"], 6).alias(f"p{i + 1}") for i in range(3)],
    )


@register("p8_probability_columns", MODEL + """ SELECT doc_id, """ + ", ".join(
    f"round(max(CASE WHEN class = '{c}' THEN p END), 6) AS {c}" for c in ("de", "en", "es", "fr")) + " FROM prob GROUP BY doc_id")
def _(t: Tables) -> DataFrame:
    m = centroid_model(t)
    wide = with_probability_columns(m.scored(), m.classes)
    return wide.select("doc_id", *[F.round(c, 6).alias(c) for c in m.classes])


@register("j8_true_class_probability", MODEL + " SELECT doc_id, lang, round(p_true, 6) AS proba_parti_reel FROM top")
def _(t: Tables) -> DataFrame:
    out = O.true_class_probability(scored(t), "lang", "proba")
    return out.select("doc_id", "lang", F.round("proba_parti_reel", 6).alias("proba_parti_reel"))


@register(
    "d6_low_confidence",
    MODEL + f" SELECT doc_id, lang, round(p_true, 6) AS proba_parti_reel, p_true < {CONFIDENCE} AS is_outlier_proba FROM top",
)
def low_confidence(t: Tables) -> DataFrame:
    out = O.low_confidence(scored(t), "lang", "proba", CONFIDENCE)
    return out.select("doc_id", "lang", F.round("proba_parti_reel", 6).alias("proba_parti_reel"), "is_outlier_proba")


@register(
    "d7_hesitation",
    MODEL + f" SELECT doc_id, p1 - p2 < {GAP} AS is_hesitation_2, p1 - p3 < {GAP} AS is_hesitation_3 FROM top",
)
def hesitation(t: Tables) -> DataFrame:
    return O.hesitation(scored(t), "proba", GAP).select("doc_id", "is_hesitation_2", "is_hesitation_3")


@register(
    "d8_predict_within_outliers",
    MODEL + f" SELECT doc_id, c1 AS predicted_label, c1 <> lang AS is_misclassified FROM top WHERE p_true < {CONFIDENCE}",
)
def _(t: Tables) -> DataFrame:
    out = O.low_confidence(scored(t), "lang", "proba", CONFIDENCE).where("is_outlier_proba")
    return out.select(
        "doc_id", "predicted_label", (~F.col("lang").eqNullSafe(F.col("predicted_label"))).alias("is_misclassified")
    )


@register(
    "a13_outlier_report",
    MODEL + f""" SELECT lang, count(*) AS total_outliers, count(*) FILTER (c1 <> lang) AS nb_mal_classes,
    round(100 * count(*) FILTER (c1 <> lang) / count(*)::DOUBLE, 2) AS "proportion_misclassification_%"
    FROM top WHERE p_true < {CONFIDENCE} GROUP BY lang""",
)
def outlier_report(t: Tables) -> DataFrame:
    out = O.low_confidence(scored(t), "lang", "proba", CONFIDENCE).where("is_outlier_proba")
    return O.outlier_report(out, "lang", "predicted_label")


SUMMARY_SQL = "WITH " + Q.class_model(MAX_FEATURES) + FLAGGED.split("dist AS", 1)[1].split("GROUP BY doc_id)", 1)[1] + f""",
xy AS (SELECT doc_id AS id, lang, round(max(CASE WHEN class = 'en' THEN p END), 6) AS x,
       round(max(CASE WHEN class = 'fr' THEN p END), 6) AS y FROM prob GROUP BY doc_id, lang),
near AS (SELECT a.id, a.lang, b.lang AS other, row_number() OVER (PARTITION BY a.id
         ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) AS r FROM xy a CROSS JOIN xy b),
vote AS (SELECT id, lang, other, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, other) AS place
         FROM near WHERE r <= 10 GROUP BY id, lang, other),
geo AS (SELECT id AS doc_id, other <> lang AS odd FROM vote WHERE place = 1),
flags AS (SELECT top.doc_id, top.lang, c1, far, p_true < {CONFIDENCE} AS low, p1 - p2 < {GAP} AS h2, p1 - p3 < {GAP} AS h3, odd
          FROM top JOIN flagged USING (doc_id) JOIN geo USING (doc_id)),
long AS (SELECT 'Centroid (Global)' AS m, far AS f, c1 <> lang AS bad FROM flags
  UNION ALL SELECT 'Probas (Confiance)', low, c1 <> lang FROM flags
  UNION ALL SELECT 'Hésitation (2 partis)', h2, c1 <> lang FROM flags
  UNION ALL SELECT 'Hésitation (3 partis)', h3, c1 <> lang FROM flags
  UNION ALL SELECT 'KNN (Local)', odd, c1 <> lang FROM flags)
SELECT m AS "Méthode", count(*) FILTER (f) AS "Nb Outliers",
  round(coalesce(100 * count(*) FILTER (f AND bad) / nullif(count(*) FILTER (f), 0)::DOUBLE, 0), 2) AS "% Mal Classés"
FROM long GROUP BY m"""


@register("a14_method_summary", SUMMARY_SQL)
def method_summary(t: Tables) -> DataFrame:
    m = centroid_model(t)
    # One stored table of scores feeds every method.
    flagged = O.low_confidence(O.hesitation(materialised(m.scored(), "scored"), "proba", GAP), "lang", "proba", CONFIDENCE)
    flagged = D.centroid_outliers(flagged, "lang", "features", m.size)
    plane = {"x": F.round(F.element_at("proba", F.lit("en")), 6), "y": F.round(F.element_at("proba", F.lit("fr")), 6)}
    flagged = neighbour_outliers(flagged.withColumns(plane), "doc_id", "lang", "x", "y", k=10)
    return O.method_summary(flagged, "lang", "predicted_label")


# -- coefficients and explanations ------------------------------------------------------------------------------------


@register("p6_melt", MODEL + " SELECT class, feature, round(coef, 8) AS coef FROM coef")
def _(t: Tables) -> DataFrame:
    m = centroid_model(t)
    by_term = m.coefficient_table().groupBy("feature").pivot("class", m.classes).agg(F.max("coef"))
    # One column per class; a class that never uses a feature holds null there.
    long = melt_coefficients(by_term, "feature").where(F.col("coef").isNotNull())
    return long.select(F.col("name").alias("class"), "feature", F.round("coef", 8).alias("coef"))


TOP_SQL = """tw AS (SELECT class, feature, coef, row_number() OVER (PARTITION BY class ORDER BY abs(coef) DESC, feature) AS rank
  FROM coef)"""


@register(
    "w1_top_coefficients",
    f"{MODEL}, {TOP_SQL} SELECT class, rank, feature, round(coef, 6) AS coef FROM tw WHERE rank <= 10",
)
def _(t: Tables) -> DataFrame:
    top = O.top_coefficients(centroid_model(t).coefficient_table(), 10)
    return top.withColumns({"rank": F.col("rank").cast("long"), "coef": F.round("coef", 6)})


@register(
    "p7_side_by_side",
    f"{MODEL}, {TOP_SQL} SELECT rank, " + ", ".join(
        f"max(CASE WHEN class = '{c}' THEN feature END) AS \"{c} - mot\", max(CASE WHEN class = '{c}' THEN round(coef, 6) END) AS \"{c} - coef\""
        for c in ("de", "en", "es", "fr")) + " FROM tw WHERE rank <= 10 GROUP BY rank",
)
def _(t: Tables) -> DataFrame:
    m = centroid_model(t)
    top = O.top_coefficients(m.coefficient_table(), 10)
    blocks = O.side_by_side_blocks(top.withColumns({"rank": F.col("rank").cast("long"), "coef": F.round("coef", 6)}), m.classes)
    return functools.reduce(lambda left, right: left.join(right, "rank", "full"), blocks)


EXPLAIN_SQL = """ex AS (SELECT w.doc_id, lang AS class, term AS mot, w.w AS tfidf_val, coef AS poids_coeff, w.w * coef AS contribution,
  row_number() OVER (PARTITION BY w.doc_id ORDER BY w.w * coef DESC, term) AS rank, count(*) OVER (PARTITION BY w.doc_id) AS n
  FROM w JOIN coef ON coef.class = w.lang AND coef.feature = w.term)"""
EXPLAIN_OUT = """SELECT doc_id, class, mot, round(tfidf_val, 6) AS tfidf_val, round(poids_coeff, 6) AS poids_coeff,
  round(contribution, 6) AS contribution FROM ex"""


def explained(t: Tables, ends: int | None, where=None) -> DataFrame:
    m = centroid_model(t)
    docs = m.documents if where is None else m.documents.where(where)
    out = O.explain(docs, "doc_id", "lang", "features", m.rows(), ends)
    numbers = [F.round(c, 6).alias(c) for c in ("tfidf_val", "poids_coeff", "contribution")]
    return out.select("doc_id", "class", "mot", *numbers)


@register("j7_document_contributions", f"{MODEL}, {EXPLAIN_SQL} {EXPLAIN_OUT}")
def document_contributions(t: Tables) -> DataFrame:
    return explained(t, None)


@register("d10_explain_document", f"{MODEL}, {EXPLAIN_SQL} {EXPLAIN_OUT} WHERE doc_id = 3")
def _(t: Tables) -> DataFrame:
    return explained(t, None, F.col("doc_id") == 3)


@register("w7_strongest_for_and_against", f"{MODEL}, {EXPLAIN_SQL} {EXPLAIN_OUT} WHERE rank <= 5 OR rank > n - 5")
def _(t: Tables) -> DataFrame:
    return explained(t, 5)


@register(
    "w2_top_contributions",
    f"""{MODEL}, {EXPLAIN_SQL} SELECT doc_id, string_agg(mot, ', ' ORDER BY rank) AS anchors FROM ex
    WHERE rank <= 5 AND contribution > 0 GROUP BY doc_id""",
)
def _(t: Tables) -> DataFrame:
    from folioscope.operators.vectorize import vector_entries

    m = centroid_model(t)
    joined = m.documents.join(m.rows(), F.col("lang") == F.col("class")).withColumn("e", vector_entries("features"))
    words = O.top_words(O.contributions(F.col("e"), F.col("coefs"), F.col("terms")), 5)
    out = joined.select("doc_id", F.array_join(words, ", ").alias("anchors"))
    return out.where(F.col("anchors") != "")


@register(
    "d9_outlier_dossier",
    f"""{MODEL},
    o AS (SELECT *, CASE WHEN c1 = lang THEN c2 ELSE c1 END AS ch, CASE WHEN c1 = lang THEN p2 ELSE p1 END AS chp FROM top
          WHERE p_true < {CONFIDENCE}),
    con AS (SELECT o.doc_id, coef.class, term, w.w * coef AS v,
            row_number() OVER (PARTITION BY o.doc_id, coef.class ORDER BY w.w * coef DESC, term) AS r
            FROM o JOIN w USING (doc_id) JOIN coef ON coef.feature = w.term AND coef.class IN (o.lang, o.ch)),
    words AS (SELECT doc_id, class, string_agg(term, ', ' ORDER BY r) AS ws FROM con WHERE r <= 5 AND v > 0 GROUP BY doc_id, class)
    SELECT o.doc_id AS "ID", printf('%s (%.1f%%)', o.lang, 100 * p_true) AS "Vrai Parti", c1 AS "Prédit",
      printf('%s (%.1f%%)', ch, 100 * chp) AS "Challenger (2nd)", coalesce(a.ws, '') AS "Mots Ancres (Confirmant)",
      coalesce(b.ws, '') AS "Mots Transfuges (Vers Challenger)",
      CASE WHEN c1 <> o.lang THEN '❌ Erreur' ELSE '✅ Atopique' END AS "Statut"
    FROM o LEFT JOIN words a ON a.doc_id = o.doc_id AND a.class = o.lang
    LEFT JOIN words b ON b.doc_id = o.doc_id AND b.class = o.ch""",
)
def outlier_dossier(t: Tables) -> DataFrame:
    m = centroid_model(t)
    out = O.low_confidence(m.scored(), "lang", "proba", CONFIDENCE).where("is_outlier_proba")
    return O.dossier(out, "doc_id", "lang", "proba", "features", m.rows(), top_n=5)
