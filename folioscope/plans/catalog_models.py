"""Queries that train. SQL can only say which vocabulary they learn; unit tests check the rest in other ways."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import models as M
from folioscope.operators.embed import embed_texts
from folioscope.operators.metrics import accuracy, classification_report
from folioscope.operators.shared_fit import search_vector_folds
from folioscope.operators.vectorize import TfidfVectorizer
from folioscope.plans.catalog_text import FEATURE_NAMES_SQL, MAX_FEATURES, tokens
from folioscope.plans.outlier_study import flagged_table, master_table
from folioscope.plans.registry import Tables, register
from folioscope.session import class_list, materialised


def fitted(t: Tables):
    docs, classes = materialised(tokens(t), "tokens"), class_list(t.documents, "lang")
    return docs, M.fit_text_logistic(M.with_label_index(docs, "lang", classes), "tokens", classes, MAX_FEATURES, 1, 1.0)


def vectors(t: Tables) -> tuple[DataFrame, list[str]]:
    """The given embeddings as ML vectors, with the index of their label."""
    named = t.embeddings.withColumn("name", F.col("label").cast("string"))
    classes = class_list(named, "name")
    ready = named.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return M.with_label_index(ready, "name", classes).select("vec_id", "name", "embedding", "features", "label_index"), classes


@register("m2_logistic_regression")
def logistic_regression(t: Tables) -> DataFrame:
    docs, model = fitted(t)
    return M.score_table(docs, model, "lang").select("doc_id", "lang", "predicted_label")


@register("m4_grid_search")
def grid_search(t: Tables) -> DataFrame:
    job = M.logistic_regression_job(tokens(t), "doc_id", "lang", "tokens")
    rows = [(p["max_features"], p["ngram_max"], p["C"], s) for p, s in job.scores]
    return t.spark.createDataFrame(rows, "max_features int, ngram_max int, C double, f1 double")


@register("m5_out_of_fold")
def out_of_fold(t: Tables) -> DataFrame:
    data, classes = vectors(t)
    folded = M.with_folds(data, "vec_id", "name", 5).persist()
    out = M.out_of_fold(folded, 5, lambda part: M.fit_logistic(part, C=1.0))
    return M.with_class_name(out, "prediction", classes, "predicted_label").select("vec_id", "name", "fold", "predicted_label")


@register("m6_logistic_job")
def logistic_job(t: Tables) -> DataFrame:
    return M.logistic_regression_job(tokens(t), "doc_id", "lang", "tokens").report


@register("m7_model_assets", FEATURE_NAMES_SQL)
def _(t: Tables) -> DataFrame:
    docs, model = fitted(t)
    return M.model_assets(docs, model)["feature_names"]


@register("m8_coefficient_table")
def _(t: Tables) -> DataFrame:
    docs, model = fitted(t)
    return M.coefficient_table(docs, model)


@register("m9_score_table")
def _(t: Tables) -> DataFrame:
    docs, model = fitted(t)
    return M.score_table(docs, model, "lang").select("doc_id", "lang", "predicted_label", "is_misclassified", "proba")


@register("v7_plane_projection")
def _(t: Tables) -> DataFrame:
    docs, model = fitted(t)
    return M.plane_projection(M.score_table(docs, model, "lang")).select("doc_id", "tsne_1", "tsne_2")


@register("m10_master_table")
def master(t: Tables) -> DataFrame:
    docs, model = fitted(t)
    return master_table(docs, model, "lang").select(
        "doc_id", "lang", "predicted_label", "is_misclassified", "tsne_1", "tsne_2", "distance_to_centroid"
    )


@register("outlier_study")
def outlier_study(t: Tables) -> DataFrame:
    docs, model = fitted(t)
    table = master_table(docs, model, "lang")
    flags = ["is_outlier_centroid", "is_outlier_knn", "is_outlier_proba", "is_hesitation_2", "is_hesitation_3"]
    return flagged_table(table, "doc_id", "lang", len(model.vocabulary)).select("doc_id", "lang", "predicted_label", *flags)


@register("m11_random_forest")
def random_forest(t: Tables) -> DataFrame:
    data, classes = vectors(t)
    _, _, out = M.forest_grid_search(M.with_folds(data, "vec_id", "name", 5), 5)
    return classification_report(M.with_class_name(out, "prediction", classes, "predicted"), "name", "predicted")


@register("m12_linear_svm")
def _(t: Tables) -> DataFrame:
    docs = materialised(M.with_label_index(tokens(t), "lang", class_list(t.documents, "lang")), "tokens")
    ready = TfidfVectorizer(maxFeatures=MAX_FEATURES).fit(docs).transform(docs).drop("tokens")
    ready = M.with_folds(ready.where("label_index IS NOT NULL"), "doc_id", "lang", 5)
    ready = materialised(ready.withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = class_list(t.documents, "lang")
    strengths = M.SVM_GRID["C"]
    f1, held_out = search_vector_folds(ready, 5, len(classes), MAX_FEATURES, strengths)
    best = int(f1.mean(axis=0).argmax())
    out = held_out.select("row", F.get("predicted", F.lit(best)).alias("prediction")).join(ready, "row")
    out = M.with_class_name(out, "prediction", classes, "predicted_label")
    return out.select("doc_id", "lang", "fold", F.lit(strengths[best]).alias("C"), "predicted_label")


@register("m13_rbf_kernel")
def _(t: Tables) -> DataFrame:
    data, classes = vectors(t)
    gamma = M.rbf_gamma(data, "embedding", "scale")
    mapped = M.with_rbf_features(data, "embedding", gamma).drop("features").withColumnRenamed("rbf", "features").persist()
    out = M.fit_linear_svm(mapped, C=1.0).transform(mapped)
    return M.with_class_name(out, "prediction", classes, "predicted").select("vec_id", "name", "predicted")


@register(
    "m13_kernel_error",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    g AS (SELECT 1 / (max(d) * var_pop(x)) AS gamma FROM (SELECT unnest(x) AS x, len(x) AS d FROM v)),
    k AS (SELECT exp(-gamma * list_distance(a.x, b.x) ^ 2) AS exact FROM v a JOIN v b ON b.vec_id = xor(a.vec_id, 1), g)
    SELECT count(*) AS n_pairs, round(avg(exact), 6) AS mean_kernel, true AS within_tenth FROM k""",
)
def _(t: Tables) -> DataFrame:
    data = t.embeddings.select("vec_id", "embedding")
    partner = F.col("vec_id").bitwiseXOR(F.lit(1).cast("long"))
    error = M.kernel_error(data, "vec_id", partner, "embedding", M.rbf_gamma(data, "embedding", "scale"))
    return error.select(
        "n_pairs", F.round("mean_kernel", 6).alias("mean_kernel"), (F.col("rms_error") < 0.1).alias("within_tenth")
    )


@register("m13_svm_grid")
def _(t: Tables) -> DataFrame:
    data, _ = vectors(t)
    folded = materialised(M.with_folds(data.drop("features"), "vec_id", "name", 5), "folds")
    best, score = M.svm_grid_search(folded, "embedding", 5)
    row = (best["kernel"], best["gamma"], best["C"], score)
    return t.spark.createDataFrame([row], "kernel string, gamma string, C double, f1 double")


@register("m14_hold_out_forest")
def _(t: Tables) -> DataFrame:
    data, _ = vectors(t)
    # By a hash of the key, so the split doesn't depend on how the rows are dealt out.
    data = data.withColumn("held_out", F.pmod(F.xxhash64("vec_id", F.lit(42)), F.lit(5)) == 0)
    out = M.fit_forest(data.where(~F.col("held_out")), weighted=False).transform(data.where("held_out"))
    return accuracy(out, "label_index", "prediction")


def hashing_encoder(width: int = 32):
    """A stand-in encoder: signed counts of hashed words, scaled to unit length."""
    crc = zlib.crc32

    def load():
        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), width), dtype=np.float32)
            for i, text in enumerate(texts):
                for word in str(text).split():
                    code = crc(word.encode("utf-8"))
                    out[i, code % width] += 1.0 if code & 0x10000 else -1.0
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norms == 0, 1.0, norms)

        return encode

    return load


@register("v6_text_embedding")
def text_embedding(t: Tables) -> DataFrame:
    return embed_texts(t.texts.select("doc_id", "text"), "text", hashing_encoder()).select("doc_id", "embedding")


@register("m15_score_raw_text")
def _(t: Tables) -> DataFrame:
    classes = class_list(t.documents, "lang")
    embedded = embed_texts(t.texts.select("doc_id", "lang", "text"), "text", hashing_encoder()).drop("text")
    ready = embedded.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    ready = materialised(M.with_label_index(ready, "lang", classes).drop("embedding"), "embedded")
    model = M.fit_forest(ready)
    scored = model.transform(ready).withColumn("p", vector_to_array("probability"))
    return scored.select("doc_id", "lang", *[F.get("p", F.lit(i)).alias(f"p_{c}") for i, c in enumerate(classes)])
