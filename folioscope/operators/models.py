"""Class-balanced classifiers, their cross-validation and their tables.

Training is Spark ML; the loops below run over folds and grid points, never over rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    LogisticRegressionModel,
    OneVsRest,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from folioscope.operators.forest import ENDLESS, IN_TASK_BYTES, Forest, grow_forest, search_forest_folds
from folioscope.operators.lexical import filter_rare_words
from folioscope.operators.metrics import classification_report, confusion_counts, stratified_folds
from folioscope.operators.shared_fit import search_text_folds, search_vector_folds, weighted_f1s
from folioscope.operators.vectorize import TfidfVectorizer, term_array, vocabulary_of
from folioscope.session import class_list, materialised

# The three parameter grids.
LOGISTIC_GRID = {"max_features": [1000, 3000, 5000], "ngram_max": [1, 2], "C": [0.1, 1.0, 10.0]}
FOREST_GRID = {
    "n_estimators": [500, 750, 1000],
    "max_depth": [None, 15, 25, 35],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2"],
}
SVM_GRID = {"C": [1.0, 10.0, 50.0, 100.0], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"]}

DEEPEST_TREE = 30


def grid_points(grid: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def side_by_side(search: Callable, settings: Sequence) -> list:
    """``search`` of every setting, each in a thread of its own: the many small jobs of one fill the gaps of another."""
    with ThreadPool(max(1, len(settings))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(search), settings, chunksize=1)


# -- labels and weights -----------------------------------------------------------------------------------------------


def with_label_index(df: DataFrame, label: str, classes: list[str], out_col: str = "label_index") -> DataFrame:
    """Position of the label in the sorted class list, as the double that Spark ML wants."""
    positions = F.create_map(*itertools.chain.from_iterable((F.lit(c), F.lit(float(i))) for i, c in enumerate(classes)))
    return df.withColumn(out_col, F.try_element_at(positions, F.col(label)))


def with_class_name(df: DataFrame, index: str, classes: list[str], out_col: str) -> DataFrame:
    return df.withColumn(out_col, F.get(F.array(*[F.lit(c) for c in classes]), F.col(index).cast("int")))


def balanced(df: DataFrame, label: str, weight_col: str = "weight") -> tuple[DataFrame, float]:
    """Add n / (k * n_class), from the counts of *these* rows, and return the sum of the weights, which is n.

    Rows without a label take no part.
    """
    df = df.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weights = itertools.chain.from_iterable(
        (F.lit(c), F.lit(n / (len(counts) * m))) for c, m in counts.items()
    )
    return df.withColumn(weight_col, F.try_element_at(F.create_map(*weights), F.col(label))), float(n)


def gathered(df: DataFrame, rows: float, per_partition: int = 2_000) -> DataFrame:
    """Fewer, fuller partitions for iterative training on little data.

    Every iteration starts one task per partition. Merging is narrow, and above ``per_partition`` rows per partition
    nothing changes.
    """
    return df.coalesce(max(1, int(np.ceil(rows / per_partition))))


# -- estimators -------------------------------------------------------------------------------------------------------


def fit_logistic(
    train: DataFrame, features: str = "features", label: str = "label_index", C: float = 1.0, max_iter: int = 1000,
    tol: float = 1e-6,
) -> LogisticRegressionModel:
    """Multinomial, L2, balanced. Spark averages the loss, so the penalty is 1 / (C * sum of weights) of this data."""
    weighted, total = balanced(train, label)
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="weight", family="multinomial", elasticNetParam=0.0,
        standardization=False, regParam=1.0 / (C * total), maxIter=max_iter, tol=tol,
    ).fit(gathered(weighted, total))


def fit_forest(
    train: DataFrame, features: str = "features", label: str = "label_index", seed: int = 42, weighted: bool = True,
    n_estimators: int = 100, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1,
    max_features: str = "sqrt", deepest: int = DEEPEST_TREE, row: str | None = None,
) -> Forest:
    """Random forest. Depth stops at ``deepest``; ``row`` numbers the rows for their draws."""
    data = balanced(train, label)[0] if weighted else train.withColumn("weight", F.lit(1.0))
    return grow_forest(
        data, features, label, "weight", seed, n_estimators, min(max_depth or deepest, deepest), min_samples_leaf,
        max_features, min_samples_split, row,
    )


def fit_linear_svm(
    train: DataFrame, features: str = "features", label: str = "label_index", C: float = 1.0, max_iter: int = 100
) -> Model:
    """One hinge-loss machine per class against the rest."""
    weighted, total = balanced(train, label)
    machine = LinearSVC(regParam=1.0 / (C * total), maxIter=max_iter, standardization=False)
    return OneVsRest(
        classifier=machine, featuresCol=features, labelCol=label, weightCol="weight", predictionCol="prediction",
        parallelism=4,
    ).fit(gathered(weighted, total))


def rbf_gamma(df: DataFrame, array_col: str, mode: str = "scale") -> float:
    """``auto``: 1 / d. ``scale``: 1 / (d * variance of all values)."""
    size = F.size(array_col)
    total = lambda f: F.aggregate(F.col(array_col).cast("array<double>"), F.lit(0.0), f)
    row = df.agg(
        F.max(size).alias("d"), F.sum(size).alias("n"),
        F.sum(total(lambda a, x: a + x)).alias("s"), F.sum(total(lambda a, x: a + x * x)).alias("s2"),
    ).first()
    if mode == "auto":
        return 1.0 / row.d
    variance = row.s2 / row.n - (row.s / row.n) ** 2
    return 1.0 / (row.d * variance) if variance > 0 else 1.0


def orthogonal_directions(size: int, n: int, seed: int) -> np.ndarray:
    """``size x n`` directions, orthogonal within each block of ``size``, each as long as a Gaussian vector."""
    draw, blocks = np.random.default_rng(seed), []
    for _ in range(-(-n // size)):
        basis, _ = np.linalg.qr(draw.normal(size=(size, size)))
        blocks.append(basis * np.sqrt(draw.chisquare(size, size)))
    return np.hstack(blocks)[:, :n]


def with_rbf_features(
    df: DataFrame, array_col: str, gamma: float, n_components: int = 256, seed: int = 42, out_col: str = "rbf"
) -> DataFrame:
    """Orthogonal random features of the kernel exp(-gamma |x - y|^2) (Yu et al., 2016), as a vector column.

    Half of the components are cosines, half sines, of the same directions, which are drawn once for all rows. The
    product of two rows is the kernel with an error that falls with ``n_components``; see ``kernel_error``.
    """
    if n_components % 2:
        raise ValueError("n_components must be even")
    known = df.select(F.size(array_col).alias("d")).where("d > 0").first()
    size = known.d if known else 1
    directions = np.sqrt(2 * gamma) * orthogonal_directions(size, n_components // 2, seed)

    @F.pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        turned = np.stack(batch.to_numpy()).astype(float) @ directions
        return pd.Series(list(np.sqrt(2.0 / n_components) * np.hstack([np.cos(turned), np.sin(turned)])))

    return df.withColumn(out_col, array_to_vector(project(F.col(array_col).cast("array<double>"))))


def kernel_error(
    df: DataFrame, key: str, partner: Column, array_col: str, gamma: float, n_components: int = 256
) -> DataFrame:
    """``(n_pairs, mean_kernel, rms_error)``: the kernel against the product of its features, over the pairs of rows
    that the key ``partner`` names, each row having at most one. An equi-join: no other pair is formed."""
    mapped = with_rbf_features(df.select(key, array_col), array_col, gamma, n_components)
    rows = mapped.select(
        F.col(key).alias("k"), partner.alias("p"), F.col(array_col).cast("array<double>").alias("x"),
        vector_to_array("rbf").alias("z"),
    )
    others = rows.select(F.col("k").alias("p"), F.col("x").alias("y"), F.col("z").alias("w"))
    add = lambda a, v: a + v
    apart = F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), add)
    pairs = rows.join(others, "p").select(
        F.exp(-gamma * apart).alias("exact"),
        F.aggregate(F.zip_with("z", "w", lambda a, b: a * b), F.lit(0.0), add).alias("near"),
    )
    error = F.col("exact") - F.col("near")
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.avg("exact").alias("mean_kernel"), F.sqrt(F.avg(error * error)).alias("rms_error")
    )


# -- cross-validation -------------------------------------------------------------------------------------------------


def with_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Join the fold of each key; only keys and labels take part in the ranking."""
    return df.join(stratified_folds(df, key, label, k, seed), key)


def held_out_rows(df: DataFrame, models: Sequence[Model], fold_col: str = "fold") -> DataFrame:
    """Predictions of each row by the model of its fold, which did not see it."""
    parts = [model.transform(df.where(F.col(fold_col) == fold)) for fold, model in enumerate(models)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def out_of_fold(df: DataFrame, k: int, fit: Callable[[DataFrame], Model], fold_col: str = "fold") -> DataFrame:
    """Predictions of each row by the model that did not see its fold."""
    return held_out_rows(df, [fit(df.where(F.col(fold_col) != fold)) for fold in range(k)], fold_col)


def weighted_f1_of(predictions: DataFrame, label: str = "label_index") -> float:
    return MulticlassClassificationEvaluator(metricName="f1", labelCol=label).evaluate(predictions)


def grid_search(
    df: DataFrame, k: int, points: list[dict], fit: Callable[..., Model], label: str = "label_index",
    fold_col: str = "fold",
) -> tuple[dict, float]:
    """Mean weighted F1 over the folds for each point; the first of equal points wins."""
    return grid_models(df, k, points, fit, label, fold_col)[:2]


def grid_models(
    df: DataFrame, k: int, points: list[dict], fit: Callable[..., Model], label: str = "label_index",
    fold_col: str = "fold",
) -> tuple[dict, float, list[Model]]:
    """``grid_search`` with the models of the best point, one per fold, so that none is fitted again."""
    best = None
    for point in points:
        models = [fit(df.where(F.col(fold_col) != f), **point) for f in range(k)]
        scored = [model.transform(df.where(F.col(fold_col) == f)) for f, model in enumerate(models)]
        score = float(np.mean([weighted_f1_of(rows, label) for rows in scored]))
        if best is None or score > best[1]:
            best = point, score, models
    return best


def forest_grid_search(
    df: DataFrame, k: int, grid: dict[str, Sequence] | None = None, features: str = "features",
    label: str = "label_index", fold_col: str = "fold",
) -> tuple[dict, float, DataFrame]:
    """Best point of the forest grid by mean weighted F1, and the out-of-fold predictions of its forests.

    ``df`` is a table that can be read again. All points share their trees while a task can hold the rows; more rows
    are learned from by forests of each point and fold, grown where their rows are, with the same draws.
    """
    points = grid_points(FOREST_GRID if grid is None else grid)
    df = materialised(df.withColumn("row", F.monotonically_increasing_id()), "forest_rows")
    n, most, size = df.agg(F.count("*"), F.max(label), F.max(F.size(vector_to_array(features)))).first()
    if (n or 0) * (size or 0) > IN_TASK_BYTES:
        def fit(part: DataFrame, **point) -> Forest:
            return fit_forest(part, features, label, deepest=ENDLESS, row="row", **point)

        best, score, forests = grid_models(df, k, points, fit, label, fold_col)
        return best, score, held_out_rows(df, forests, fold_col).drop("row", "probability")
    rows = df.select("row", features, F.col(label).alias("label_index"), F.col(fold_col).alias("fold"))
    held_out = search_forest_folds(rows, k, points, features=features)
    judged = held_out.join(rows.select("row", F.col("label_index").cast("int").alias("label")).where("label IS NOT NULL"), "row")
    means = weighted_f1s(judged, k, len(points), int(most) + 1).mean(axis=0)
    best = int(means.argmax())
    given = held_out.select("row", F.get("predicted", F.lit(best)).cast("double").alias("prediction"))
    return points[best], float(means[best]), df.join(given, "row").drop("row")


def svm_grid_search(
    df: DataFrame, array_col: str, k: int, grid: dict[str, Sequence] | None = None, label: str = "label_index",
    fold_col: str = "fold", n_components: int = 256, max_iter: int = 100,
) -> tuple[dict, float]:
    """Best point of the SVM grid by mean weighted F1. Every kernel setting makes one feature column, and
    trains the machines of all its C and folds side by side.

    ``gamma`` has no part in the linear kernel, so that kernel is searched once. The width of the kernel is taken
    from the features alone, never from labels.
    """
    grid = SVM_GRID if grid is None else grid
    settings = [(kernel, gamma) for kernel in grid["kernel"] for gamma in grid["gamma"]]
    settings = list(dict.fromkeys((kernel, None if kernel == "linear" else gamma) for kernel, gamma in settings))
    df = materialised(df.withColumn("row", F.monotonically_increasing_id()), "kernel_rows")
    size, classes = df.agg(F.max(F.size(array_col)), F.max(label)).first()

    def search(setting: tuple[str, str | None]) -> np.ndarray:
        kernel, gamma = setting
        if kernel == "linear":
            data = df.withColumn("features", array_to_vector(F.col(array_col).cast("array<double>")))
        else:
            data = with_rbf_features(df, array_col, rbf_gamma(df, array_col, gamma), n_components, out_col="features")
        data = data.select("row", "features", F.col(label).alias("label_index"), F.col(fold_col).alias("fold"))
        f1, _ = search_vector_folds(
            data, k, int(classes) + 1, size if kernel == "linear" else n_components, grid["C"], "hinge", max_iter
        )
        return f1.mean(axis=0)

    best, best_score = {}, -1.0
    for (kernel, gamma), means in zip(settings, side_by_side(search, settings), strict=True):
        if means.max() > best_score:
            best_score = float(means.max())
            best = {"C": grid["C"][int(means.argmax())], "kernel": kernel, "gamma": gamma}
    return best, best_score


@dataclass
class TextClassifier:
    """Fitted vectoriser and classifier with the class list."""

    vectorizer: PipelineModel
    classifier: LogisticRegressionModel
    classes: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.classifier.transform(self.vectorizer.transform(df))

    @property
    def vocabulary(self) -> list[str]:
        return vocabulary_of(self.vectorizer)


@dataclass
class LogisticJob:
    model: TextClassifier
    best_params: dict
    cv_score: float
    predictions: DataFrame
    report: DataFrame
    confusion: DataFrame
    scores: list[tuple[dict, float]] = field(default_factory=list)


def fit_text_logistic(
    train: DataFrame, tokens: str, classes: list[str], max_features: int, ngram_max: int, C: float,
    max_iter: int = 1000,
) -> TextClassifier:
    """Vocabulary, idf, class weights and penalty all come from ``train`` alone."""
    vectorizer = TfidfVectorizer(inputCol=tokens, maxFeatures=max_features, ngramMax=ngram_max).fit(train)
    vectors = vectorizer.transform(train).select("features", "label_index").persist(StorageLevel.MEMORY_AND_DISK)
    classifier = fit_logistic(vectors, C=C, max_iter=max_iter)
    vectors.unpersist()
    return TextClassifier(vectorizer, classifier, classes)


def logistic_regression_job(
    df: DataFrame, key: str, label: str, tokens: str, min_docs: int | None = None, cv_folds: int = 5,
    random_state: int = 42, grid: dict[str, Sequence] | None = None, max_iter: int = 1000,
) -> LogisticJob:
    """Grid search by stratified folds, refit on all rows, out-of-fold predictions, report and confusion counts.

    The models of all folds, vocabulary sizes and C of an n-gram setting are trained side by side; the held-out rows
    are scored by all of them once, and those scores of the best point are its out-of-fold predictions. ``min_docs``
    first drops words found in fewer documents of the whole corpus.
    """
    grid = LOGISTIC_GRID if grid is None else grid
    classes = class_list(df, label)
    data = with_label_index(df.where(F.col(label).isNotNull()).select(key, label, tokens), label, classes)
    data = materialised(data, "tokens")
    if min_docs is not None:
        kept = filter_rare_words(data, key, tokens, min_docs, tokens)
        data = data.drop(tokens).join(kept, key)
    data = with_folds(data, key, label, cv_folds, random_state)
    data = materialised(data.withColumn("row", F.monotonically_increasing_id()), "folds")
    found = {}

    def search(ngram: int):
        return search_text_folds(data, tokens, cv_folds, len(classes), grid["max_features"], ngram, grid["C"], max_iter)

    for ngram, (points, f1, held_out) in zip(grid["ngram_max"], side_by_side(search, grid["ngram_max"]), strict=True):
        for place, (size, c) in enumerate(points):
            found[size, ngram, c] = float(f1[:, place].mean()), held_out, place
    means = [
        ({"max_features": size, "ngram_max": ngram, "C": c}, found[size, ngram, c][0])
        for size, ngram, c in itertools.product(grid["max_features"], grid["ngram_max"], grid["C"])
    ]
    best, best_score = max(means, key=lambda pair: pair[1])
    _, held_out, place = found[best["max_features"], best["ngram_max"], best["C"]]
    named = held_out.select("row", F.get("predicted", F.lit(place)).alias("prediction"))
    predictions = data.select("row", key, label, "fold").join(named, "row")
    predictions = with_class_name(predictions, "prediction", classes, "predicted_label")
    predictions = predictions.select(key, label, "fold", "predicted_label")
    return LogisticJob(
        fit_text_logistic(data, tokens, classes, max_iter=max_iter, **best), best, best_score, predictions,
        classification_report(predictions, label, "predicted_label"),
        confusion_counts(predictions, label, "predicted_label"), means,
    )


# -- tables of a model ------------------------------------------------------------------------------------------------


def coefficient_matrix(df: DataFrame, model: TextClassifier) -> DataFrame:
    """``(class, values)``: one dense row per class, bounded by classes x vocabulary."""
    matrix = model.classifier.coefficientMatrix.toArray()
    rows = [(c, [float(x) for x in matrix[i]]) for i, c in enumerate(model.classes)]
    return df.sparkSession.createDataFrame(rows, "class string, values array<double>")


def coefficient_table(df: DataFrame, model: TextClassifier) -> DataFrame:
    """Tidy ``(class, feature, coef)``."""
    terms = term_array(model.vocabulary)
    long = coefficient_matrix(df, model).select("class", F.posexplode("values").alias("idx", "coef"))
    return long.select("class", F.get(terms, F.col("idx")).alias("feature"), "coef")


def melt_coefficients(wide: DataFrame, key: str) -> DataFrame:
    """Wide (one column per name) to tidy ``(key, name, coef)``."""
    return wide.unpivot(key, [F.col(f"`{c}`") for c in wide.columns if c != key], "name", "coef")


def model_assets(df: DataFrame, model: TextClassifier) -> dict[str, DataFrame]:
    spark = df.sparkSession
    return {
        "feature_names": spark.createDataFrame(list(enumerate(model.vocabulary)), "idx int, term string"),
        "classes": spark.createDataFrame(list(enumerate(model.classes)), "idx int, class string"),
        "coefs": coefficient_table(df, model),
    }


def with_probability_map(df: DataFrame, classes: list[str], vector_col: str = "probability", out_col: str = "proba") -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return df.withColumn(out_col, F.map_from_arrays(names, vector_to_array(vector_col)))


def with_probability_columns(df: DataFrame, classes: list[str], proba: str = "proba") -> DataFrame:
    """One column per class, for output."""
    return df.withColumns({c: F.element_at(F.col(proba), F.lit(c)) for c in classes})


def score_table(df: DataFrame, model: TextClassifier, label: str) -> DataFrame:
    """Add ``features``, ``predicted_label``, ``is_misclassified`` and the ``proba`` map."""
    scored = with_class_name(model.transform(df), "prediction", model.classes, "predicted_label")
    scored = scored.withColumn("is_misclassified", ~F.col(label).eqNullSafe(F.col("predicted_label")))
    return with_probability_map(scored, model.classes).drop("rawPrediction", "prediction")


def plane_projection(df: DataFrame, vector_col: str = "probability", x: str = "tsne_1", y: str = "tsne_2") -> DataFrame:
    """Two coordinates per document from its class probabilities, by principal components."""
    fitted = PCA(k=2, inputCol=vector_col, outputCol="_plane").fit(df)
    out = fitted.transform(df).withColumn("_xy", vector_to_array("_plane"))
    return out.withColumns({x: F.get("_xy", F.lit(0)), y: F.get("_xy", F.lit(1))}).drop("_plane", "_xy")
