"""Vectoriser, metrics, folds and classifiers."""

import collections

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from folioscope.operators import metrics as E
from folioscope.operators import models as M
from folioscope.operators import outliers as O
from folioscope.operators.vectorize import TfidfVectorizer, postings, vocabulary_of
from folioscope.plans.catalog_models import hashing_encoder
from folioscope.plans.outlier_study import flagged_table, master_table

WORDS = {"a": "terre soleil plage mer sable".split(), "b": "usine travail salaire mer grève".split(), "c": "loi ordre police état terre".split()}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(90):
        label = "aaabbc"[i % 6]
        rows.append((i, label, [str(w) for w in rng.choice(WORDS[label] + WORDS["a"][:2], size=12)]))
    return spark.createDataFrame(rows, "id int, label string, tokens array<string>").cache()


def test_tfidf_formula_and_saved_model(spark, corpus, tmp_path):
    docs = {r.id: collections.Counter(r.tokens) for r in corpus.collect()}
    totals, df = collections.Counter(), collections.Counter()
    for c in docs.values():
        totals.update(c)
        df.update(c.keys())
    kept = sorted(totals, key=lambda w: (-totals[w], w))[:8]
    model = TfidfVectorizer(maxFeatures=8).fit(corpus)
    assert vocabulary_of(model) == kept
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    long = collections.defaultdict(dict)
    for r in postings(again.transform(corpus), "features", ["id"]).collect():
        long[r.id][kept[r.idx]] = r.w
    for i, c in docs.items():
        raw = {w: c[w] * (np.log((1 + len(docs)) / (1 + df[w])) + 1) for w in c if w in kept}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        assert long[i] == pytest.approx({w: v / norm for w, v in raw.items()})


def test_bigrams_and_empty_documents(spark):
    frame = spark.createDataFrame([(1, ["x", "y", "x"]), (2, []), (3, ["x"])], "id int, tokens array<string>")
    model = TfidfVectorizer(maxFeatures=10, ngramMax=2).fit(frame)
    assert vocabulary_of(model) == ["x", "x y", "y", "y x"]
    out = {r.id: r.features for r in model.transform(frame).collect()}
    assert out[2].numNonzeros() == 0 and model.transform(frame).columns == ["id", "tokens", "features"]
    with pytest.raises(ValueError):
        TfidfVectorizer().fit(frame.where("id = 2"))


def test_report_with_a_class_never_predicted(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")] + [("a", "d")]
    frame = spark.createDataFrame(rows, "y string, p string")
    report = {r.label: r for r in E.classification_report(frame, "y", "p").collect()}
    assert report["c"].precision == 0 and report["c"].f1 == 0 and report["d"].support == 0
    assert report["a"].precision == pytest.approx(5 / 6) and report["a"].recall == pytest.approx(5 / 8)
    assert report["accuracy"].f1 == pytest.approx(8 / 12) and report["macro avg"].support == 12
    f1 = {c: report[c].f1 for c in "abcd"}
    assert report["weighted avg"].f1 == pytest.approx((8 * f1["a"] + 3 * f1["b"]) / 12)
    counts = E.confusion_counts(frame, "y", "p")
    matrix = {(r.y_true, r.y_pred): r.n for r in E.confusion_matrix(counts, list("abcd")).collect()}
    assert len(matrix) == 16 and sum(matrix.values()) == 12 and matrix["d", "a"] == 0


def test_folds_are_stratified_and_complete(spark):
    frame = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 703, "tiny").otherwise("mid").alias("label"))
    folds = E.stratified_folds(frame, "id", "label", 5, bucket_bits=4)
    joined = frame.join(folds, "id").collect()
    assert len(joined) == 1000
    per = collections.Counter((r.label, r.fold) for r in joined)
    for label, n in (("hot", 700), ("tiny", 3), ("mid", 297)):
        sizes = [per[label, f] for f in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_logistic_gradient_vanishes(spark, corpus):
    classes = ["a", "b", "c"]
    data = M.with_label_index(corpus, "label", classes)
    data = TfidfVectorizer(maxFeatures=50).fit(data).transform(data)
    strength = 1.0
    model = M.fit_logistic(data, C=strength, tol=1e-12)
    rows = data.select("features", "label_index").collect()
    x = np.array([r.features.toArray() for r in rows])
    y = np.array([int(r.label_index) for r in rows])
    n = np.bincount(y)
    weight = len(y) / (3 * n[y])
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    error = (p - np.eye(3)[y]) * weight[:, None]
    assert np.abs(strength * error.T @ x + w).max() < 1e-4
    assert np.abs(error.sum(axis=0)).max() < 1e-3


def test_logistic_job_covers_every_document(spark, corpus):
    grid = {"max_features": [10], "ngram_max": [1], "C": [0.1, 10.0]}
    job = M.logistic_regression_job(corpus, "id", "label", "tokens", cv_folds=3, grid=grid, max_iter=20)
    assert sorted(r.id for r in job.predictions.collect()) == list(range(90))
    assert len(job.scores) == 2 and job.cv_score == max(s for _, s in job.scores) and job.cv_score > 0.5
    assert job.confusion.agg(F.sum("n")).first()[0] == 90
    assert {r.label for r in job.report.collect()} == {"a", "b", "c", "accuracy", "macro avg", "weighted avg"}
    coefs = M.coefficient_table(corpus, job.model)
    assert coefs.count() == 3 * 10 and set(M.model_assets(corpus, job.model)) == {"feature_names", "classes", "coefs"}
    top = O.top_coefficients(coefs, 2)
    assert top.count() == 6 and O.side_by_side(top, ["a", "b"]).columns == ["rank", "a - mot", "a - coef", "b - mot", "b - coef"]
    table = master_table(corpus.select("id", "label", "tokens"), job.model, "label")
    flagged = flagged_table(table, "id", "label", 10)
    rows = flagged.collect()
    assert len(rows) == 90 and all(abs(sum(r.proba.values()) - 1) < 1e-9 for r in rows)
    assert all(r.is_hesitation_2 for r in rows if r.is_hesitation_3)
    summary = {r["Méthode"]: r["Nb Outliers"] for r in O.method_summary(flagged, "label", "predicted_label").collect()}
    assert summary["Probas (Confiance)"] == sum(r.is_outlier_proba for r in rows) and len(summary) == 5


def test_rare_words_are_dropped_before_training(spark, corpus):
    grid = {"max_features": [50], "ngram_max": [1], "C": [1.0]}
    job = M.logistic_regression_job(corpus, "id", "label", "tokens", min_docs=15, cv_folds=2, grid=grid, max_iter=5)
    frequent = {
        r.w for r in corpus.select("id", F.explode(F.array_distinct("tokens")).alias("w")).groupBy("w").count().where("count >= 15").collect()
    }
    assert set(job.model.vocabulary) == frequent


def test_svm_grid_prefers_the_kernel_that_fits(spark):
    rng = np.random.default_rng(5)
    angle = rng.uniform(0, 2 * np.pi, 120)
    radius = np.where(np.arange(120) % 2 == 0, 0.3, 2.0)
    rows = [(i, [float(radius[i] * np.cos(angle[i])), float(radius[i] * np.sin(angle[i]))], float(i % 2), i // 2 % 2) for i in range(120)]
    frame = spark.createDataFrame(rows, "id int, x array<double>, label_index double, fold int")
    grid = {"C": [10.0], "kernel": ["linear", "rbf"], "gamma": ["scale"]}
    best, score = M.svm_grid_search(frame, "x", 2, grid, n_components=64, max_iter=30)
    assert best["kernel"] == "rbf" and score > 0.95


def test_grids():
    assert len(M.grid_points(M.LOGISTIC_GRID)) == 18
    assert len(M.grid_points(M.FOREST_GRID)) == 216
    assert len(M.grid_points(M.SVM_GRID)) == 16


def test_rbf_features_approximate_the_kernel(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(12, 3))
    frame = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id int, x array<double>")
    gamma = M.rbf_gamma(frame, "x")
    assert gamma == pytest.approx(1 / (3 * points.var())) and M.rbf_gamma(frame, "x", "auto") == pytest.approx(1 / 3)
    mapped = {r.id: r.rbf.toArray() for r in M.with_rbf_features(frame, "x", gamma, 4000).collect()}
    for i in range(12):
        for j in range(i):
            exact = np.exp(-gamma * np.sum((points[i] - points[j]) ** 2))
            assert mapped[i] @ mapped[j] == pytest.approx(exact, abs=0.08)


def test_orthogonal_features_are_closer_than_independent_ones(spark):
    block = M.orthogonal_directions(8, 20, 1)
    assert block.shape == (8, 20)
    across = block[:, :8].T @ block[:, :8]
    assert np.abs(across - np.diag(np.diag(across))).max() < 1e-9
    rng = np.random.default_rng(4)
    points = rng.normal(size=(60, 8))
    frame = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id int, x array<double>")
    row = M.kernel_error(frame, "id", F.col("id").bitwiseXOR(F.lit(1)), "x", 0.1, 128).first()
    exact = [np.exp(-0.1 * np.sum((points[i] - points[i ^ 1]) ** 2)) for i in range(60)]
    assert row.n_pairs == 60 and row.mean_kernel == pytest.approx(np.mean(exact))

    def independent(seed):
        draw = np.random.default_rng(seed)
        turned = points @ (draw.normal(size=(8, 128)) * np.sqrt(0.2)) + draw.uniform(0, 2 * np.pi, 128)
        z = np.sqrt(2 / 128) * np.cos(turned)
        return np.sqrt(np.mean([(z[i] @ z[i ^ 1] - exact[i]) ** 2 for i in range(60)]))

    assert row.rms_error < np.mean([independent(s) for s in range(20)])
    with pytest.raises(ValueError, match="even"):
        M.with_rbf_features(frame, "x", 0.1, 7)


def test_embedding_encodes_whole_texts(spark):
    from folioscope.operators.embed import embed_texts

    frame = spark.createDataFrame([(1, "mot " * 1000 + "fin"), (2, "mot " * 1000 + "autre"), (3, None)], "id int, t string")
    out = {r.id: r.embedding for r in embed_texts(frame, "t", hashing_encoder(64)).collect()}
    assert len(out[1]) == 64 and out[1] != out[2] and out[3] == [0.0] * 64


def test_probability_outliers_and_dossier(spark):
    rows = [(1, "a", {"a": 0.5, "b": 0.4, "c": 0.1}), (2, "b", {"a": 0.4, "b": 0.4, "c": 0.2}), (3, "z", {"a": 0.4, "b": 0.3, "c": 0.3})]
    frame = spark.createDataFrame(rows, "id int, label string, proba map<string,double>")
    ranked = {r.id: r.c for r in frame.select("id", O.predicted_class("proba").alias("c")).collect()}
    assert ranked == {1: "a", 2: "a", 3: "a"}
    low = {r.id: (r.proba_parti_reel, r.is_outlier_proba) for r in O.low_confidence(frame, "label", "proba", 0.45).collect()}
    assert low == {1: (0.5, False), 2: (0.4, True), 3: (None, False)}
    gaps = {r.id: (r.is_hesitation_2, r.is_hesitation_3) for r in O.hesitation(frame, "proba", 0.25).collect()}
    assert gaps == {1: (True, False), 2: (True, True), 3: (True, True)}
    typed = frame.where("id < 3").withColumn("v", M.array_to_vector(F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0))))
    coefs = spark.createDataFrame([("a", [1.0, 5.0, -1.0]), ("b", [0.5, 0.0, 0.5]), ("c", [0.0] * 3)], "class string, values array<double>")
    table = O.coefficient_rows(coefs, ["un", "deux", "trois"])
    lines = {r["ID"]: r for r in O.dossier(typed, "id", "label", "proba", "v", table).collect()}
    assert lines[1]["Vrai Parti"] == "a (50.0%)" and lines[1]["Challenger (2nd)"] == "b (40.0%)"
    assert lines[1]["Mots Ancres (Confirmant)"] == "un" and lines[1]["Mots Transfuges (Vers Challenger)"] == "trois, un"
    assert lines[1]["Statut"] == O.STATUS_ATYPICAL and lines[2]["Statut"] == O.STATUS_ERROR
    assert lines[2]["Challenger (2nd)"] == "a (40.0%)"
    explained = O.explain(typed.where("id = 1"), "id", "label", "v", table).orderBy("rank").collect()
    assert [(r.mot, r.contribution) for r in explained] == [("un", 1.0), ("trois", -2.0)]
    assert O.dossier(typed, "id", "label", "proba", "v", table, max_rows=1).count() == 1


def test_summary_of_methods_without_outliers(spark):
    frame = spark.createDataFrame([("a", "a", True), ("a", "b", True), ("b", "b", False)], "label string, p string, far boolean")
    out = {r[0]: (r[1], r[2]) for r in O.method_summary(frame, "label", "p", {"x": "far", "y": None}).collect()}
    assert out == {"x": (2, 50.0), "y": (0, 0.0)}
    report = O.outlier_report(frame.where("far"), "label", "p").first()
    assert tuple(report) == ("a", 2, 1, 50.0)


def test_no_pair_is_lost_from_the_confusion_matrix(spark):
    frame = spark.createDataFrame([("0", "0"), ("0", "2"), ("2", "1"), (None, "0")], "y string, p string")
    cells = E.confusion_matrix(E.confusion_counts(frame, "y", "p"), ["0", "1"]).collect()
    found = {(r.y_true, r.y_pred): r.n for r in cells}
    assert len(cells) == len(found) == 10 and sum(found.values()) == 4
    assert found["0", "2"] == found["2", "1"] == found[None, "0"] == 1 and found["1", "1"] == 0
    assert E.confusion_matrix(E.confusion_counts(frame.limit(0), "y", "p")).collect() == []


def test_rows_without_a_label_have_no_weight(spark):
    from folioscope.operators.models import balanced

    frame = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "label string")
    rows, total = balanced(frame, "label")
    weights = [r.weight for r in rows.collect()]
    assert total == 4 and len(weights) == 4 and sum(weights) == pytest.approx(4)


def test_documents_of_an_unknown_class_are_kept(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT

    from folioscope.operators import outliers as O

    rows = spark.createDataFrame(
        [("a", [1.0, -1.0], ["x", "y"]), ("b", [-1.0, 1.0], ["x", "y"])], "class string, coefs array<double>, terms array<string>"
    )
    v = Vectors.dense([1.0, 0.5])
    docs = spark.createDataFrame(
        [(1, "a", {"a": 0.2, "b": 0.8}, v), (2, "new", {"a": 0.7, "b": 0.3}, v), (3, "a", {"a": 1.0}, v)],
        spark.createDataFrame([], "id int, label string, proba map<string,double>").schema.add(
            "features", VectorUDT()
        ),
    )
    found = {r.ID: r for r in O.dossier(docs, "id", "label", "proba", "features", rows).collect()}
    assert set(found) == {1, 2, 3} and found[1]["Vrai Parti"] == "a (20.0%)"
    assert found[2]["Vrai Parti"] == "new" and found[2]["Mots Ancres (Confirmant)"] == ""
    assert found[2]["Mots Transfuges (Vers Challenger)"] == "x" and found[3]["Challenger (2nd)"] is None
    words = O.explain(docs, "id", "label", "features", rows, 1).collect()
    assert [(r["class"], r.mot) for r in words if r.id == 2] == [("new", None)]
    assert {r.mot for r in words if r.id == 1} == {"x", "y"}


def test_side_by_side_shows_every_class(spark):
    from folioscope.operators import outliers as O

    top = spark.createDataFrame([(c, 1, c + "w", 1.0) for c in "abcde"], "class string, rank int, feature string, coef double")
    blocks = O.side_by_side_blocks(top, list("abcde"))
    assert [len(b.columns) for b in blocks] == [7, 5] and blocks[1].first()["e - mot"] == "ew"


def test_models_of_a_grid_search_predict_out_of_fold(spark):
    rows = [(i, float(i % 2), i // 2 % 3, [float(i % 2) + 0.01 * i, 1.0]) for i in range(30)]
    frame = spark.createDataFrame(rows, "id long, label_index double, fold int, x array<double>")
    frame = frame.withColumn("features", M.array_to_vector("x"))
    fits = []

    def fit(part, C):
        fits.append(C)
        return M.fit_logistic(part, C=C)

    best, score, models = M.grid_models(frame, 3, [{"C": 1.0}, {"C": 1.0}], fit)
    found = {r.id: r.prediction for r in M.held_out_rows(frame, models).collect()}
    assert len(fits) == 6 and best == {"C": 1.0} and 0 <= score <= 1
    assert found == {r.id: r.prediction for r in M.out_of_fold(frame, 3, lambda part: fit(part, 1.0)).collect()}
