"""Forests: where a tree is grown has no part in it, and its rules hold."""

import pickle

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from folioscope.operators import forest as module
from folioscope.operators import models
from folioscope.operators.models import fit_forest
from folioscope.plans import catalog_models  # noqa: F401
from folioscope.plans.registry import QUERIES


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(7)
    x = np.round(draw.normal(size=(400, 6)), 1)
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    data = [(i, [float(v) for v in x[i]], float(y[i])) for i in range(400)]
    frame = spark.createDataFrame(data, "id int, x array<double>, label_index double").repartition(3)
    return frame.withColumn("features", array_to_vector("x")).cache()


def judged(model, frame):
    return {r.id: (r.prediction, r.probability and tuple(r.probability)) for r in model.transform(frame).collect()}


def test_trees_do_not_depend_on_where_they_are_grown(rows, monkeypatch):
    whole = fit_forest(rows, weighted=False, n_estimators=6)
    assert all(top.left == [-1] for top in whole.tops)
    monkeypatch.setattr(module, "ROWS_IN_TASK", 40)
    parts = fit_forest(rows, weighted=False, n_estimators=6)
    assert all(len(top.left) > 3 for top in parts.tops)
    assert judged(parts, rows) == judged(whole, rows)
    # Depth ends the tops too: leaves of more rows than a task takes.
    flat = fit_forest(rows, weighted=False, n_estimators=6, max_depth=2)
    monkeypatch.setattr(module, "ROWS_IN_TASK", 1000)
    assert judged(flat, rows) == judged(fit_forest(rows, weighted=False, n_estimators=6, max_depth=2), rows)


def test_forest_learns_and_shares_add_up_to_one(rows):
    model = fit_forest(rows.where("id % 2 = 0"), n_estimators=20)
    out = judged(model, rows.withColumn("features", F.when(F.col("id") != 1, F.col("features"))))
    assert len(out) == 400 and out.pop(1)[0] is None
    assert all(abs(sum(p) - 1) < 1e-12 and p.index(max(p)) == prediction for prediction, p in out.values())
    truth = {r.id: r.label_index for r in rows.collect()}
    assert np.mean([out[i][0] == truth[i] for i in out if i % 2]) > 0.75


def test_rules_of_a_tree():
    draw = np.random.default_rng(3)
    x, y = draw.integers(0, 32, (500, 5)).astype(np.uint8), draw.integers(0, 3, 500)
    ones = np.ones(500)
    for least, depth in ((1, 30), (7, 30), (1, 3)):
        rules = module.Rules(5, 3, 5, 42, depth, least)
        tree = module.grown(rules, rules.root_seed(0), 0, x, y, ones, ones)
        ends = module.descended(tree, x)
        assert set(ends) == set(np.flatnonzero(tree["left"] < 0))
        sizes = np.bincount(ends)
        assert sizes[sizes > 0].min() >= least
        for end in set(ends):
            assert np.allclose(tree["shares"][end], np.bincount(y[ends == end], minlength=3) / sizes[end])
        if (least, depth) == (1, 30):
            assert all(tree["shares"][e].max() == 1 or len(np.unique(x[ends == e], axis=0)) == 1 for e in set(ends))
    # The first split is the best of all by Gini impurity.
    rules = module.Rules(5, 3, 5, 42, 1, 1)
    tree = module.grown(rules, rules.root_seed(0), 0, x, y, ones, ones)

    def impurity(side):
        return len(side) - np.square(np.bincount(side, minlength=3)).sum() / max(len(side), 1)

    scores = {(j, c): impurity(y[x[:, j] <= c]) + impurity(y[x[:, j] > c]) for j in range(5) for c in range(31)}
    assert np.isclose(scores[tree["feature"][0], tree["cut"][0]], min(scores.values()))


def test_draws_are_poisson_and_parts_are_tables(rows):
    rules = module.Rules(5, 3, 2, 42, 30, 1)
    counts = rules.drawn(np.arange(100_000), 3)
    assert abs(counts.mean() - 1) < 0.02 and abs((counts == 0).mean() - np.exp(-1)) < 0.01
    assert (counts != rules.drawn(np.arange(100_000), 4)).any()
    model = fit_forest(rows, n_estimators=3)
    assert sorted((r.tree, r.node) for r in model.trees.collect()) == [(0, 0), (1, 0), (2, 0)]
    assert all(len(pickle.loads(r.model)["left"]) > 3 for r in model.trees.collect())


def test_rows_that_cannot_be_learned_from_are_an_error(rows):
    with pytest.raises(ValueError, match="no row"):
        fit_forest(rows.where("id < 0"), weighted=False)
    with pytest.raises(ValueError, match="class indices"):
        fit_forest(rows.withColumn("label_index", F.when(F.col("id") != 5, F.col("label_index"))), weighted=False)
    odd = F.when(F.col("id") == 5, F.array_repeat(F.lit(float("nan")), 6)).otherwise(F.col("x"))
    with pytest.raises(ValueError, match="finite"):
        fit_forest(rows.withColumn("features", array_to_vector(odd)), weighted=False)
    without = rows.withColumn("label_index", F.when(F.col("id") != 5, F.col("label_index")))
    assert fit_forest(without, n_estimators=1).trees.count() == 1


GRID = {"n_estimators": [5, 3], "max_depth": [None, 2], "min_samples_split": [2, 60], "min_samples_leaf": [1, 9],
        "max_features": ["sqrt", "log2"]}


def test_points_that_share_trees_predict_as_forests_of_their_own(rows, monkeypatch):
    monkeypatch.setattr(module, "TREES", 2)
    numbered = rows.withColumns({"row": F.col("id").cast("long"), "fold": F.col("id") % 2}).cache()
    points = models.grid_points(GRID)
    found = {r.row: r.predicted for r in module.search_forest_folds(numbered, 2, points).collect()}
    assert sorted(found) == list(range(400)) and {len(p) for p in found.values()} == {32}
    assert len({tuple(found[i][p] for i in found) for p in range(32)}) > 8
    train, held_out = numbered.where("fold = 1"), numbered.where("fold = 0")
    for p in (0, 6, 9, 15, 20, 27, 31):
        own = fit_forest(train, deepest=module.ENDLESS, row="row", **points[p])
        assert {r.id: int(r.prediction) for r in own.transform(held_out).collect()} == {i: found[i][p] for i in found if i % 2 == 0}


def test_search_of_many_rows_equals_that_in_tasks(rows, monkeypatch):
    folded = rows.withColumn("fold", F.col("id") % 2)
    grid = {**GRID, "n_estimators": [3], "min_samples_leaf": [4], "max_features": ["sqrt"]}
    best, score, out = models.forest_grid_search(folded, 2, grid)
    given = {r.id: r.prediction for r in out.collect()}
    monkeypatch.setattr(models, "IN_TASK_BYTES", 0)
    again, same, out = models.forest_grid_search(folded, 2, grid)
    assert again == best and np.isclose(score, same) and {r.id: r.prediction for r in out.collect()} == given
    truth = {r.id: r.label_index for r in rows.collect()}
    assert np.mean([given[i] == truth[i] for i in given]) > 0.6


def test_the_query_searches_the_whole_grid(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(5)
    data = [(i, draw.normal(size=4).tolist(), i % 2) for i in range(40)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []

    def search(rows, k, points, **other):
        seen.append((k, points))
        few = [{**p, "n_estimators": 2} for p in points]
        return module.search_forest_folds(rows, k, few, **other)

    monkeypatch.setattr(models, "search_forest_folds", search)
    report = QUERIES["m11_random_forest"](spark, str(tmp_path)).collect()
    assert [(k, len(points)) for k, points in seen] == [(5, 216)] and len(report) > 2
    assert {p["n_estimators"] for p in seen[0][1]} == {500, 750, 1000}


def test_a_node_of_too_few_rows_is_not_split():
    draw = np.random.default_rng(3)
    x, y, ones = draw.integers(0, 32, (500, 5)).astype(np.uint8), draw.integers(0, 3, 500), np.ones(500)
    rules = module.Rules(5, 3, 5, 42, 30, 1, 40)
    tree = module.grown(rules, rules.root_seed(0), 0, x, y, ones, ones)
    assert tree["size"][tree["left"] >= 0].min() >= 40 and (tree["size"][tree["left"] < 0] < 40).any()
