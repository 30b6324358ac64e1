"""Distances, quantiles and neighbours against brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from folioscope.operators import distance as D
from folioscope.operators import neighbours as N
from folioscope.operators import quantiles as QN


def vectors(spark, rows):
    frame = spark.createDataFrame(rows, "id int, label string, x array<double>")
    return frame.withColumn("v", array_to_vector("x"))


ROWS = [
    (0, "a", [1.0, 0.0, 2.0]), (1, "a", [0.0, 1.0, 1.0]), (2, "a", [0.0, 0.0, 0.0]), (3, "b", [3.0, 1.0, 0.0]),
    (4, "b", [3.0, 1.0, 0.5]), (5, "c", [1.0, 1.0, 1.0]), (6, None, [1.0, 0.0, 0.0]), (7, "b", [0.0, 0.0, 4.0]),
    (8, "b", [3.0, 1.1, 0.2]),
]


def cosine(x, y):
    return 1 - np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y))


def test_centroid_distance(spark):
    frame = vectors(spark, ROWS)
    out = {r.id: r.d for r in D.centroid_distance(frame, "label", "v", 3, "d", classes=["a", "b"]).collect()}
    for i, label, x in ROWS:
        if label not in ("a", "b") or not any(x):
            assert out[i] is None
        else:
            center = np.mean([y for _, l, y in ROWS if l == label], axis=0)
            assert out[i] == pytest.approx(cosine(x, center))
    one = {r.id: r.d for r in D.centroid_distance(frame, "label", "v", 3, "d", zero_vector=1.0).collect()}
    assert one[2] == 1.0 and one[6] is None and one[5] == pytest.approx(0.0)


def test_intra_class_distance_equals_all_pairs(spark):
    out = {r.label: r.intra_distance for r in D.intra_class_distance(vectors(spark, ROWS), "label", "v").collect()}
    for label in "abc":
        unit = [np.array(x) / (np.linalg.norm(x) or 1.0) for _, l, x in ROWS if l == label]
        sims = [unit[i] @ unit[j] for i in range(len(unit)) for j in range(i)]
        assert out[label] == pytest.approx(1 - np.mean(sims) if sims else 0.0)
    assert set(out) == {"a", "b", "c"}


def test_outliers_skip_small_classes(spark):
    rows = [(i, "big", float(v)) for i, v in enumerate([1, 1.1, 1.2, 1.3, 9])] + [(9, "tiny", 50.0), (10, "tiny", 1.0)]
    frame = spark.createDataFrame(rows, "id int, label string, d double")
    flagged = {r.id for r in D.iqr_flag(frame, "label", "d", "far").where("far").collect()}
    assert flagged == {4}


@pytest.mark.parametrize("broadcast", [True, False])
def test_group_quantiles_are_exact_under_skew_and_ties(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(QN, "measured_broadcast", lambda df: df)
    rng = np.random.default_rng(1)
    values = {
        "hot": np.round(rng.normal(size=4000), 2), "one": np.array([3.0]), "same": np.full(500, 7.0),
        "long_tail": np.exp(rng.normal(size=900) * 4), "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), (None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, x double").repartition(7)
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    out = {r.g: (r.n, r.q) for r in QN.group_quantiles(frame, "g", "x", shares).collect()}
    assert set(out) == set(values)
    for g, vs in values.items():
        assert out[g][0] == len(vs)
        np.testing.assert_allclose(out[g][1], np.quantile(vs, shares))


@pytest.mark.parametrize("ranked", [1, 3, 40])
def test_quantiles_by_repeated_narrowing(spark, monkeypatch, ranked):
    monkeypatch.setattr(QN, "PIECES", 4)
    rng = np.random.default_rng(3)
    values = {"hot": rng.normal(size=3000), "ties": np.round(rng.normal(size=800), 1), "one": np.array([2.0])}
    frame = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "g string, x double")
    shares = [0.0, 0.25, 0.5, 0.999]
    out = {r.g: r.q for r in QN.group_quantiles(frame, "g", "x", shares, ranked=ranked).collect()}
    for g, vs in values.items():
        np.testing.assert_allclose(out[g], np.quantile(vs, shares))


@pytest.mark.parametrize("blocks", [(2, 3), (512, 4096)])
def test_class_pairs_equal_the_dense_product(spark, monkeypatch, blocks):
    monkeypatch.setattr(D, "CLASS_BLOCK", blocks[0])
    monkeypatch.setattr(D, "FEATURE_BLOCK", blocks[1])
    rng = np.random.default_rng(5)
    dense = rng.normal(size=(7, 20)) * (rng.random((7, 20)) < 0.4)
    dense[5], dense[6, :], dense[6, 19], dense[:5, 19] = 0.0, 0.0, 2.0, 0.0  # a zero class, one that shares nothing
    rows = [(f"c{i}", f"f{j}", float(dense[i, j])) for i in range(7) for j in range(20) if dense[i, j] or i == 5]
    frame = spark.createDataFrame(rows + [(None, "f1", 9.0)], "class string, feature string, coef double")
    found = {(r.class_a, r.class_b): r.dist for r in D.class_pair_distance(frame).collect()}
    assert len(found) == 49
    for i in range(7):
        for j in range(7):
            size = np.linalg.norm(dense[i]) * np.linalg.norm(dense[j])
            expected = 0.0 if i == j else 1 - (dense[i] @ dense[j] / size if size else 0.0)
            assert found[(f"c{i}", f"c{j}")] == pytest.approx(expected, abs=1e-12)
    assert D.class_pair_distance(frame.where("false")).count() == 0


def test_box_plot(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 5, 100, -50]]
    box = D.box_plot(spark.createDataFrame(rows, "g string, x double"), "g", "x").first()
    q1, q2, q3 = np.quantile([r[1] for r in rows], [0.25, 0.5, 0.75])
    assert (box.q1, box.median, box.q3, box.whisker_low, box.whisker_high, box.n_fliers) == (q1, q2, q3, 1.0, 5.0, 2)


def test_class_pairs_without_common_feature(spark):
    coefs = spark.createDataFrame(
        [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 2.0), ("b", "y", 4.0), ("c", "z", 1.0)],
        "class string, feature string, coef double",
    )
    out = {(r.class_a, r.class_b): r.dist for r in D.class_pair_distance(coefs).collect()}
    assert len(out) == 9 and out["a", "b"] == pytest.approx(0.0) and out["a", "c"] == 1.0 and out["c", "c"] == 0.0
    intra = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("q", 0.9)], "label string, intra_distance double")
    matrix = {(r.class_a, r.class_b): r.dist for r in D.dissimilarity(coefs, intra, "label").collect()}
    assert matrix["a", "a"] == 0.5 and ("q", "q") not in matrix


def brute_force(points, k):
    out = {}
    for i, _, x, y in points:
        order = sorted(points, key=lambda p: ((p[2] - x) * (p[2] - x) + (p[3] - y) * (p[3] - y), p[0]))
        out[i] = [p[0] for p in order[:k]]
    return out


def clouds(seed):
    """A third of the points at one spot, a very tight cluster, and a wide background."""
    rng = np.random.default_rng(seed)
    spot = [(0.25, 0.75)] * 150
    tight = [(0.5 + a * 1e-4, 0.5 + b * 1e-4) for a, b in rng.normal(size=(150, 2))]
    wide = [tuple(p) for p in rng.uniform(-3, 3, size=(150, 2))]
    xy = spot + tight + wide
    order = rng.permutation(len(xy))
    return [(int(n), "abc"[int(n) % 3], float(xy[j][0]), float(xy[j][1])) for n, j in enumerate(order)]


@pytest.mark.parametrize("k,leaf", [(10, 12), (3, 64)])
def test_neighbours_equal_brute_force(spark, k, leaf):
    points = clouds(k)
    frame = spark.createDataFrame(points, "id int, label string, x double, y double")
    near = N.nearest_labels(frame, "id", "label", "x", "y", k, leaf=leaf)
    joined = frame.join(near, (frame.x == near["_x"]) & (frame.y == near["_y"]))
    ours = {r.id: [p.id for p in r.neighbours] for r in joined.collect()}
    assert ours == brute_force(points, k)


def test_few_points_and_tied_votes(spark):
    rows = [(i, "b" if i < 5 else "a", float(i), 0.0) for i in range(10)]
    frame = spark.createDataFrame(rows, "id int, label string, x double, y double")
    out = {r.id: (r.parti_geographique, r.is_outlier_knn) for r in N.neighbour_outliers(frame, "id", "label", "x", "y", 10).collect()}
    assert out[0] == ("a", True) and out[9] == ("a", False) and len(out) == 10
    single = frame.where("id = 3")
    assert N.neighbour_outliers(single, "id", "label", "x", "y", 10).first().is_outlier_knn is False
    assert N.neighbour_outliers(frame.where("id < 0"), "id", "label", "x", "y", 10).count() == 0


def test_furthest_and_arg_max_break_ties_by_key(spark):
    frame = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 2.0), (4, None)], "id int, d double")
    assert [r.id for r in D.furthest(frame, "d", "id", 2).collect()] == [1, 2]
    assert tuple(D.most_distant(frame, "d", "id").first()) == (1, 2.0)


def test_sparse_and_dense_vectors_give_the_same_entries(spark):
    from folioscope.operators.vectorize import postings

    frame = spark.createDataFrame([(1, Vectors.sparse(3, {1: 2.0})), (2, Vectors.dense([0.0, 2.0, 1.0]))], ["id", "v"])
    rows = {(r.id, r.idx): r.w for r in postings(frame, "v", ["id"]).where(F.col("w") != 0).collect()}
    assert rows == {(1, 1): 2.0, (2, 1): 2.0, (2, 2): 1.0}


def test_a_point_without_finite_coordinates_is_no_outlier(spark):
    from folioscope.operators.neighbours import neighbour_outliers

    odd = [(90, "b", None, 0.0), (91, "b", float("nan"), 0.0), (92, "b", float("inf"), 1.0)]
    rows = [(i, "a", float(i % 4), float(i % 3)) for i in range(20)] + [(20, "b", 1.0, 1.0), *odd]
    frame = spark.createDataFrame(rows, "id int, label string, x double, y double")
    found = {r.id: r for r in neighbour_outliers(frame, "id", "label", "x", "y", k=5).collect()}
    assert len(found) == 24 and found[20].is_outlier_knn and not found[0].is_outlier_knn
    assert all(found[i].is_outlier_knn is False and found[i].parti_geographique is None for i in (90, 91, 92))


@pytest.mark.parametrize("strip", [N.STRIP, 40])
def test_neighbours_with_far_points_lines_hot_spots_and_odd_numbers(spark, strip):
    rng = np.random.default_rng(8)
    spots = [(0.0, 0.0)] * 300 + [(1e15, -1e15), (1e15, 3.0), (-1e200, 0.0)]
    spots += [(float(v), 5.0) for v in range(150)] + [(7.0, float(v)) for v in range(150)]
    spots += [(1e-9 * float(a), 1e-9 * float(b)) for a in range(12) for b in range(12)]
    spots += [tuple(p) for p in rng.normal(size=(200, 2)).tolist()]
    points = [(int(i), "ab"[i % 2], *spots[j]) for i, j in enumerate(rng.permutation(len(spots)))]
    odd = [(5000, "a", float("nan"), 0.0), (5001, "a", None, 1.0), (5002, "b", 1.0, float("-inf"))]
    frame = spark.createDataFrame([*points, *odd], "id int, label string, x double, y double").repartition(3)
    near = N.nearest_labels(frame, "id", "label", "x", "y", 10, leaf=8, strip=strip)
    joined = frame.join(near, (frame.x == near["_x"]) & (frame.y == near["_y"]))
    ours = {r.id: [p.id for p in r.neighbours] for r in joined.collect()}
    x, y = (np.array([p[c] for p in points]) for c in (2, 3))
    with np.errstate(over="ignore"):
        expected = {
            i: [int(points[j][0]) for j in np.lexsort((np.arange(len(points)), (x - a) ** 2 + (y - b) ** 2))[:10]]
            for i, _, a, b in points
        }
    assert ours == expected


def test_neighbours_keep_text_keys_in_order(spark):
    rows = [(f"k{i % 7}{i}", "a" if i % 3 else None, float(i % 5), 0.0) for i in range(40)]
    frame = spark.createDataFrame(rows, "id string, label string, x double, y double")
    near = {r["_x"]: [(p.d2, p.id) for p in r.neighbours] for r in N.nearest_labels(frame, "id", "label", "x", "y", 9).collect()}
    assert near == {x: sorted(((r[2] - x) ** 2, r[0]) for r in rows)[:9] for x in {r[2] for r in rows}}
