"""Scoring inside the document's row."""

import pytest

from folioscope.operators.lexical import term_totals
from folioscope.plans.centroid_model import fit_centroid_model

ROWS = [
    (1, "a", ["x", "y", "x"]), (2, "a", ["y"]), (3, "b", ["z", "z", "x"]), (4, "b", ["z"]), (5, None, ["x", "z"]),
    (6, "c", []), (7, "a", []), (8, "b", ["unseen", "y"]),
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(ROWS, "id int, label string, tokens array<string>")
    return fit_centroid_model(docs, "id", "label", "tokens", 3)


def test_row_and_join_give_the_same_cosines(model):
    def cosines(frame):
        return {r.id: {k: round(v, 12) for k, v in (r._cosines or {}).items() if abs(v) > 1e-12} for r in frame.collect()}

    assert cosines(model.with_cosines()) == cosines(model.with_cosines_by_join())


def test_probabilities_and_no_exchange_of_documents(model):
    scored = model.scored()
    rows = {r.id: r for r in scored.collect()}
    assert len(rows) == len(ROWS) and all(set(r.proba) == {"a", "b", "c"} for r in rows.values())
    assert all(abs(sum(r.proba.values()) - 1) < 1e-12 for r in rows.values())
    assert rows[4].predicted_label == "b" and rows[2].predicted_label == "a"
    assert set(rows[6].proba.values()) == {1 / 3}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "Generate" not in plan


def test_cosines_are_weighed_in_batches_not_by_a_matrix_in_every_row(model):
    """The same numbers, bit for bit, as adding up the entries one by one."""
    units = {}
    for label in "abc":
        total = [0.0] * model.size
        for r in model.documents.where(f"label = '{label}'").collect():
            total = [t + v for t, v in zip(total, r.features.toArray(), strict=True)]
        norm = sum(t * t for t in total) ** 0.5
        units[label] = [t / norm if norm else 0.0 for t in total]
    scored = model.with_cosines()
    for r in scored.collect():
        for label, cosine in r._cosines.items():
            assert cosine == pytest.approx(sum(r.features.toArray() * units[label]), abs=1e-12)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "lambdafunction" not in plan


def test_terms_are_counted_without_functions_of_single_tokens(spark):
    rows = [(["x", "y", "x"],), (["x"],), ([],), (None,)]
    out = term_totals(spark.createDataFrame(rows, "tokens array<string>"), "tokens")
    assert {tuple(r) for r in out.collect()} == {("x", 3, 2), ("y", 1, 1)}
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
