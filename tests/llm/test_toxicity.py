import pytest
from pyspark.sql import functions as F

from folioscope.llm.language_id import CharModel, gram_counts, kneser_ney
from folioscope.llm.toxicity import Restorer, fit_toxicity, logistic, score_toxicity

WORDS = ["garden", "house", "river", "window", "table", "morning", "letter", "street", "water", "music"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows, labels = [], []
    for i in range(240):
        text = " ".join(WORDS[(i * 7 + j * (1 + i % 3)) % 10] for j in range(12))
        toxic = i % 4 == 0
        rows.append((i, text + (" you idiot" if toxic else " you friend"), "x"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, _label string"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int"
    )


def test_disguises_are_restored(spark, corpus):
    docs, _ = corpus
    counts = gram_counts(docs.select(F.lit("all").alias("group"), F.col("text").alias("content")))
    restorer = Restorer(CharModel.load(kneser_ney(counts)))
    for disguised in ("1d10t", "id!ot", "idiooooot", "1.d.i.o.t"):
        assert "idiot" in restorer.restored(disguised), disguised
    assert "idiot" in restorer.of("such an i d i o t here")
    assert restorer.restored("garden") == ["garden"] and restorer.restored("***") == []
    assert restorer.restored("2024") == ["2024"]


def test_scores_of_plain_disguised_and_odd_texts(spark, corpus):
    docs, labels = corpus
    extra = [(1000, "the idi0t by the river", ""), (1001, "i d i o t", ""), (1002, "quiet river morning", ""), (1003, None, ""),
             (1004, "", ""), (None, "an idiot", ""), (1000, "the idi0t by the river", ""), (1005, "river " * 30000, "")]
    every = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    noisy = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema))
    found = {r.doc_id: r for r in score_toxicity(every, noisy, F.lit(True)).collect()}
    assert all(found[i].predicted == 1 for i in (0, 4, 1000, 1001, None))
    assert all(found[i].predicted == 0 for i in (1, 2, 1002, 1003, 1004, 1005))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())


def test_no_rows_and_no_labels(spark, corpus):
    docs, labels = corpus
    assert score_toxicity(docs.limit(0), labels, F.lit(True)).collect() == []
    assert {r.predicted for r in score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0}
    assert fit_toxicity(docs, labels, F.col("doc_id") < 0).weights == {}


def test_logistic_curve():
    import numpy as np

    slope, base = logistic(np.array([0.0, 5.0]), np.array([0, 1]), np.array([100, 100]))
    assert base < 0 < slope
