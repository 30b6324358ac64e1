import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm.language_id import CharModel, gram_counts, identify_languages, kneser_ney, symbols

SCHEMA = "doc_id long, text string, lang string, score string"
EN = ["the cat sat on the mat with the other cats", "this is the house that the man built", "there was nothing there"]
DE = ["der Hund schläft nicht auf dem Sofa", "das ist ein schönes Haus und ein Garten", "ich weiß nicht was ich schreibe"]


def test_symbols_are_padded_ngrams():
    codes, sizes = symbols(["ab", "c"], 2)
    assert sizes.tolist() == [3, 2]
    pair = lambda a, b: (ord(a) << 12) | ord(b)
    assert codes.tolist() == [pair(" ", "a"), pair("a", "b"), pair("b", " "), pair(" ", "c"), pair("c", " ")]


def test_model_equals_the_formula(spark):
    """Interpolated Kneser-Ney of order 2, written out."""
    texts = ["ab abc b", "abab"]
    rows = spark.createDataFrame([("g", t) for t in texts], "`group` string, content string")
    model = CharModel.load(kneser_ney(gram_counts(rows, 2), 2), 2)
    grams = Counter()
    for word in "ab abc b abab".split():
        padded = " " + word + " "
        grams.update(zip(padded, padded[1:]))
    n1, n2 = sum(c == 1 for c in grams.values()), sum(c == 2 for c in grams.values())
    d2 = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9)
    lower = Counter(b for _, b in grams)
    m1, m2 = sum(c == 1 for c in lower.values()), sum(c == 2 for c in lower.values())
    d1 = min(max(m1 / (m1 + 2 * m2), 0.1), 0.9) if m1 + 2 * m2 else 0.5
    total = sum(lower.values())

    def p(a, b):
        low = max(lower[b] - d1, 0) / total + d1 * len(lower) / total / 4096
        n = sum(c for (x, _), c in grams.items() if x == a)
        if not n:
            return low
        kinds = sum(x == a for x, _ in grams)
        return (max(grams[a, b] - d2, 0) if (a, b) in grams else 0) / n + d2 * kinds / n * low

    for word in ("ab", "ba", "zq"):
        padded = " " + word + " "
        wanted = -sum(math.log2(p(a, b)) for a, b in zip(padded, padded[1:]))
        assert np.allclose(model.scores([word])[0, 0], wanted, rtol=1e-3)


def test_predictions_and_odd_rows(spark):
    rows = [(i, t, "en", None) for i, t in enumerate(EN)] + [(10 + i, t, "de", None) for i, t in enumerate(DE)]
    rows += [(20, "there is a cat in the house", None, "x"), (21, "ein Hund und das Haus", None, "x")]
    rows += [(22, None, "en", None), (23, "", None, None), (24, "12 34 !!", None, None), (None, "the man was there", None, None)]
    rows += [(20, "there is a cat in the house", None, "x"), (25, "the cat " * 20000, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = identify_languages(docs, F.lit(True)).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert by[20].lang_pred == "en" and by[21].lang_pred == "de" and by[25].lang_pred == "en" and by[None].lang_pred == "en"
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (22, 23, 24))
    assert all(0 <= r.score <= 1 for r in found)
    assert identify_languages(docs.limit(0), F.lit(True)).collect() == []
    assert {r.lang_pred for r in identify_languages(docs, F.lit(False)).collect()} == {"und"}


def test_levels_come_from_every_training_text(spark):
    """The only odd text of a language is one that a sample of 20,000 of the 24,000 by hash of the key would miss."""
    ids = spark.range(24000).withColumnRenamed("id", "doc_id")
    odd = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) > 900_000).orderBy("doc_id").first().doc_id
    plain = F.get(F.array(*map(F.lit, EN)), (F.col("doc_id") % 3).cast("int"))
    text = F.when(F.col("doc_id") == odd, F.lit("the qzj xkv wvq zzx jqk")).otherwise(plain)
    docs = ids.select("doc_id", text.alias("text"), F.lit("en").alias("lang"))
    found = identify_languages(docs, F.lit(True), quantile=1.0)
    assert found.where("accepted").count() == 24000
    assert found.where(F.col("doc_id") == odd).first().entropy > 1.1 * found.where(F.col("doc_id") != odd).agg(F.max("entropy")).first()[0]
