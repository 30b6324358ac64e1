"""Text expressions against plain Python on awkward strings, and rules on hand-made labels."""

import re

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import lexical as L

TEXTS = [
    None, "", "...", "a a b", "1é 12 é12 123. 7,8", "L'État, c'est moi !\n\nVive la France ?",
    "ÉCOLE école  Élève\t12 ans; 3_4 x", "mot long　fin 5", "İstanbul straße ΟΔΟΣ", "12", "a.12.b 1,2;34!567",
    " \n ", "!!! ??? .", "un\x1cdeux\x85trois", "٣٤ ۵ 12", "x" * 40 + " é" * 10, "Bonjour. Au revoir!  \n Encore?! ",
]


def column(spark, expression):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", expression.alias("r")).orderBy("i")
    return [r.r for r in rows.collect()]


def test_lexical_tokens(spark):
    expected = [re.sub(r"[^\w\s]", "", (t or "").lower()).split() for t in TEXTS]
    assert column(spark, X.lexical_tokens("t")) == expected


def test_sentence_count(spark):
    expected = [len([s for s in re.split(r"[.!?]+", t or "") if s.strip()]) for t in TEXTS]
    assert column(spark, X.sentence_count("t")) == expected


def test_cleaning_chain(spark):
    def chain(t):
        t = re.sub(r"\n+", " ", t)
        t = re.sub(r"[^\w\s\.,;!?]", "", t)
        return re.sub(r"\b\d{1,2}\b", "", t)

    ours = column(spark, X.remove_isolated_numbers(X.remove_symbols(X.newlines_to_blank("t"))))
    assert ours == [None if t is None else chain(t) for t in TEXTS]


def test_clean_tokens_keep_letters_and_skip_numbers(spark):
    stops = set(X.STOP_WORDS)

    def expected(t):
        t = re.sub(r"\b\d{1,2}\b", "", re.sub(r"[^\w\s\.,;!?]", "", re.sub(r"\n+", " ", t or ""))).lower()
        return [p for p in re.split(r"[\s.,;!?]+", t) if len(p) > 2 and p.isalpha() and p not in stops]

    assert column(spark, X.clean_tokens("t")) == [expected(t) for t in TEXTS]
    assert column(spark, X.words(X.clean_text("t"))) == [expected(t) for t in TEXTS]


def test_stop_words_are_those_of_spark(spark):
    assert X.FRENCH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("french")


def test_coarse_labels(spark):
    cases = {
        "Parti socialiste unifié": "Bloc de Gauche", "Mouvement des radicaux de gauche": "Bloc de Gauche",
        "Rassemblement pour la République": "Bloc de Droite", "rassemblement pour la république": "Autres",
        "Parti communiste français": "PCF", "Ligue communiste révolutionnaire": "Extrême Gauche",
        "Lutte ouvrière": "Extrême Gauche", "Front national": "Autres", None: None,
        "Parti socialiste;Rassemblement pour la République": "Bloc de Gauche",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "label string").select("label", X.coarse_label("label").alias("b"))
    assert {r.label: r.b for r in rows.collect()} == cases


def test_truncation_at_fifty(spark):
    rows = spark.createDataFrame([("x" * 50,), ("y" * 51,), (None,)], "l string").select(X.truncated("l").alias("s"))
    assert [r.s for r in rows.collect()] == ["x" * 50, "y" * 50 + "...", None]


def test_sign_percent_and_name(spark):
    row = spark.range(1).select(
        X.sign_class(F.lit(0.0)).alias("z"), X.sign_class(F.lit(-2)).alias("n"),
        X.with_percent(F.lit("PS"), F.lit(0.1234)).alias("p"), X.document_name(F.lit("a.txt.b.txt")).alias("f"),
    ).first()
    assert tuple(row) == ("zero", "negative", "PS (12.3%)", "a.txt.b")


def test_lexical_metrics(spark):
    docs = spark.createDataFrame([(1, "a a b. C!"), (2, ""), (3, "..."), (4, None)], "id int, t string")
    rows = {r.id: r for r in L.lexical_metrics(docs, "t", keep_tokens=True).collect()}
    assert rows[1].tokens == ["a", "a", "b", "c"] and rows[1].nb_sentences == 2
    assert (rows[1].words_per_sentence, rows[1].vocab_size_doc, rows[1].ttr, rows[1].hapax_ratio) == (2.0, 3, 0.75, 0.5)
    for i in (2, 3, 4):
        assert (rows[i].nb_words, rows[i].words_per_sentence, rows[i].ttr, rows[i].hapax_ratio) == (0, None, None, 0.0)
    stats = L.corpus_statistics(docs, "t").first()
    assert tuple(stats)[:3] == (4, 3, 2) and abs(stats.corrected_ttr - 3 / 8**0.5) < 1e-12
    assert L.corpus_statistics(docs.where("id > 1"), "t").first().corrected_ttr == 0.0


def test_rare_words_keep_order_repeats_and_empty_documents(spark):
    docs = [(i, ["cinq", "quatre", "cinq"]) for i in range(4)] + [(4, ["cinq", "seul"]), (5, ["seul"]), (6, [])]
    frame = spark.createDataFrame(docs, "id int, tokens array<string>")
    kept = {r.id: r.tokens_filtered for r in L.filter_rare_words(frame, "id", "tokens", 5).collect()}
    assert kept == {**{i: ["cinq", "cinq"] for i in range(4)}, 4: ["cinq"], 5: [], 6: []}


def test_large_vocabulary_is_split_in_hot_words_and_tail(spark):
    frame = spark.createDataFrame([(1, ["a", "b", "c", "d", "a"]), (2, ["d"]), (3, [])], "id int, tokens array<string>")
    vocabulary = spark.createDataFrame([("a", 9), ("b", 2), ("c", 1)], "term string, n_docs int")
    for hot in (1, 2, 3, 10):
        kept = {r.id: r.kept for r in L.keep_vocabulary(frame, "id", "tokens", vocabulary, "kept", hot).collect()}
        assert kept == {1: ["a", "b", "c", "a"], 2: [], 3: []}


def test_lemmas_replace_known_forms(spark):
    frame = spark.createDataFrame([(1, ["vont", "ils", "vont"]), (2, [])], "id int, tokens array<string>")
    table = spark.createDataFrame([("vont", "aller")], "form string, lemma string")
    assert {r.id: r.lemmas for r in L.lemmatise(frame, "id", "tokens", table).collect()} == {
        1: ["aller", "ils", "aller"], 2: []
    }


def test_large_lemma_table_and_long_words(spark):
    long = "é" * 200
    docs = [(1, ["vont", "ils", "vont", long]), (2, []), (3, None), (4, [long, "sont", "rien"]), (4, ["vont"])]
    frame = spark.createDataFrame(docs, "id int, tokens array<string>")
    table = spark.createDataFrame(
        [("vont", "aller"), ("sont", "etre"), ("sont", "zzz"), (long, "long"), ("rare", "x"), ("ils", None), (None, "y")],
        "form string, lemma string",
    )
    expected = [(1, ["aller", "ils", "aller", "long"]), (2, []), (3, []), (4, ["aller"]), (4, ["long", "etre", "rien"])]
    for bound in (1, 2, 100):
        found = L.lemmatise(frame, "id", "tokens", table, max_rows=bound)
        assert sorted((r.id, r.lemmas) for r in found.collect()) == expected


def test_word_filters_exchange_no_token_of_the_dictionary(spark):
    frame = spark.createDataFrame([(i, ["cinq", "six"]) for i in range(8)], "id int, tokens array<string>")
    vocabulary = spark.createDataFrame([("cinq", 8)], "term string, n_docs int")
    plan = L.keep_vocabulary(frame, "id", "tokens", vocabulary, "kept")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_row_wise_operators_accept_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Les écoles, 12 ans")], "id int, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, t string").parquet(str(tmp_path / "in"))
    cleaned = L.lexical_metrics(stream.withColumn("clean", X.clean_text("t")), "t")
    query = cleaned.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination(60)
    row = spark.table("cleaned").first()
    assert (row.clean, row.nb_words) == ("écoles ans", 4)


def test_preprocess_with_and_without_lemmas(spark):
    frame = spark.createDataFrame([(1, "Les Chevaux, et 12 chevaux couraient!"), (2, None), (3, "")], "id int, text string")
    lemmas = spark.createDataFrame([("chevaux", "cheval"), ("couraient", "courir")], "form string, lemma string")

    def texts(**options):
        return {r.id: r.clean_text for r in L.preprocess_text(frame, "id", "text", **options).collect()}

    assert texts(lemmas=lemmas) == {1: "cheval cheval courir", 2: "", 3: ""}
    assert texts(use_lemma=False) == {1: "chevaux chevaux couraient", 2: "", 3: ""}
    with pytest.raises(ValueError, match="lemma"):
        texts()


def test_words_are_looked_up_without_python_objects(spark):
    docs = [(None, ["a", "z", "b"]), (None, ["c", "a"]), (1, None), (1, ["b", None, "c"])]
    frame = spark.createDataFrame(docs, "id int, tokens array<string>")
    vocabulary = spark.createDataFrame([("a", 3), ("b", 2), ("c", 1)], "term string, n_docs int")
    for hot in (1, 3):
        found = L.keep_vocabulary(frame, "id", "tokens", vocabulary, "kept", hot)
        kept = sorted(((r.id is None, r.kept) for r in found.collect()))
        assert kept == [(False, []), (False, ["b", "c"]), (True, ["a", "b"]), (True, ["c", "a"])]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
