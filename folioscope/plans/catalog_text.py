"""Queries for lexical statistics, cleaning, vocabulary and TF-IDF."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import lexical as L
from folioscope.operators import vectorize as V
from folioscope.operators.arrays import unnest, with_term_counts
from folioscope.plans import sql as Q
from folioscope.plans.registry import Tables, register
from folioscope.session import materialised

MAX_FEATURES = 1000


def tokens(t: Tables) -> DataFrame:
    """Cleaned tokens of every document, language as the class."""
    return t.texts.select("doc_id", "lang", X.clean_tokens("text").alias("tokens"))


def n(column):
    return F.size(column).cast("long")


METRICS_SQL = f"""m AS (SELECT doc_id, {Q.lexical()} AS tok, {Q.sentences()} AS nb_sentences FROM documents),
h AS (SELECT doc_id, count(*) FILTER (c = 1) AS once FROM
      (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(tok) AS x FROM m) GROUP BY doc_id, x) GROUP BY doc_id),
lex AS (SELECT doc_id, len(tok) AS nb_words, nb_sentences, len(tok) / nullif(nb_sentences, 0)::DOUBLE AS words_per_sentence,
        len(list_distinct(tok)) AS vocab_size_doc, len(list_distinct(tok)) / nullif(len(tok), 0)::DOUBLE AS ttr,
        coalesce(once / nullif(len(tok), 0)::DOUBLE, 0) AS hapax_ratio
        FROM m LEFT JOIN h USING (doc_id))"""


@register("l1_lexical_tokens", f"SELECT doc_id, array_to_string({Q.lexical()}, ' ') AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", F.array_join(X.lexical_tokens("text"), " ").alias("tokens"))


@register("l2_sentence_count", f"SELECT conv_id, turn, {Q.sentences()} AS nb_sentences FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.sentence_count("text").cast("long").alias("nb_sentences"))


@register(
    "l3_words_per_sentence",
    f"WITH {METRICS_SQL} SELECT doc_id, nb_words, nb_sentences, round(words_per_sentence, 6) AS words_per_sentence FROM lex",
)
def _(t: Tables) -> DataFrame:
    tok = t.texts.select("doc_id", n(X.lexical_tokens("text")).alias("nb_words"),
                         X.sentence_count("text").cast("long").alias("nb_sentences"))
    return tok.withColumn("words_per_sentence", F.round(X.ratio(F.col("nb_words"), F.col("nb_sentences")), 6))


@register(
    "l4_type_token_ratio", f"WITH {METRICS_SQL} SELECT doc_id, vocab_size_doc, round(ttr, 6) AS ttr FROM lex"
)
def _(t: Tables) -> DataFrame:
    m = L.lexical_metrics(t.texts.select("doc_id", "text"), "text")
    return m.select("doc_id", F.col("vocab_size_doc").cast("long").alias("vocab_size_doc"), F.round("ttr", 6).alias("ttr"))


@register("l5_hapax_ratio", f"WITH {METRICS_SQL} SELECT doc_id, round(hapax_ratio, 6) AS hapax_ratio FROM lex")
def _(t: Tables) -> DataFrame:
    m = L.lexical_metrics(t.texts.select("doc_id", "text"), "text")
    return m.select("doc_id", F.round("hapax_ratio", 6).alias("hapax_ratio"))


@register("lexical_metrics", "WITH " + METRICS_SQL + """ SELECT doc_id, nb_words, nb_sentences,
  round(words_per_sentence, 6) AS words_per_sentence, vocab_size_doc, round(ttr, 6) AS ttr,
  round(hapax_ratio, 6) AS hapax_ratio FROM lex""")
def lexical_profile(t: Tables) -> DataFrame:
    m = L.lexical_metrics(t.texts.select("doc_id", "text"), "text")
    counts = [F.col(c).cast("long").alias(c) for c in ("nb_words", "nb_sentences", "vocab_size_doc")]
    return m.select("doc_id", *counts, *[F.round(c, 6).alias(c) for c in ("words_per_sentence", "ttr", "hapax_ratio")])


@register("a9_metric_means", "WITH " + METRICS_SQL + " SELECT " + ", ".join(
    f"round(avg({m}), 6) AS avg_{m}" for m in L.METRICS) + " FROM lex")
def _(t: Tables) -> DataFrame:
    means = L.metric_means(L.lexical_metrics(t.texts.select("text"), "text"))
    return means.select([F.round(c, 6).alias(c) for c in means.columns])


@register(
    "a11_corpus_statistics",
    f"""WITH c AS (SELECT x, count(*) AS n FROM (SELECT unnest({Q.lexical()}) AS x FROM documents) GROUP BY x)
    SELECT sum(n)::BIGINT AS total_words, count(*) AS vocab_size, count(*) FILTER (n = 1) AS hapax_corpus,
           round(count(*) / sqrt(2 * sum(n)), 6) AS corrected_ttr FROM c""",
)
def corpus_statistics(t: Tables) -> DataFrame:
    stats = L.corpus_statistics(t.texts, "text")
    return stats.withColumn("corrected_ttr", F.round("corrected_ttr", 6))


@register("l6_newlines_to_blank", r"SELECT doc_id, regexp_replace(text, '\n+', ' ', 'g') AS text FROM documents")
def _(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", X.newlines_to_blank("text").alias("text"))


@register(
    "l7_symbol_removal",
    f"SELECT doc_id, regexp_replace(text, '[^{X.WORD_CHARS}{X.BLANKS}.,;!?]', '', 'g') AS text FROM documents",
)
def _(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", X.remove_symbols("text").alias("text"))


BORDERED = rf"(\A|[^{X.WORD_CHARS}])\p{{Nd}}{{1,2}}(\z|[^{X.WORD_CHARS}])"


# The border after a number may be the border before the next one, so the pattern is applied twice.
@register(
    "l8_isolated_numbers",
    rf"SELECT doc_id, regexp_replace(regexp_replace(text, '{BORDERED}', '\1\2', 'g'), '{BORDERED}', '\1\2', 'g') AS text FROM documents",
)
def _(t: Tables) -> DataFrame:
    return t.texts.select("doc_id", X.remove_isolated_numbers("text").alias("text"))


@register("l9_token_filter", f"SELECT doc_id, len({Q.cleaned()}) AS n_tokens, array_to_string({Q.cleaned()}, ' ') AS tokens FROM documents")
def _(t: Tables) -> DataFrame:
    return tokens(t).select("doc_id", n("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@register(
    "l10_stop_list",
    f"""SELECT conv_id, turn, array_to_string([x FOR x IN string_split(lower(text), ' ')
    IF x NOT IN ({', '.join("'" + w + "'" for w in X.FRENCH_STOP_WORDS)})], ' ') AS kept FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    remover = StopWordsRemover(
        inputCol="words", outputCol="kept", stopWords=StopWordsRemover.loadDefaultStopWords("french"),
        caseSensitive=True,
    )
    split = t.conversations.select("conv_id", "turn", F.split(F.lower("text"), " ").alias("words"))
    return remover.transform(split).select("conv_id", "turn", F.array_join("kept", " ").alias("kept"))


@register(
    "l11_lemma_lookup",
    f"""WITH tok AS (SELECT doc_id, generate_subscripts(k, 1) AS pos, unnest(k) AS form
                 FROM (SELECT doc_id, {Q.cleaned()} AS k FROM documents)),
    lem AS (SELECT DISTINCT form, left(form, length(form) - 1) AS lemma FROM tok WHERE form LIKE '%s'),
    j AS (SELECT doc_id, string_agg(coalesce(lemma, form), ' ' ORDER BY pos) AS lemmas
          FROM tok LEFT JOIN lem USING (form) GROUP BY doc_id)
    SELECT doc_id, coalesce(lemmas, '') AS lemmas FROM documents LEFT JOIN j USING (doc_id)""",
)
def _(t: Tables) -> DataFrame:
    docs = tokens(t)
    forms = unnest(docs.select(F.array_distinct("tokens").alias("s")), "s", "form", []).where(F.col("form").endswith("s"))
    table = forms.distinct().withColumn("lemma", F.expr("substring(form, 1, length(form) - 1)"))
    return L.lemmatise(docs, "doc_id", "tokens", table).select("doc_id", F.array_join("lemmas", " ").alias("lemmas"))


@register("l12_clean_text", f"SELECT doc_id, array_to_string({Q.cleaned()}, ' ') AS clean_text FROM documents")
def _(t: Tables) -> DataFrame:
    return L.preprocess_text(t.texts, "doc_id", "text", use_lemma=False)


@register(
    "l12_clean_text_lemmas",
    f"""WITH tok AS (SELECT doc_id, generate_subscripts(k, 1) AS pos, unnest(k) AS form
                 FROM (SELECT doc_id, {Q.cleaned()} AS k FROM documents)),
    lem AS (SELECT DISTINCT form, left(form, 4) AS lemma FROM tok WHERE length(form) > 6),
    j AS (SELECT doc_id, string_agg(coalesce(lemma, form), ' ' ORDER BY pos) AS clean_text
          FROM tok LEFT JOIN lem USING (form) GROUP BY doc_id)
    SELECT doc_id, coalesce(clean_text, '') AS clean_text FROM documents LEFT JOIN j USING (doc_id)""",
)
def _(t: Tables) -> DataFrame:
    docs = materialised(tokens(t), "tokens")
    forms = unnest(docs.select(F.array_distinct("tokens").alias("s")), "s", "form", []).where(F.length("form") > 6)
    table = forms.distinct().withColumn("lemma", F.substring("form", 1, 4))
    return L.preprocess_text(t.texts, "doc_id", "text", lemmas=table)


@register(
    "l16_document_name",
    r"""SELECT doc_id, regexp_replace(source || '-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END,
    '\.txt$', '') AS name FROM documents""",
)
def _(t: Tables) -> DataFrame:
    extension = F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt")
    file_name = F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), extension)
    return t.documents.select("doc_id", X.document_name(file_name).alias("name"))


@register(
    "a10_document_frequency",
    f"""SELECT term, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest({Q.cleaned()}) AS term FROM documents)
    GROUP BY term""",
)
def _(t: Tables) -> DataFrame:
    return L.document_frequency(tokens(t), "tokens")


RARE_SQL = f"""tok AS (SELECT doc_id, generate_subscripts(k, 1) AS pos, unnest(k) AS term
             FROM (SELECT doc_id, {Q.cleaned()} AS k FROM documents)),
v AS (SELECT term FROM tok GROUP BY term HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT doc_id, string_agg(term, ' ' ORDER BY pos) AS kept FROM tok JOIN v USING (term) GROUP BY doc_id)"""


@register(
    "l13_rare_word_filter",
    f"WITH {RARE_SQL} SELECT doc_id, coalesce(kept, '') AS clean_text_filtered FROM documents LEFT JOIN j USING (doc_id)",
)
def rare_words(t: Tables) -> DataFrame:
    kept = L.filter_rare_words(materialised(tokens(t), "tokens"), "doc_id", "tokens", 5)
    return kept.select("doc_id", F.array_join("tokens_filtered", " ").alias("clean_text_filtered"))


@register(
    "j2_vocabulary_semi_join",
    f"""WITH tok AS (SELECT doc_id, unnest({Q.cleaned()}) AS term FROM documents),
    v AS (SELECT DISTINCT unnest({Q.cleaned()}) AS term FROM conversations)
    SELECT d.doc_id, count(v.term) AS n_known FROM documents d LEFT JOIN tok USING (doc_id)
    LEFT JOIN v ON v.term = tok.term GROUP BY d.doc_id""",
)
def _(t: Tables) -> DataFrame:
    spoken = L.document_frequency(t.conversations.select(X.clean_tokens("text").alias("tokens")), "tokens")
    kept = L.keep_vocabulary(tokens(t), "doc_id", "tokens", spoken, "known")
    return kept.select("doc_id", n("known").alias("n_known"))


@register(
    "a12_class_terms",
    f"""WITH tok AS (SELECT lang, unnest({Q.cleaned()}) AS term FROM documents),
    c AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c)
    SELECT lang, term, n, rank, round(n / max(n) OVER (PARTITION BY lang)::DOUBLE, 6) AS rel_freq FROM r WHERE rank <= 25""",
)
def class_terms(t: Tables) -> DataFrame:
    top = L.class_terms(tokens(t), "lang", "tokens", 25)
    return top.withColumns({"rank": F.col("rank").cast("long"), "rel_freq": F.round("rel_freq", 6)})


@register(
    "u2_word_set",
    f"SELECT doc_id, array_to_string(list_sort(list_distinct({Q.cleaned()})), ' ') AS words FROM documents",
)
def _(t: Tables) -> DataFrame:
    return tokens(t).select("doc_id", F.array_join(F.sort_array(F.array_distinct("tokens")), " ").alias("words"))


@register(
    "l18_percent_format",
    """SELECT doc_id, printf('%s (%.1f%%)', lang, 100 * n_chars / (SELECT max(n_chars) FROM documents)::DOUBLE) AS shown
    FROM documents""",
)
def _(t: Tables) -> DataFrame:
    longest = t.documents.agg(F.max("n_chars")).first()[0]
    return t.documents.select("doc_id", X.with_percent(F.col("lang"), F.col("n_chars") / F.lit(float(longest))).alias("shown"))


@register(
    "l19_numeric_functions",
    """SELECT c_custkey, round(abs(c_acctbal), 1) AS size, round(sqrt(abs(c_acctbal)), 6) AS root,
    c_mktsegment IS NOT DISTINCT FROM 'BUILDING' AS is_building FROM customer""",
)
def _(t: Tables) -> DataFrame:
    size = F.abs("c_acctbal")
    return t.customer.select(
        "c_custkey", F.round(size, 1).alias("size"), F.round(F.sqrt(size), 6).alias("root"),
        F.col("c_mktsegment").eqNullSafe("BUILDING").alias("is_building"),
    )


@register(
    "l20_sign_class",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'positive' WHEN c_acctbal < 0 THEN 'negative' ELSE 'zero' END AS sign
    FROM customer""",
)
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.sign_class("c_acctbal").alias("sign"))


@register(
    "l21_status_text",
    """SELECT doc_id, CASE WHEN quality IS DISTINCT FROM toxic THEN '❌ Erreur' ELSE '✅ Atopique' END AS status FROM labels""",
)
def _(t: Tables) -> DataFrame:
    from folioscope.operators.outliers import status_text

    return t.labels.select("doc_id", status_text(F.col("quality"), F.col("toxic")).alias("status"))


# -- vectors ----------------------------------------------------------------------------------------------------------


@register(
    "v1_word_ngrams",
    f"""WITH k AS (SELECT doc_id, {Q.cleaned()} AS k FROM documents),
    g AS (SELECT doc_id, unnest(k) AS gram FROM k UNION ALL
          SELECT doc_id, k[i] || ' ' || k[i + 1] FROM (SELECT doc_id, k, unnest(range(1, len(k))) AS i FROM k))
    SELECT doc_id, gram, count(*) AS n FROM g GROUP BY doc_id, gram""",
)
def _(t: Tables) -> DataFrame:
    grams = V.with_bigrams(tokens(t).select("doc_id", "tokens"), "tokens", "grams")
    counted = with_term_counts(grams.select("doc_id", "grams"), "grams")
    return unnest(counted, "terms", "g", ["doc_id"]).select("doc_id", F.col("g.term").alias("gram"), F.col("g.tf").alias("n"))


@register("v2_capped_vocabulary", f"WITH {Q.tfidf(MAX_FEATURES)} SELECT term, total, n_docs FROM vocab")
def _(t: Tables) -> DataFrame:
    return V.capped_vocabulary(tokens(t), "tokens", MAX_FEATURES)


@register(
    "v3_idf",
    f"""WITH {Q.tfidf(MAX_FEATURES)} SELECT term,
    round(ln((1 + (SELECT count(*) FROM documents)) / (1 + n_docs)::DOUBLE) + 1, 6) AS idf FROM vocab""",
)
def _(t: Tables) -> DataFrame:
    docs = tokens(t)
    return V.capped_vocabulary(docs, "tokens", MAX_FEATURES).select(
        "term", F.round(V.smoothed_idf(F.col("n_docs"), F.lit(docs.count())), 6).alias("idf")
    )


@register("v4_tfidf_postings", f"WITH {Q.tfidf(MAX_FEATURES)} SELECT doc_id, term, round(w, 6) AS w FROM w")
def tfidf_postings(t: Tables) -> DataFrame:
    docs = materialised(tokens(t), "tokens")
    model = V.TfidfVectorizer(maxFeatures=MAX_FEATURES).fit(docs)
    names = F.broadcast(V.feature_names(docs, model))
    long = V.postings(model.transform(docs), "features", ["doc_id"])
    return long.join(names, "idx").select("doc_id", "term", F.round("w", 6).alias("w"))


FEATURE_NAMES_SQL = (
    f"WITH {Q.tfidf(MAX_FEATURES)} SELECT (row_number() OVER (ORDER BY total DESC, term) - 1)::INTEGER AS idx, term FROM vocab"
)


@register("v5_feature_names", FEATURE_NAMES_SQL)
def _(t: Tables) -> DataFrame:
    docs = tokens(t)
    return V.feature_names(docs, V.TfidfVectorizer(maxFeatures=MAX_FEATURES).fit(docs))
