"""SQL fragments shared by the oracle statements. They restate the definitions; no Spark code is involved."""

from __future__ import annotations

from folioscope.functions.text import BLANKS, STOP_WORDS, WORD_CHARS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def lexical(text: str = "text") -> str:
    return (
        f"[x FOR x IN string_split_regex(regexp_replace(lower({text}), '[^{WORD_CHARS}{BLANKS}]', '', 'g'), "
        f"'[{BLANKS}]+') IF x <> '']"
    )


def cleaned(text: str = "text") -> str:
    return (
        f"[x FOR x IN string_split_regex(lower(regexp_replace({text}, '[^{WORD_CHARS}{BLANKS}.,;!?]', '', 'g')), "
        f"'[{BLANKS}.,;!?]+') IF regexp_full_match(x, '\\p{{L}}{{3,}}') AND x NOT IN ({STOPS})]"
    )


def sentences(text: str = "text") -> str:
    return (
        f"len([x FOR x IN string_split_regex({text}, '[.!?]+') "
        f"IF regexp_matches(x, '[^{BLANKS}]')])"
    )


def tfidf(max_features: int = 1000) -> str:
    """``tok, tf, vocab, raw, w``: unit TF-IDF weights of the cleaned documents, ``lang`` as the class."""
    return f"""
tok AS (SELECT doc_id, lang, unnest({cleaned()}) AS term FROM documents),
tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM tok GROUP BY doc_id, lang, term),
vocab AS (SELECT term, sum(tf)::BIGINT AS total, count(*) AS n_docs FROM tf GROUP BY term
          ORDER BY total DESC, term LIMIT {max_features}),
raw AS (SELECT doc_id, lang, term,
               tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + n_docs)::DOUBLE) + 1) AS r
        FROM tf JOIN vocab USING (term)),
w AS (SELECT doc_id, lang, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


def centroids(max_features: int = 1000) -> str:
    """Adds ``cs`` (class sums), ``cn`` (their norms), ``dist`` (distance to the own centroid)."""
    return tfidf(max_features) + """,
cs AS (SELECT lang, term, sum(w) AS s FROM w GROUP BY lang, term),
cn AS (SELECT lang, sqrt(sum(s * s)) AS norm FROM cs GROUP BY lang),
dist AS (SELECT doc_id, 1 - sum(w.w * s) / (sqrt(sum(w.w * w.w)) * any_value(norm)) AS d
         FROM w JOIN cs USING (lang, term) JOIN cn USING (lang) GROUP BY doc_id)"""


def class_model(max_features: int = 1000) -> str:
    """Adds ``coef`` (class means as coefficients), ``prob`` (softmax of cosines), ``ranked`` and ``top``."""
    return centroids(max_features) + """,
sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
coef AS (SELECT cs.lang AS class, term AS feature, s / n AS coef FROM cs JOIN sizes USING (lang)),
cosines AS (SELECT w.doc_id, cs.lang AS class, sum(w.w * cs.s / cn.norm) AS c
            FROM w JOIN cs USING (term) JOIN cn ON cn.lang = cs.lang GROUP BY w.doc_id, cs.lang),
prob AS (SELECT doc_id, lang, class, exp(c) / sum(exp(c)) OVER (PARTITION BY doc_id) AS p
         FROM (SELECT d.doc_id, d.lang, k.lang AS class, coalesce(c, 0) AS c
               FROM documents d CROSS JOIN sizes k LEFT JOIN cosines x ON x.doc_id = d.doc_id AND x.class = k.lang)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, class) AS rk FROM prob),
top AS (SELECT doc_id, any_value(lang) AS lang,
               max(CASE WHEN rk = 1 THEN class END) AS c1, max(CASE WHEN rk = 1 THEN p END) AS p1,
               max(CASE WHEN rk = 2 THEN class END) AS c2, max(CASE WHEN rk = 2 THEN p END) AS p2,
               max(CASE WHEN rk = 3 THEN p END) AS p3,
               max(CASE WHEN class = lang THEN p END) AS p_true
        FROM ranked GROUP BY doc_id)"""
