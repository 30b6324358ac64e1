"""Queries for sources, projections, filters, joins and label statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import coarse_label, truncated
from folioscope.operators import labels as L
from folioscope.plans.corpus import unified_corpus, unmatched_keys
from folioscope.plans.registry import Tables, register
from folioscope.session import scratch_path
from folioscope.sources.csv_records import csv_table
from folioscope.sources.files import head, metadata_csv, preview, text_folder

# A metadata table from the given ones: the first round is quality = 1, the label is the language.
METADATA_SQL = """SELECT doc_id, l.quality AS round, CASE WHEN source = 'src3' THEN 'non mentionné'
  WHEN source = 'src4' THEN '' WHEN source = 'src5' THEN NULL ELSE lang END AS support, source AS date, l.toxic
  FROM documents LEFT JOIN labels l USING (doc_id)"""


def metadata(t: Tables) -> DataFrame:
    support = (
        F.when(F.col("source") == "src3", L.PLACEHOLDER)
        .when(F.col("source") == "src4", "")
        .when(F.col("source") == "src5", F.lit(None))
        .otherwise(F.col("lang"))
    )
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left").select(
        "doc_id", F.col("quality").alias("round"), support.alias("support"), F.col("source").alias("date"), "toxic"
    )


def texts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("text").alias("text_content"))


@register(
    "corpus_overview",
    """SELECT lang, count(*) AS n_documents, round(avg(n_chars), 4) AS mean_chars
    FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL
    GROUP BY lang HAVING count(*) >= 45""",
)
def corpus_overview(t: Tables, threshold: int = 45) -> DataFrame:
    joined = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    labelled = joined.where(F.col("quality").isNotNull())
    return L.keep_frequent_labels(labelled, "lang", threshold).groupBy("lang").agg(
        F.count("*").alias("n_documents"), F.round(F.avg("n_chars"), 4).alias("mean_chars")
    )


@register("s1_csv_scan", f"SELECT doc_id::VARCHAR AS id, round, support, date FROM ({METADATA_SQL}) WHERE round = 1 AND support <> ''")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "metadata-csv")
    names = {"doc_id": "id", "round": "contexte-tour", "support": "titulaire-soutien", "date": "date"}
    source = metadata(t).select([F.col(c).alias(n) for c, n in names.items()])
    source.write.option("header", True).option("escape", '"').csv(path)
    scanned = metadata_csv(t.spark, path)
    return L.keep_round(scanned).where(F.col("support") != "")


@register(
    "s1_csv_split_scan",
    f"""SELECT doc_id::VARCHAR AS id, round::INT AS round, nullif(support, '') AS support, nullif(text, '') AS note
    FROM ({METADATA_SQL}) JOIN (SELECT doc_id, text FROM documents) USING (doc_id)""",
)
def _(t: Tables) -> DataFrame:
    # Whole texts, with their line breaks and quotes, as one column of the file.
    path = scratch_path(t.spark, "notes-csv")
    source = metadata(t).join(t.documents.select("doc_id", F.col("text").alias("note")), "doc_id")
    source = source.select(F.col("doc_id").alias("id"), F.col("note"), F.col("round").alias("contexte-tour"), "support")
    source.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    names = {"id": "id", "contexte-tour": "round", "support": "support", "note": "note"}
    return csv_table(t.spark, path, names, {"round": "int"})


@register("s2_text_folder", "SELECT item_id, text FROM benchmark")
def _(t: Tables) -> DataFrame:
    # One file per text, as the source format has it, from the table of short texts.
    path = scratch_path(t.spark, "texts")
    t.benchmark.select("item_id", "text").write.partitionBy("item_id").text(path)
    files = text_folder(t.spark, path, "item_id", "text", recursive=True, key_pattern=r"item_id=(\d+)/[^/]*\.txt$")
    # The text writer ends every document with a line break.
    return files.select(
        F.col("item_id").cast("long").alias("item_id"), F.regexp_replace("text", r"\n\z", "").alias("text")
    )


@register("s3_text_preview", "SELECT doc_id, left(text, 800) AS raw_preview FROM documents ORDER BY doc_id LIMIT 3")
def _(t: Tables) -> DataFrame:
    return preview(t.documents, "doc_id", "text")


@register("s4_head", f"SELECT doc_id, round, support FROM ({METADATA_SQL}) ORDER BY doc_id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return head(metadata(t), ["doc_id", "round", "support"], "doc_id")


UNIFIED_SQL = f"""WITH m AS ({METADATA_SQL}),
v AS (SELECT * FROM m WHERE round = 1 AND support IS NOT NULL AND support NOT IN ('', 'non mentionné')),
u AS (SELECT v.doc_id, v.round, v.support, v.date, d.text AS text_content FROM v LEFT JOIN documents d USING (doc_id)),
k AS (SELECT support FROM u GROUP BY support HAVING count(*) >= 30)
SELECT * FROM u WHERE support IN (SELECT support FROM k)"""


@register("s6_unified_corpus", UNIFIED_SQL)
def _(t: Tables) -> DataFrame:
    return unified_corpus(metadata(t), texts(t), "doc_id")


@register("s7_corpus_without_labels", UNIFIED_SQL + " AND support NOT IN ('fr', 'de')")
def _(t: Tables) -> DataFrame:
    return unified_corpus(metadata(t), texts(t), "doc_id", drop=["fr", "de"])


@register(
    "s8_corpus_for_readability",
    f"""SELECT m.doc_id, m.round, m.support, m.date, d.text AS text_content
    FROM ({METADATA_SQL}) m LEFT JOIN documents d USING (doc_id) WHERE m.round = 1""",
)
def _(t: Tables) -> DataFrame:
    return unified_corpus(metadata(t), texts(t), "doc_id", min_label_docs=None, keep_unlabelled=True)


@register("p1_column_selection", f"SELECT doc_id, round, support, date FROM ({METADATA_SQL})")
def _(t: Tables) -> DataFrame:
    return metadata(t).select("doc_id", "round", "support", "date")


@register("p2_derived_column", "SELECT doc_id, length(text) AS n_characters, n_chars / 2.0::DOUBLE AS half FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text", "n_chars").withColumns(
        {"n_characters": F.length("text").cast("long"), "half": F.col("n_chars") / 2.0}
    ).select("doc_id", "n_characters", "half")


PARTIES = {
    "MEDIUM": "Parti socialiste",
    "STANDARD": "Rassemblement pour la République",
    "LARGE": "Parti communiste français",
    "PROMO": "Ligue communiste révolutionnaire",
    "SMALL": "Front national",
}
PARTY_SQL = "CASE p_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PARTIES.items()) + " END"


def parties(t: Tables) -> DataFrame:
    name = F.lit(None).cast("string")
    for value, party in PARTIES.items():
        name = F.when(F.col("p_type") == value, party).otherwise(name)
    return t.part.select("p_partkey", "p_type", "p_brand", name.alias("label"))


@register(
    "p4_label_coarsening",
    f"""SELECT p_partkey, label, CASE WHEN label IS NULL THEN NULL
      WHEN lower(label) LIKE '%socialiste%' OR lower(label) LIKE '%radicaux de gauche%' THEN 'Bloc de Gauche'
      WHEN label LIKE '%République%' OR label LIKE '%démocratie française%' THEN 'Bloc de Droite'
      WHEN lower(label) LIKE '%communiste%' AND lower(label) NOT LIKE '%révolutionnaire%' THEN 'PCF'
      WHEN label LIKE '%Lutte ouvrière%' OR label LIKE '%Ligue communiste%' THEN 'Extrême Gauche'
      ELSE 'Autres' END AS bloc FROM (SELECT p_partkey, {PARTY_SQL} AS label FROM part)""",
)
def _(t: Tables) -> DataFrame:
    return parties(t).select("p_partkey", "label", coarse_label("label").alias("bloc"))


@register(
    "p5_label_truncation",
    """SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short_label
    FROM conversations""",
)
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", truncated("text").alias("short_label"))


@register(
    "f1_valid_label",
    f"SELECT * FROM ({METADATA_SQL}) WHERE support IS NOT NULL AND support <> '' AND support <> 'non mentionné'",
)
def _(t: Tables) -> DataFrame:
    return L.keep_valid_labels(metadata(t), "support")


@register("f2_round_filter", f"SELECT * FROM ({METADATA_SQL}) WHERE round = 1")
def _(t: Tables) -> DataFrame:
    return L.keep_round(metadata(t))


EXCLUDED = ["Brand#4;MEDIUM", "Brand#7;SMALL", "Brand#7;LARGE"]


@register(
    "f3_exclusion_list",
    """SELECT p_partkey, p_brand || ';' || p_type AS label FROM part
    WHERE coalesce(p_brand || ';' || p_type NOT IN ('Brand#4;MEDIUM', 'Brand#7;SMALL', 'Brand#7;LARGE'), true)""",
)
def _(t: Tables) -> DataFrame:
    dual = t.part.select("p_partkey", F.concat_ws(";", "p_brand", "p_type").alias("label"))
    return L.drop_labels(dual, "label", EXCLUDED)


@register("f4_point_lookup", "SELECT doc_id, text FROM documents WHERE doc_id = 42")
def _(t: Tables) -> DataFrame:
    return t.documents.where(F.col("doc_id") == 42).select("doc_id", "text")


@register("f5_mask_filter", "SELECT doc_id, quality FROM labels WHERE toxic = 1")
def _(t: Tables) -> DataFrame:
    return t.labels.where((F.col("toxic") == 1)).select("doc_id", "quality")


@register("f6_first_rows", "SELECT doc_id, quality FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 20")
def _(t: Tables) -> DataFrame:
    return t.labels.where(F.col("toxic") == 1).select("doc_id", "quality").orderBy("doc_id").limit(20)


@register("f7_distinct_labels", f"SELECT DISTINCT support FROM ({METADATA_SQL})")
def _(t: Tables) -> DataFrame:
    return metadata(t).select("support").distinct()


@register("j1_left_join", "SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text").join(t.labels, "doc_id", "left")


@register(
    "j1_unmatched_keys",
    """SELECT doc_id, 'texts' AS missing_from FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT doc_id, 'metadata' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    return unmatched_keys(t.documents, t.labels, "doc_id")


@register(
    "a1_frequent_labels",
    "SELECT * FROM part WHERE p_size IN (SELECT p_size FROM part GROUP BY p_size HAVING count(*) >= 30)",
)
def _(t: Tables) -> DataFrame:
    return L.keep_frequent_labels(t.part, "p_size", 30)


@register(
    "a2_missing_label_audit",
    f"""WITH m AS (SELECT * FROM ({METADATA_SQL}) WHERE round = 1)
    SELECT c AS column_name, n_null, n_empty, n_placeholder, n_null + n_empty + n_placeholder AS n_missing, n_rows FROM (
      SELECT 'support' AS c, count(*) FILTER (support IS NULL) AS n_null, count(*) FILTER (support = '') AS n_empty,
             count(*) FILTER (support = 'non mentionné') AS n_placeholder, count(*) AS n_rows FROM m
      UNION ALL
      SELECT 'date', count(*) FILTER (date IS NULL), count(*) FILTER (date = ''),
             count(*) FILTER (date = 'non mentionné'), count(*) FROM m)""",
)
def _(t: Tables) -> DataFrame:
    return L.missing_label_audit(L.keep_round(metadata(t)), ["support", "date"])


@register("a3_value_counts", f"SELECT support, count(*) AS n FROM ({METADATA_SQL}) WHERE support IS NOT NULL GROUP BY support")
def _(t: Tables) -> DataFrame:
    return L.label_counts(metadata(t), "support")


@register(
    "a4_frequent_label_count",
    "SELECT count(*) FILTER (n >= 30) AS n_frequent FROM (SELECT count(*) AS n FROM part GROUP BY p_size)",
)
def _(t: Tables) -> DataFrame:
    return L.frequent_label_count(t.part, "p_size")


def bins_sql(table: str, column: str, total: bool) -> str:
    bins = "(VALUES (0, '0-10', 0, 10), (1, '10-20', 10, 20), (2, '20-30', 20, 30), (3, '30-40', 30, 40), " \
           "(4, '40-50', 40, 50), (5, '50+', 50, 9223372036854775807)) b(bin_order, bin, lo, hi)"
    sql = f"""WITH c AS (SELECT count(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY {column}),
    h AS (SELECT bin_order, bin, count(n) AS n_modalities, coalesce(sum(n), 0)::BIGINT AS n_documents
          FROM {bins} LEFT JOIN c ON n >= lo AND n < hi GROUP BY bin_order, bin) SELECT * FROM h"""
    if total:
        sql += " UNION ALL SELECT 6, 'Total', sum(n_modalities)::BIGINT, sum(n_documents)::BIGINT FROM h"
    return sql


@register("a5_group_size_bins", bins_sql("orders", "o_custkey", False))
def _(t: Tables) -> DataFrame:
    return L.group_size_bins(t.orders, "o_custkey")


@register("a6_total_row", bins_sql("events", "user_id", True))
def _(t: Tables) -> DataFrame:
    return L.group_size_bins(t.events, "user_id", total=True)


@register("u1_union_total", bins_sql("supplier", "s_nationkey", True))
def _(t: Tables) -> DataFrame:
    return L.append_total(L.group_size_bins(t.supplier, "s_nationkey"))


def _distribution_sql(name: str, where: str) -> str:
    bins = "(VALUES (0, '0-10', 0, 10), (1, '10-20', 10, 20), (2, '20-30', 20, 30), (3, '30-40', 30, 40), " \
           "(4, '40-50', 40, 50), (5, '50+', 50, 9223372036854775807), (6, 'Total', 0, 9223372036854775807)) " \
           "b(bin_order, bin, lo, hi)"
    return f"""SELECT '{name}' AS column_name, bin_order, bin, count(n) AS n_modalities,
      coalesce(sum(n), 0)::BIGINT AS n_documents,
      (SELECT count(*) FROM (SELECT {name} FROM m WHERE {where} GROUP BY {name} HAVING count(*) >= 30)) AS n_frequent
      FROM {bins} LEFT JOIN (SELECT count(*) AS n FROM m WHERE {where} GROUP BY {name}) c ON n >= lo AND n < hi
      GROUP BY bin_order, bin"""


_VALID = "support IS NOT NULL AND support NOT IN ('', 'non mentionné')"


@register(
    "a7_label_distribution",
    f"WITH m AS ({METADATA_SQL}) " + _distribution_sql("support", _VALID) + " UNION ALL "
    + _distribution_sql("date", _VALID + " AND date IS NOT NULL"),
)
def _(t: Tables) -> DataFrame:
    return L.label_distribution(metadata(t), ["support", "date"])


@register(
    "a8_size_frequency",
    """SELECT n AS label_size, count(*) AS n_modalities FROM
    (SELECT count(*) AS n FROM orders GROUP BY o_custkey) WHERE n < 30 GROUP BY n""",
)
def _(t: Tables) -> DataFrame:
    return L.size_frequency(t.orders, "o_custkey")


@register(
    "w6_sort_by_value",
    "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand",
)
def _(t: Tables) -> DataFrame:
    return L.label_counts(t.part, "p_brand").orderBy(F.desc("n"), "p_brand")


@register(
    "l17_substring_tests",
    """SELECT c_custkey, contains(lower(c_mktsegment), 'build') AS folded, contains(c_mktsegment, 'build') AS exact
    FROM customer""",
)
def _(t: Tables) -> DataFrame:
    from folioscope.functions.text import contains

    segment = F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey", contains(segment, "build", True).alias("folded"), contains(segment, "build", False).alias("exact")
    )
