"""The registered queries of this subpackage. Each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.decontamination import contamination
from folioscope.llm.html_extraction import main_texts
from folioscope.llm.language_id import identify_languages
from folioscope.llm.line_dedup import dedup_lines
from folioscope.llm.neighbours import nearest_neighbours
from folioscope.llm.packing import packed_documents
from folioscope.llm.prefix_trie import prefix_trie
from folioscope.llm.sharding import shard_by_ring, sized
from folioscope.llm.similarity_join import jaccard_join
from folioscope.llm.simhash import near_duplicates
from folioscope.llm.substrings import dedup_substrings
from folioscope.llm.token_alignment import align_tokenizers
from folioscope.llm.toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        return build

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(divisor: int):
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@register("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = identify_languages(table(spark, folder, "documents"), remainder(3) != 1)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "entropy", "accepted")


@register("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"),
        F.coalesce(F.array_min("hits.distance"), F.lit(None).cast("int")).alias("least_distance"),
    )


@register("op3_neighbours")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@register("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), remainder(4) != 2)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


@register("op5_substring_dedup")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_substrings(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op7_html_extraction")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = main_texts(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(table(spark, folder, "documents"), tokenizer_file())


@register("op9_ring_sharding")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = shard_by_ring(sized(table(spark, folder, "documents")), shards=40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op6_jaccard_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join(table(spark, folder, "documents"))


@register("op10_line_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@register("op11_tokenizer_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return align_tokenizers(
        table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    )


@register("op12_prefix_trie")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


#: The CRC of a decimal number is worked out bit by bit; 3988292384 is its reflected polynomial.
ORACLES["op12_prefix_trie"] = """
WITH numbered AS (
  SELECT conv_id, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT conv_id, list(said ORDER BY place) AS turns, CAST(conv_id AS VARCHAR) AS spelt FROM numbered GROUP BY conv_id
), shared AS (
  SELECT conv_id, turns, xor(list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(1, len(spelt) + 1), lambda i: ascii(spelt[i])::BIGINT)),
           lambda crc, byte: list_reduce(
             list_prepend(xor(crc, byte), range(8)),
             lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)
         ), 4294967295::BIGINT) % 6 AS h
  FROM lists
), rebuilt AS (
  SELECT s.conv_id, CASE WHEN f.conv_id IS NULL THEN s.turns[s.h + 1:]
                         ELSE list_concat(f.turns[1:s.h], s.turns[s.h + 1:]) END AS turns
  FROM shared s LEFT JOIN lists f ON f.conv_id = s.conv_id - s.conv_id % 100
), reached AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt
), nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(len(turns)) AS longest,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth), ''))
           AS ends_sha256
  FROM reached GROUP BY turns[1:depth], depth
), above AS (
  SELECT path[1:up] AS path, depth - up AS below, longest = depth AS leaf,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].text) END AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM nodes)
), sums AS (
  SELECT path, count(*) FILTER (below = 1) AS n_children, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM above GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""


@register("op13_simhash")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))
