"""The stages on tables with odd rows, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, row_key string, hits string"
WORDS = random.Random(1).sample([f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lt", "rn", "sk", "m", "pe")], 100)


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


ITEM = prose(900, 20)
TEXT = prose(7)
ROWS = [
    (3, TEXT), (5, TEXT), (5, prose(8)), (6, TEXT.rsplit(" ", 1)[0] + " changed"), (7, None), (8, ""), (9, " \n\t"),
    (None, prose(11)), (None, None), (10, prose(12) + " " + ITEM + " " + prose(13)), (11, prose(14, 30000)), (12, prose(15)),
    (12, prose(15)),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", "s", None if t is None else len(t), k, "r", "h") for k, (i, t) in enumerate(ROWS)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, i % 2) for i in (3, 5, 6, 8, None) if i is not None] + [(None, 1, 1), (9, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def ran(spark, stage, folder, docs):
    out = dict(P.STAGES)[stage](spark, docs, folder)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text, r["a.b"]) for r in out.collect()), key=repr)


def test_one_document_of_each_class_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone = {(5, TEXT), (6, ROWS[3][1])}
    expected = sorted(((i, t, k) for k, (i, t) in enumerate(ROWS) if (i, t) not in gone), key=repr)
    assert ran(spark, "n-gram Jaccard join", folder, docs) == expected


def test_contaminated_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = sorted(((i, t, k) for k, (i, t) in enumerate(ROWS) if i != 10), key=repr)
    assert ran(spark, "benchmark decontamination", folder, docs) == expected


@pytest.mark.parametrize("stage", ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination"])
def test_stages_keep_columns_and_take_empty_tables(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert ran(spark, stage, folder, docs.where(F.lit(False))) == []
    kept = ran(spark, stage, folder, docs.where("doc_id IN (7, 8, 9) OR doc_id IS NULL"))
    assert stage == "toxicity" or len(kept) == 5


def test_run_packs_what_the_stages_keep(spark, folder):
    pieces = P.run(spark, folder).collect()
    ids = {r.doc_id for r in pieces}
    assert 11 in ids and 10 not in ids and 6 not in ids
    fills = {}
    for r in pieces:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in fills.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
