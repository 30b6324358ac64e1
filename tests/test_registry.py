"""The registered queries against their SQL, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
CHEAP = [
    "corpus_overview", "s6_unified_corpus", "p4_label_coarsening", "a5_group_size_bins", "a7_label_distribution",
    "l1_lexical_tokens", "lexical_metrics", "l13_rare_word_filter", "a12_class_terms", "v4_tfidf_postings",
    "d2_centroid_outliers", "a16_classification_report", "d9_outlier_dossier",
]


def values(table):
    names = sorted(table.column_names)
    return names, sorted(zip(*[table.column(n).to_pylist() for n in names]), key=repr)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, sql, name):
    ours = contract.queries()[name](spark, FOLDER).toArrow()
    assert values(ours) == values(sql.sql(contract.oracle_sql()[name]).to_arrow_table())


def test_every_oracle_has_a_query(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 4
