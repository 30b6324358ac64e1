from folioscope.operators import labels as L
from folioscope.plans.corpus import (
    corpus_for_readability, corpus_from_files, corpus_without_dual_labels, unmatched_keys,
)
from folioscope.sources.files import column_names, head, metadata_csv, preview, text_folder


def labelled(spark, sizes):
    rows = [(name,) for name, n in sizes.items() for _ in range(n)]
    return spark.createDataFrame(rows, "label string")


def test_valid_labels_and_audit(spark):
    frame = spark.createDataFrame([(None,), ("",), ("non mentionné",), ("PS",), ("PS",)], "label string")
    assert L.keep_valid_labels(frame, "label").count() == 2
    row = L.missing_label_audit(frame, ["label"]).first()
    assert tuple(row) == ("label", 1, 1, 1, 3, 5)
    assert {r.label: r.n for r in L.label_counts(frame, "label").collect()} == {"": 1, "non mentionné": 1, "PS": 2}
    assert L.drop_labels(frame, "label", ["PS"]).count() == 3


def test_threshold_is_inclusive(spark):
    frame = labelled(spark, {"a": 29, "b": 30, "c": 31})
    kept = {r.label for r in L.keep_frequent_labels(frame, "label", 30).select("label").distinct().collect()}
    assert kept == {"b", "c"} and L.frequent_label_count(frame, "label").first()[0] == 2


def test_bin_borders_and_total(spark):
    frame = labelled(spark, {"a": 9, "b": 10, "c": 49, "d": 50, "e": 120})
    rows = [tuple(r)[1:] for r in L.group_size_bins(frame, "label", total=True).orderBy("bin_order").collect()]
    assert rows == [
        ("0-10", 1, 9), ("10-20", 1, 10), ("20-30", 0, 0), ("30-40", 0, 0), ("40-50", 1, 49), ("50+", 2, 170),
        ("Total", 5, 238),
    ]
    assert L.append_total(L.group_size_bins(frame, "label")).count() == 7


def test_filters_accumulate(spark):
    frame = spark.createDataFrame([("a", "x"), ("", "x"), (None, "y")], "one string, two string")
    total = lambda cumulative: {
        r.column_name: r.n_documents
        for r in L.label_distribution(frame, ["one", "two"], cumulative=cumulative).where("bin = 'Total'").collect()
    }
    assert total(True) == {"one": 1, "two": 1} and total(False) == {"one": 1, "two": 3}


def test_broadcast_falls_back_to_a_join(spark, monkeypatch):
    monkeypatch.setattr(L, "measured_broadcast", lambda df: df)
    frame = labelled(spark, {"a": 29, "b": 30})
    assert L.keep_frequent_labels(frame, "label", 30).count() == 30


CSV = '''date,id,contexte-tour,contexte-election,titulaire-soutien,titulaire-liste
1981,A,1,leg,PS,"liste
deux"
1981,B,1,leg,,x
1981,C,2,leg,PS,x
1981,D,1,leg,non mentionné,x
1981,E,1,leg,"Union pour la démocratie française;Rassemblement pour la République",x
1981,F,1,leg,PS,x
'''


def files(tmp_path):
    (tmp_path / "m.csv").write_text(CSV, encoding="utf-8")
    folder = tmp_path / "txt"
    folder.mkdir()
    for name in "ABCDE":
        (folder / f"{name}.txt").write_text(f"texte {name}\nligne deux\n", encoding="utf-8")
    (folder / "Z.txt").write_bytes(b"octet \xff perdu")
    (folder / "note.md").write_text("ignored")
    return str(tmp_path / "m.csv"), str(folder)


def test_corpus_from_files(spark, tmp_path):
    csv, folder = files(tmp_path)
    meta = metadata_csv(spark, csv)
    assert meta.where("id = 'A'").first().list_name == "liste\ndeux"
    assert [r.column_name for r in column_names(meta).orderBy("position").collect()][:3] == ["date", "id", "round"]
    assert meta.where("id = 'B'").first().support is None
    texts = text_folder(spark, folder)
    assert {r.id for r in texts.collect()} == set("ABCDEZ")
    assert texts.where("id = 'A'").first().text_content == "texte A\nligne deux\n"
    corpus = {r.id: r.text_content for r in corpus_from_files(spark, csv, folder, 1).collect()}
    assert set(corpus) == {"A", "E", "F"} and corpus["F"] is None
    assert {r.id for r in corpus_from_files(spark, csv, folder, 2).collect()} == {"A", "F"}
    assert {r.id for r in corpus_without_dual_labels(spark, csv, folder, 1).collect()} == {"A", "F"}
    assert {r.id for r in corpus_for_readability(spark, csv, folder).collect()} == set("ABDEF")
    assert {(r.id, r.missing_from) for r in unmatched_keys(meta, texts).collect()} == {("F", "texts"), ("Z", "metadata")}
    first = preview(texts, "id", "text_content", 3, 5).collect()
    assert [r.id for r in first] == ["A", "B", "C"] and first[0].raw_preview == "texte"
    assert [r.id for r in head(meta, ["id"], "id", 2).collect()] == ["A", "B"]


def test_round_filter_reaches_the_scan(spark, tmp_path):
    csv, folder = files(tmp_path)
    plan = corpus_from_files(spark, csv, folder, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(contexte-tour), EqualTo(contexte-tour,1)" in plan.replace("`", "")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_exact_columns_are_read(spark):
    from folioscope.plans.catalog_corpus import corpus_overview
    from folioscope.plans.registry import Tables

    plan = corpus_overview(Tables(spark, "/root/testdata/sf0.001"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan
