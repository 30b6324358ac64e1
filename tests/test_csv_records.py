"""The split CSV scan against the reader that follows a file from its first byte."""

import random

import pytest

from folioscope.sources.csv_records import csv_records, csv_table

NAMES = {"id": "id", "contexte-tour": "round", "texte": "text"}


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few bytes: records, quotes and even line ends fall on their borders."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    for key, value in before.items():
        spark.conf.set(key, value)


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def by_one_task(spark, path, names):
    frame = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows(frame.select(*[frame[f"`{c}`"] for c in names]))


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if value is not None else ""


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_equals_the_reader_of_whole_files(spark, tmp_path, tiny_splits, size):
    draw = random.Random(size)
    parts = ["a", "é", '"', '""', ",", "\n", "\n\n", " ", ",\n", '",', "1"]
    lines = ["texte,id,contexte-tour"]
    for i in range(60):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(9)))
        plain = draw.choice(["x", "", 'un"deux', 'l"', quoted(text), quoted(text), quoted("\n" * 30)])
        lines.append(f"{plain},{i},{draw.choice([1, 2, ''])}")
    path = tmp_path / "m.csv"
    path.write_bytes("\n".join(lines).encode() + b"\n")
    expected = by_one_task(spark, str(path), list(NAMES))
    tiny_splits(size)
    assert rows(csv_table(spark, str(path), NAMES)) == expected and len(expected) == 60


def test_many_splits_are_read(spark, tmp_path, tiny_splits):
    path = tmp_path / "m.csv"
    path.write_text("id,texte\n" + "".join(f'{i},"a\nb,""c"\n' for i in range(200)))
    tiny_splits(100)
    found = csv_records(spark, str(path))
    assert found.select("block").distinct().count() > 10
    assert sorted(r.record for r in found.collect() if r.record != "id,texte") == sorted(f'{i},"a\nb,""c"' for i in range(200))


def test_columns_by_name_in_each_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes('id,contexte-tour,texte\r\n1,2,"x\r\ny"\r\n\r\n2,deux,""\r\n'.encode())
    (tmp_path / "in/b.csv").write_text("\ufefftexte,more,id\nz,0,3\n", encoding="utf-8")
    (tmp_path / "in/c.csv").write_text("texte,id\n")
    (tmp_path / "in/d.csv").write_text("")
    found = csv_table(spark, str(tmp_path / "in"), NAMES, {"round": "int"})
    assert rows(found) == sorted([("1", 2, "x\r\ny"), ("2", None, None), ("3", None, "z")], key=repr)


def test_nothing_but_a_header(spark, tmp_path):
    (tmp_path / "m.csv").write_text("id,texte")
    assert rows(csv_table(spark, str(tmp_path / "m.csv"), NAMES)) == []
