import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm.line_dedup import aligned, common_blocks, dedup_lines, paired, run_hashes

SCHEMA = "doc_id long, text string, gone string, n_chars long"
LONG = [f"this is a rather long line number {i} of the text" for i in range(12)]


def run(spark, rows):
    got = dedup_lines(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)).collect()
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=repr)


def test_alignment_is_patience():
    assert aligned([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert aligned([1, 9, 2, 3], [1, 2, 8, 3]) == [(0, 0), (2, 1), (3, 3)]
    assert aligned([1, 2], [3, 4]) == [] and aligned([], [1]) == []
    assert common_blocks([1, 2, 3, 4], [7, 2, 3, 8], [30, 30, 30, 30], 50) == [1, 2]
    assert common_blocks([1, 2, 3, 4], [7, 2, 8, 3], [30, 30, 30, 30], 50) == []


def test_later_document_loses_the_block(spark):
    first, second = "\n".join(LONG[:6]), "\n".join(["own start", *LONG[2:5], "", "own end"])
    found = run(spark, [(2, second), (1, first), (3, "nothing shared here at all")])
    assert found == [(1, first, 6, 0), (2, "own start\n\nown end", 5, 3), (3, "nothing shared here at all", 1, 0)]


def test_groups_of_copies_and_frequent_lines(spark):
    text = "\n".join(LONG)
    rows = [(i, text) for i in range(40)] + [(100 + i, f"own {i}\n" + LONG[3] * 2) for i in range(30)]
    found = {d: (t, n) for d, t, _, n in run(spark, rows)}
    assert found[0] == (text, 0) and all(found[i] == ("", 12) for i in range(1, 40))
    assert found[100][1] == 0 and all(found[100 + i] == (f"own {i}", 1) for i in range(1, 30))


def test_odd_rows(spark):
    text = "\n".join(LONG)
    found = run(spark, [(None, text), (1, None), (2, ""), (3, "\n \n"), (5, text), (5, text), (4, "The.\nThe."), (6, "The.\nThe.")])
    assert all(n == 0 for _, _, _, n in found) and len(found) == 8
    docs = spark.createDataFrame([(1, "a", "x", 1)], SCHEMA)
    assert dedup_lines(docs.where(F.lit(False))).collect() == []
    assert dedup_lines(docs).columns == ["doc_id", "text", "gone", "n_chars", "n_lines", "n_removed"]


def brute(rows, min_chars=50):
    """Every document aligned with every earlier one: the places of its lines that go."""
    texts = {d: [s.strip() for s in t.split("\n") if s.strip()] for d, t in rows}
    gone = {d: set() for d in texts}
    for later, a in texts.items():
        for earlier, b in texts.items():
            if earlier < later:
                gone[later] |= set(common_blocks(a, b, [len(s) for s in a], min_chars))
    return {d: [s for i, s in enumerate(lines) if i not in gone[d]] for d, lines in texts.items()}


def test_block_of_frequent_lines_is_found(spark):
    """Each line has many holders, the block of both only two."""
    x, y = "a line that many others hold", "and another one held by many"
    rows = [(i, f"{x}\nother {i}") for i in range(20)] + [(50 + i, f"{y}\nelse {i}") for i in range(20)]
    rows += [(100, f"{x}\n{y}"), (101, f"own\n{x}\n{y}\nend")]
    found = {d: (t, n) for d, t, _, n in run(spark, rows)}
    assert found[101] == ("own\nend", 2) and all(n == 0 for d, (_, n) in found.items() if d != 101)


def test_block_ends_with_a_short_line(spark):
    """The short line is in the block of two documents, but not in that of the first holder of the long line."""
    rows = [(1, LONG[0] * 2 + "\nalone"), (2, LONG[0] * 2 + "\nshort"), (3, LONG[0] * 2 + "\nshort")]
    found = {d: t for d, t, _, _ in run(spark, rows)}
    assert found == {1: rows[0][1], 2: "short", 3: ""}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    """Documents of ordered paragraphs with own lines between them, short and long lines, frequent and rare ones."""
    rng = np.random.default_rng(seed)
    parts = [[f"part {p} line {i} " + "w" * int(rng.integers(0, 45)) for i in range(rng.integers(1, 5))] for p in range(12)]
    rows = []
    for doc in rng.permutation(90).tolist():
        lines = []
        for p in np.flatnonzero(rng.random(12) < (0.8 if doc % 3 else 0.2)):
            lines += [f"own {doc} {p}"] * int(rng.integers(0, 2)) + parts[p]
        rows.append((doc, "\n".join(lines)))
    want = brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {d: [s.strip() for s in t.split("\n") if s.strip()] for d, t, _, _ in got} == want
    assert any(n for _, _, _, n in got)


def test_runs_by_hand():
    hashes, sizes, ends = np.array([5, 6, 7, 5, 6], np.uint64), np.array([30, 30, 60, 30, 30]), np.array([3, 3, 3, 5, 5])
    first, runs = run_hashes(hashes, sizes, ends, 50)
    by = sorted(zip(first.tolist(), runs.tolist()))
    assert [f for f, _ in by] == [0, 0, 1, 2, 2, 3, 3]
    assert by[0][1] == by[1][1] == by[5][1] == by[6][1] and len({r for _, r in by}) == 3


def test_every_holder_has_an_earlier_partner():
    rng = np.random.default_rng(4)
    rows = sorted(map(tuple, rng.integers(0, [6, 20, 3], (200, 3)).tolist()))
    for size in (1, 9, 500):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], names=["run", "doc", "row"])
            for i in range(0, len(rows), size)
        ]
        found = {tuple(r.values()) for b in paired(iter(batches)) for r in b.to_pylist()}
        pairs = {f for f in found if f[3] is not None}
        want = set()
        for r in rows:
            earlier = [s for s in rows if s[0] == r[0] and s[1] < r[1]]
            if earlier:
                want |= {(*r, *earlier[0][1:]), (*r, *earlier[-1][1:])}
        assert pairs == want
        assert {f[:3] for f in found - pairs} == {r for r in rows if r[:2] == rows[0][:2]} | {rows[-1]}


def test_long_text(spark):
    lines = [f"line {i} of a very long text" for i in range(20_000)]
    found = {d: n for d, _, _, n in run(spark, [(1, "\n".join(lines)), (2, "\n".join([*lines[:9000], "new", *lines[9000:]]))])}
    assert found == {1: 0, 2: 20_000}
