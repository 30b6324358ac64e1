import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import folioscope.llm.similarity_join as module
from folioscope.llm.similarity_join import jaccard_join, matched_depth, walked, with_partner

SCHEMA = "doc_id long, text string, node string"


def brute(rows):
    sets = {}
    for doc, text, _ in rows:
        words = (text or "").split()
        n = min(5, len(words))
        sets[doc] = frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()
    docs, root = sorted(sets), {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    links = dict.fromkeys(docs, 0)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (find(d), links[d]) for d in docs}


def corpus():
    rng = np.random.default_rng(8)
    rows, base = [], [rng.choice(3000, rng.integers(30, 120)).astype(str).tolist() for _ in range(15)]
    for doc in rng.permutation(150).tolist():
        words = list(base[doc % 15])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = f"x{rng.integers(0, 9)}"
        rows.append((doc, " ".join(words), None))
    return rows + [(200, "a b c", None), (201, "a b c", None), (202, "", None), (203, None, None), (204, "a  b\nc", "z")]


def test_equals_brute_force(spark):
    rows = corpus()
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_CLASSES", 3)
    rows = corpus()
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, None, None)], SCHEMA)
    found = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard_join(docs).collect())
    assert found == [(0, None, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0)]
    assert jaccard_join(docs.limit(0)).collect() == []


def test_depth_meets_the_target():
    depth = matched_depth(32, 10, 0.8, 0.9995)
    assert 1 - (1 - 0.8**depth) ** 32 >= 0.9995 > 1 - (1 - 0.8 ** (depth + 1)) ** 32


def longest_shared(a, b):
    """Levels below the shortest prefix that two rows (tree, path, labels, node) share; -1 without a common node."""
    if a[:2] != b[:2]:
        return -1
    return 2 if a[2] == b[2] else 1 if a[2] >> 8 == b[2] >> 8 else 0


def test_walk_matches_at_the_longest_prefix():
    rng = np.random.default_rng(3)
    rows = sorted({(int(t), int(p), int(x) << 8 | int(y), int(n)) for t, p, x, y, n in rng.integers(0, [3, 4, 3, 3, 40], (300, 5))})
    for size in (1, 7, 1000):
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), (pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                names=["tree", "path", "labels", "node"],
            )
            for i in range(0, len(rows), size)
        ]
        found = [tuple(r.values()) for b in walked(iter(batches), 2) for r in b.to_pylist()]
        want = []
        for i in range(1, len(rows)):
            level = longest_shared(rows[i - 1], rows[i])
            if level >= 0:
                first = next(r for r in rows if longest_shared(r, rows[i]) >= level)
                if first[3] != rows[i][3]:
                    want.append((first[3], rows[i][3]))
        assert [f[:2] for f in found if f[1] is not None] == want
        outer = [f for f in found if f[1] is None]
        assert outer[0] == (rows[0][3], None, *rows[0][:2])
        assert outer[-1] == (next(r for r in rows if r[:2] == rows[-1][:2])[3], None, *rows[-1][:2])


def test_nodes_split_between_shards_stay_connected(spark):
    classes = spark.createDataFrame([(i, [7, 100 + i // 40], [5, 6]) for i in range(200)], "node long, nodes array<long>, labels array<int>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = [(r.a, r.b) for r in module.forest_matches(classes, 2).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, todo = {0}, [0]
    while todo:
        x = todo.pop()
        for y in {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x}:
            if y not in seen:
                seen.add(y)
                todo.append(y)
    assert seen == set(range(200)) and len(pairs) < 2 * 200


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.82, each pair a group of its own."""
    rng = np.random.default_rng(5)
    rows = []
    for pair in range(400):
        words = rng.integers(0, 10**9, 49).astype(str).tolist()
        rows += [(2 * pair, " ".join(words), None), (2 * pair + 1, " ".join(words[:-5] + ["y"] * 5), None)]
    a, b = (set(zip(*[rows[i][1].split()[k:] for k in range(5)])) for i in (0, 1))
    assert 0.8 <= len(a & b) / len(a | b) < 0.82
    found = jaccard_join(spark.createDataFrame(rows, SCHEMA)).where("n_links > 0").count()
    assert found >= 0.99 * len(rows)


def test_map_keeps_every_partner(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc"), F.hash("id").cast("long").alias("row"))
    wanted = rows.where("doc % 50 = 0")
    kept = {r.doc for r in with_partner(rows, wanted, "doc", "row").collect()}
    assert set(range(0, 5000, 50)) <= kept and len(kept) < 120


def test_template_joins_texts_without_linking_them(spark):
    """One template in all texts: a large group of candidates, and links only between the edited copies."""
    rng = np.random.default_rng(2)
    template = [f"t{i}" for i in range(30)]
    rows = []
    for doc in range(0, 120, 2):
        own = rng.integers(0, 10**9, 40).astype(str).tolist()
        rows += [(doc, " ".join(template + own), None), (doc + 1, " ".join(template + own[:-1]), None)]
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute(rows)


def test_long_text_and_clashing_columns(spark):
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, long, "a", "b"), (2, long + " end", "a", "b"), (3, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, map_word string, node string")
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join(docs).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
