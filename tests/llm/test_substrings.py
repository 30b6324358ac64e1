import hashlib
import re

import numpy as np

from folioscope.llm.substrings import dedup_substrings, window_nodes

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, width):
    """Every window against every smaller id."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    first = {}
    for (doc, _, _), own in zip(rows, words):
        if doc is not None:
            for p in range(len(own) - width + 1):
                key = tuple(own[p : p + width])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _, _), own in zip(rows, words):
        gone = [False] * len(own)
        if doc is not None:
            for p in range(len(own) - width + 1):
                if first[tuple(own[p : p + width])] < doc:
                    gone[p : p + width] = [True] * width
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        out.append((doc, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    got = dedup_substrings(spark.createDataFrame(rows, SCHEMA), **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got), key=repr)


def test_nodes_are_the_leftmost_smallest():
    ids = np.random.default_rng(1).integers(0, 3, 60).astype(np.uint64)
    grams, owner = window_nodes(ids, 9, 3)
    for p in range(len(ids) - 8):
        assert owner[p] == p + int(np.argmin(grams[p : p + 7]))


def test_equals_brute_force_on_many_shapes(spark):
    rng = np.random.default_rng(3)
    passages = [[f"p{i}w{j}" for j in range(n)] for i, n in enumerate((8, 12, 13, 20, 40, 90))]
    rows = []
    for doc in rng.permutation(120).tolist():
        words = []
        for _ in range(rng.integers(1, 7)):
            kind = rng.integers(0, 4)
            if kind == 0:
                words += [f"u{doc}x{j}" for j in range(rng.integers(1, 30))]
            elif kind == 1:
                words += ["la", "le"] * int(rng.integers(1, 15))
            else:
                own = list(passages[rng.integers(0, len(passages))])
                if rng.random() < 0.3:
                    own[rng.integers(0, len(own))] = f"edit{doc}"
                words += own[rng.integers(0, 4) :]
        rows.append((doc, " ".join(words), None))
    rows += [(500 + i, rows[7][1], "copy") for i in range(30)]
    for width, k in ((12, 4), (12, 6), (20, 5)):
        assert found(spark, rows, width=width, k=k) == brute(rows, width)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(5, text, "x"), (5, text, "x"), (5, text + " more", "x"), (None, text, "x"), (9, None, "x"), (10, "", "x"),
            (11, " a b\x1c c", "x"), (12, "same " * 3000, None), (13, "same " * 60, None), (3, text[10:], "x")]
    assert found(spark, rows) == brute(rows, 50)
    assert found(spark, rows[:0]) == []
