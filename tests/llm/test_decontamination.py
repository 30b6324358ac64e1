import numpy as np

from folioscope.llm.decontamination import RATIO, ItemIndex, TokenWords, best_stretch, contamination

SCHEMA = "doc_id long, text string, hits string"


def distance(item, text):
    """Edit distance to the nearest stretch, by the textbook table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_best_stretch_equals_the_table():
    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
        d, begin, end = best_stretch(item, text)
        assert d == distance(item.tolist(), text.tolist()) == distance(item.tolist(), text[begin:end].tolist())


def test_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(12, 40)))) for i in range(12)]
    rows = []
    for doc in range(80):
        words = rng.choice(vocabulary, 60).tolist()
        own = items[doc % 12][1].split()
        for _ in range(doc % 5 if doc % 2 else 0):
            at = rng.integers(0, len(own))
            own[at : at + 1] = [[], ["new"], ["a", "b"]][rng.integers(0, 3)]
        rows.append((doc, " ".join(words[:20] + (own if doc % 3 else []) + words[20:]).title(), None))
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, h.item_id) for r in contamination(docs, bench).collect() for h in r.hits}
    wanted = {(d, i) for d, text, _ in rows for i, item in items
              if distance(item.split(), text.lower().split()) <= int(RATIO * len(item.split()))}
    assert found <= wanted and len(found) >= 0.95 * len(wanted) > 0
    exact = {(d, i) for d, i in wanted if distance(items[i][1].split(), rows[d][1].lower().split()) == 0}
    assert exact <= found
    split = contamination(docs, bench, block_chars=500).collect()
    assert {(r.doc_id, h.item_id) for r in split for h in r.hits} == found


def test_odd_rows(spark):
    item = "one two three four five six seven eight"
    rows = [(None, item, "x"), (1, None, "x"), (2, "", "x"), (3, "!!! 123", None), (4, "word " * 20000 + item, None), (4, item, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame([(7, item), (None, item), (8, None), (9, "word"), (7, item)], "item_id long, text string")
    found = contamination(docs, bench).collect()
    assert sorted((r.doc_id or 0, [h.item_id for h in r.hits]) for r in found) == [
        (0, [7]), (1, []), (2, []), (3, []), (4, [7]), (4, [7, 9])]
    assert contamination(docs.limit(0), bench).collect() == []
    assert all(r.hits == [] for r in contamination(docs, bench.limit(0)).collect())
    assert ItemIndex([]).occurrences(TokenWords().of(item)) == []


def test_words_are_runs_of_letters_and_digits():
    words = TokenWords()
    texts = ["Ab cd", "ab_CD", "ab--cd!", "\tab\u00a0cd\n", "É1 ß², ab", "é1 SS²"]
    ids = [words.of(t).tolist() for t in texts]
    assert ids[0] == ids[1] == ids[2] == ids[3] and len(ids[0]) == 2 and ids[4][2] == ids[0][0]
    assert words.of("x" * 500 + " ab").tolist()[1] == ids[0][0] and len(words.of(" _ !")) == 0
    assert len({v for t in ("a", "aa", "aaa", "ba", "ab", "a1", "\U0001d7d9") for v in words.of(t).tolist()}) == 7


def test_short_items_match_as_whole_runs(spark):
    bench = spark.createDataFrame([(1, "Deep blue sea"), (2, "sea"), (3, "blue")], "item_id long, text string")
    rows = [(1, "the deep, BLUE sea is", None), (2, "deep sea blue", None), (3, "seaside", None), (4, "deep blue seas", None)]
    found = {r.doc_id: [h.item_id for h in r.hits] for r in contamination(spark.createDataFrame(rows, SCHEMA), bench).collect()}
    assert found == {1: [1, 2, 3], 2: [2, 3], 3: [], 4: [3]}


def test_recall_at_the_limit():
    """As many edits as are allowed, for each size: what brute force finds and the index doesn't."""
    rng = np.random.default_rng(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    for m in (5, 20, 60, 120):
        items = [(i, " ".join(rng.choice(vocabulary, m))) for i in range(60)]
        index, words, wanted, found = ItemIndex(items), TokenWords(), 0, 0
        for i, text in items:
            own = text.split()
            for _ in range(int(RATIO * m)):
                at = rng.integers(0, len(own))
                own[at : at + 1] = [[], ["new"], ["fresh", own[at]]][rng.integers(0, 3)]
            doc = [*rng.choice(vocabulary, 30), *own, *rng.choice(vocabulary, 30)]
            if distance(text.split(), doc) <= int(RATIO * m):
                wanted += 1
                found += i in {hit[0] for hit in index.occurrences(words.of(" ".join(doc)))}
        assert wanted > 50 and found >= 0.95 * wanted
