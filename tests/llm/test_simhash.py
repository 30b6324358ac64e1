import random
import re

import numpy as np
import pytest
import xxhash

from folioscope.llm.simhash import Forest, block_masks, fingerprint, near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [words[i : i + 4] for i in range(len(words) - 3)] or [words]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, radius):
    label = list(range(len(codes)))
    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_trees_find_what_brute_force_finds():
    rng = random.Random(3)
    shards, codes = [], []
    for shard in range(6):
        centre = rng.getrandbits(64)
        own = {centre} | {rng.getrandbits(64) for _ in range(20 * shard)}
        for _ in range(60):
            own.add(centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(9))}))
        shards += [shard] * len(own)
        codes += rng.sample(sorted(own), len(own))
    shards, codes = np.array(shards), np.array(codes, np.uint64)
    forest = Forest(shards, codes)
    found = {(int(a), int(b)) for x, y in forest.hits(4) for a, b in zip(x, y, strict=True)}
    expected = {
        (i, j) for i in range(len(codes)) for j in range(i)
        if shards[i] == shards[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 4
    }
    assert found == expected
    parts = forest.parts(4)
    for shard in range(6):
        at = np.flatnonzero(shards == shard)
        assert (parts[at] - at[0]).tolist() == brute_components([int(c) for c in codes[at]], 4)


def test_every_level_deals_all_bits():
    for level in range(9):
        masks = [m % (1 << 64) for m in block_masks(level, 4)]
        assert sum(masks) == (1 << 64) - 1 and all(m.bit_count() >= 12 for m in masks)


def documents():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice((3, 4, 9, 40, 300)))) for _ in range(40)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    template = base[-1] + " " + " ".join(rng.choice(words) for _ in range(300))
    for i in range(120):  # near copies of one template, of which many differ in a few bits
        changed = template.split()
        for _ in range(i % 4):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        rows.append((1000 + i, (" \t\n\r\x0b\x0c"[i % 6]).join(changed)))
    rows += [(1, None), (2, ""), (3, " \n "), (4, "One Two"), (5, "one two"), (6, "É one"), (7, "é one"),
             (8, "x\x1cy\x85z a"), (9, "long " * 200_000), (None, base[0]), (None, None), (100, base[0]), (100, "other")]
    return rows


@pytest.mark.parametrize("shard_size", [4096, 50])
def test_equals_brute_force(spark, shard_size):
    rows = documents()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, code int, `a.b` string")
    found = near_duplicates(docs.repartition(5), shard_size=shard_size)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    codes = [brute_fingerprint(t) for _, t in rows]
    assert [fingerprint(t) for _, t in rows] == codes
    label = brute_components(codes, 4)
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    expected = [(i, f"{c:016x}", least.get(x)) for (i, _), c, x in zip(rows, codes, label, strict=True)]
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected, key=order)
    assert len({c for (i, _), c in zip(rows, codes, strict=True) if i and i >= 1000}) > 8


def test_no_rows_and_no_links(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).collect() == []
    found = near_duplicates(spark.createDataFrame([(5, "a b c d e f"), (4, "g h i j k l m")], schema)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(4, 4), (5, 5)]
