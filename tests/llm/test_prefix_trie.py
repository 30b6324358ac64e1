import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from folioscope.llm.catalog import ORACLES
from folioscope.llm.prefix_trie import COLUMNS, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
        ends[whole[c]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    parents = {path[:-1] for path in members if path}
    for path, own_members in members.items():
        if path:
            children[path[:-1]] += 1
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in parents
            saved[path[:d]] += (len(own_members) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def found(spark, rows, schema=SCHEMA, **options):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    out = prefix_trie(frame, **options)
    assert tuple(out.columns) == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(260):
        said = [(rng.choice(("user", "assistant")), rng.choice("abc") * rng.randrange(1, 4)) for _ in range(rng.randrange(1, 8))]
        if c % 3 == 0:  # a very common conversation, at times with more behind it
            said = [("user", "hello é\U0001f600"), ("assistant", "hi")] + said[: c % 4]
        rows += [(c, t, *s) for t, s in enumerate(said)]
    long = [("user", f"turn {i}") for i in range(60)]
    for c, n in ((300, 60), (301, 60), (302, 33), (399, 17), (405, 60)):
        rows += [(c, t, *s) for t, s in enumerate(long[:n])]
    rows += [(-7, 0, "user", "x"), (-100, 1, "user", "y"), (-7, 1, None, None)]
    return rows


@pytest.mark.parametrize("shard_turns", [1 << 20, 40])
def test_equals_brute_force(spark, shard_turns):
    rows = conversations()
    assert found(spark, rows, shard_turns=shard_turns) == brute_force(rows)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [
        (100, None, "user", "first"), (100, 0, None, None), (100, 0, None, None), (100, 0, "b", ""), (100, 0, "a", "z"),
        (101, 5, "user", "first"), (101, 2, "", ""), (None, 1, "user", "nobody"), (107, 0, "user", "w " * 100_000),
        (108, 1, "user", "first"), (108, 1, "user", "first"),
    ]
    more = [(*r, 1, "x") for r in rows]
    schema = SCHEMA + ", depth int, `a.b` string"
    assert found(spark, more, schema) == brute_force(rows)


def test_few_and_no_conversations(spark):
    assert found(spark, []) == []
    rows = [(1, 0, "user", "gone: the first turns are another's")]
    assert found(spark, rows) == brute_force(rows)


def test_sql_says_the_same(spark):
    rows = conversations()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    said = con.execute(ORACLES["op12_prefix_trie"]).fetchall()
    assert sorted(tuple(-1 if v is None else v for v in r) for r in said) == brute_force(rows)
