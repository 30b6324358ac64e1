import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from folioscope.llm.sharding import ring, shard_by_ring, sized

SCHEMA = "doc_id long, text string, shard string, _cell int"


def placed(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA)
    return shard_by_ring(sized(docs), **options).collect()


def test_digest_slots_and_balance(spark):
    texts = [f"text number {i} " * (i % 7 + 1) for i in range(3000)] + [None, "", "é" * 5000]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    found = placed(spark, rows, shards=8)
    assert sorted(r.doc_id for r in found) == list(range(len(rows)))
    slots, loads = defaultdict(list), Counter()
    for r in found:
        content = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(content) + 16, zlib.crc32(content))
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(loads.values()) / 8, max(r.size for r in found)
    assert max(loads.values()) <= mean * 1.001 + most + 1


def test_equals_a_sequential_walk_round_by_round(spark):
    """The same rounds, written as loops over cells."""
    rows = [(i, "w" * (i % 50), None, None) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    table = sized(docs)
    bits, shards = 8, 5
    at = {r.doc_id: r.c for r in table.select(
        "doc_id", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits).cast("int").alias("c")).collect()}
    order = {r.cell: r.clockwise for r in ring(spark, shards, 16, bits).collect()}
    assert len(order) == 1 << bits and all(sorted(o) == list(range(shards)) for o in order.values())
    load = Counter()
    for r in table.collect():
        load[at[r.doc_id]] += r.size
    capacity = -(-int(sum(load.values()) * 1.001) // shards)
    held, home, waiting = [0] * shards, {}, sorted(load)
    while waiting:
        full, rest, ahead = [h >= capacity for h in held], [], held[:]
        for cell in waiting:
            s = next(s for s in order[cell] if not full[s])
            if ahead[s] < capacity:
                home[cell] = s
                held[s] += load[cell]
            else:
                rest.append(cell)
            ahead[s] += load[cell]
        waiting = rest
    found = shard_by_ring(table, shards=shards, virtual_nodes=16, cell_bits=bits).collect()
    assert {r.doc_id: r.shard for r in found} == {d: home[c] for d, c in at.items()}


def test_null_ids_repeated_rows_and_no_rows(spark):
    rows = [(None, "a", "s", 1), (None, None, "s", 1), (7, "b", "s", 1), (7, "b", "s", 1), (7, "c", None, None)]
    found = placed(spark, rows, shards=3)
    assert len(found) == 5
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert placed(spark, [], shards=3) == []


def test_another_shard_moves_few_documents(spark):
    rows = [(i, "same size", "x", 1) for i in range(4000)]
    before = {r.doc_id: r.shard for r in placed(spark, rows, shards=10)}
    after = {r.doc_id: r.shard for r in placed(spark, rows, shards=11)}
    assert sum(before[i] != after[i] for i in before) < 0.4 * len(rows)
