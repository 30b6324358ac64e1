"""Operator 6: n-gram Jaccard join by a MinHash LSH forest.

A document is the set of its runs of five words (words are what white space separates, unchanged; a text of one to
four words is one run). Documents with the same set are one class from the start.

* Forest: ``TREES`` sequences of ``DEPTH`` min-hashes per class, each the path of the class in a prefix tree. The trees
  are sorted paths, cut into range shards, so that a node of any size is walked by many tasks. A class is matched at the
  longest prefix that it shares with its neighbour in the order: the prefix is shortened level by level until it
  matches, and the first class of a node goes on to shorter ones. The shortest prefix is the longest at which two sets
  at the threshold share a node of some tree with the target recall; a class still alone there has no partner. Nodes
  that two shards share are connected through the shards' outer nodes.
* Groups: the connected components of these matches. A class meets only the classes of its group; each class is sent to
  its group once, or, where a group is too big for one task, to the pairs of its blocks. Pairs are never emitted: a task
  counts them. Texts without a partner are left behind by a bit map of fixed size before texts are exchanged.
* Verification: exact Jaccard similarity of all pairs of a group, by products of incidence matrices.

Result: every row with ``class_id`` (smallest id that a chain of links reaches), ``copy_id`` (smallest id with the
same set) and ``n_links`` (documents with other sets that it is linked to, and its copies). Rows without words, or
without an id, are alone; a row without an id has no class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import Hashes, components, materialised, mixed, row_groups, row_key, windowed_hash

SHINGLE = 5
THRESHOLD = 0.8
TREES = 44
DEPTH = 10
TARGET = 0.9995
#: Runs (8 bytes each) and classes that one task holds of one block.
BLOCK_RUNS, BLOCK_CLASSES = 1_500_000, 1024
#: Bits of a level's label below the shortest prefix, and of the number of bits in the map of texts with a partner.
LABEL_BITS, MAP_BITS = 8, 24


def shingles(text: str | None, hashes: Hashes, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the runs of ``width`` words, sorted."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windowed_hash(hashes.of(words), min(width, len(words))))


def matched_depth(trees: int, depth: int, threshold: float, target: float) -> int:
    """Shorten the prefix until two sets at the threshold share one in some tree with probability ``target``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def minhashes(runs: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """documents x n: minima of n hash functions over each document's runs; ``offsets`` has one entry per document."""
    factors = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(offsets), n), np.uint64)
    for j in range(n):
        out[:, j] = np.minimum.reduceat(runs * factors[j], offsets)
    return out


def signatures(rows: DataFrame, text: str, trees: int, depth: int, shortest: int) -> DataFrame:
    """``doc, row, set_a, set_b, size, nodes, labels`` of ``rows (doc, row, content)``: a hash of the set in two halves
    and, per tree, the node at the shortest prefix and the labels of the levels below it, in the order of the levels."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                sets = [shingles(t, hashes) for t in some.column(2).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list[list[int]] = [[] for _ in sets]
                labels: list[list[int]] = [[] for _ in sets]
                ends = np.zeros((len(sets), 2), np.int64)
                if full:
                    runs = np.concatenate([sets[i] for i in full])
                    sizes = np.array([len(sets[i]) for i in full])
                    offsets = np.cumsum(sizes) - sizes
                    least = minhashes(runs, offsets, trees * depth).reshape(len(full), trees, depth)
                    paths = np.zeros((len(full), trees), np.uint64) + np.arange(trees, dtype=np.uint64)
                    for d in range(shortest):
                        paths = mixed(paths * np.uint64(3) + least[:, :, d])
                    below = np.zeros((len(full), trees), np.int32)
                    for d in range(shortest, depth):
                        label = mixed(least[:, :, d]) & np.uint64((1 << LABEL_BITS) - 1)
                        below = (below << LABEL_BITS) | label.astype(np.int32)
                    digest = np.column_stack([np.add.reduceat(mixed(runs + np.uint64(j)), offsets) for j in (1, 2)]).view(np.int64)
                    for k, i in enumerate(full):
                        keys[i] = paths[k].view(np.int64).tolist()
                        labels[i] = below[k].tolist()
                        ends[i] = digest[k]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(ends[:, 0]), pa.array(ends[:, 1]),
                     pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64())),
                     pa.array(labels, pa.list_(pa.int32()))],
                    names=["doc", "row", "set_a", "set_b", "size", "nodes", "labels"],
                )

    return rows.mapInArrow(sign, "doc long, row long, set_a long, set_b long, size int, nodes array<long>, labels array<int>")


def walked(batches: Iterator[pa.RecordBatch], levels: int) -> Iterator[pa.RecordBatch]:
    """Walk one shard of the sorted trees, rows ``(tree, path, labels, node)``: ``a, b, tree, path``.

    Each class is matched with the first class of the longest prefix that it shares with the class before it. The first
    and the last node of the shard are reported with their first class as ``a`` and no ``b``. Holds one batch.
    """
    last: tuple | None = None
    firsts = np.zeros(levels + 1, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree, path, labels, node = (batch.column(i).to_numpy() for i in range(4))
        if last is None:
            yield matches([int(node[0])], [None], [int(tree[0])], [int(path[0])])
        held = last if last is not None else (-1, 0, 0, 0)
        tree, path, labels, node = (np.concatenate([[h], c]) for h, c in zip(held, (tree, path, labels, node), strict=True))
        shared = np.full(n + 1, -1)
        same = np.zeros(n + 1, bool)
        same[1:] = (tree[1:] == tree[:-1]) & (path[1:] == path[:-1])
        for level in range(levels + 1):
            rest = LABEL_BITS * (levels - level)
            alike = same.copy()
            alike[1:] &= (labels[1:] >> rest) == (labels[:-1] >> rest)
            shared[alike] = level
        places, a = np.arange(n + 1), np.zeros(n + 1, np.int64)
        for level in range(levels + 1):
            begin = np.maximum.accumulate(np.where(shared < level, places, 0))
            first = np.where(begin == 0, firsts[level], node[begin])
            a = np.where(shared == level, first, a)
            firsts[level] = first[-1]
        kept = np.flatnonzero((shared >= 0) & (a != node))
        yield matches(a[kept], node[kept], np.zeros(len(kept)), np.zeros(len(kept)))
        last = tuple(int(c[-1]) for c in (tree, path, labels, node))
    if last is not None:
        yield matches([int(firsts[0])], [None], [last[0]], [last[1]])


def matches(a: list, b: list, tree: list, path: list) -> pa.RecordBatch:
    arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.asarray(tree, np.int32)), pa.array(np.asarray(path, np.int64))]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "tree", "path"])


def forest_matches(classes: DataFrame, levels: int) -> DataFrame:
    """``a, b``: classes that share a node; those of one node are connected by such pairs, fewer than its classes."""
    paths = classes.select("node", F.posexplode(F.arrays_zip("nodes", "labels")).alias("tree", "at")).select(
        "tree", F.col("at.nodes").alias("path"), F.col("at.labels").alias("labels"), "node"
    )
    order = ["tree", "path", "labels", "node"]
    shards = paths.repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialised(shards.mapInArrow(lambda batches: walked(batches, levels), "a long, b long, tree int, path long"), "jaccard_trees")
    outer = found.where(F.col("b").isNull()).select(F.min("a").over(Window.partitionBy("tree", "path")).alias("a"), F.col("a").alias("b"))
    return found.where(F.col("b").isNotNull()).select("a", "b").unionByName(outer.where("a <> b")).distinct()


def with_partner(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``wanted``; none that is there is lost.

    A bit map of 2^MAP_BITS bits, in 2^(MAP_BITS - 6) rows at most, is broadcast. A full map lets every row pass.
    """
    spot = F.xxhash64(*keys, F.lit(6))
    word = F.shiftright(spot, 6).bitwiseAND(F.lit((1 << (MAP_BITS - 6)) - 1))
    bits = wanted.select(word.alias("map_word"), one_bit(spot).alias("bit")).groupBy("map_word").agg(F.bit_or("bit").alias("map_bits"))
    marked = rows.withColumn("map_word", word).join(F.broadcast(bits), "map_word")
    return marked.where(F.col("map_bits").bitwiseAND(one_bit(spot)) != 0).select(*rows.columns)


def one_bit(spot: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs. Only runs that both sides hold count; these become matrix columns."""
    a, b = np.concatenate(left), np.concatenate(right)
    owner_a = np.repeat(np.arange(len(left)), [len(s) for s in left])
    owner_b = np.repeat(np.arange(len(right)), [len(s) for s in right])
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    keep_a = shared[np.minimum(at_a, len(shared) - 1)] == a if len(shared) else np.zeros(len(a), bool)
    keep_b = shared[np.minimum(at_b, len(shared) - 1)] == b if len(shared) else np.zeros(len(b), bool)
    at_a, owner_a, at_b, owner_b = at_a[keep_a], owner_a[keep_a], at_b[keep_b], owner_b[keep_b]
    for first in range(0, len(shared), columns):
        width = min(columns, len(shared) - first)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        here = (at_a >= first) & (at_a < first + width)
        x[owner_a[here], at_a[here] - first] = 1
        here = (at_b >= first) & (at_b < first + width)
        y[owner_b[here], at_b[here] - first] = 1
        out += x @ y.T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of ``threshold`` or more."""
    common = intersections(left, right)
    size_a = np.array([len(s) for s in left], np.float64)[:, None]
    size_b = np.array([len(s) for s in right], np.float64)[None, :]
    return common >= threshold * (size_a + size_b - common) - 1e-9


def forest_edges(nodes: np.ndarray, links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, as pairs of nodes: no more edges than nodes."""
    root = {int(v): int(v) for v in nodes}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    edges = []
    for i, row in enumerate(links):
        for j in np.flatnonzero(row):
            x, y = find(int(rows[i])), find(int(columns[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((int(rows[i]), int(columns[j])))
    return edges


def jaccard_join(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = TARGET,
    trees: int = TREES, depth: int = DEPTH,
) -> DataFrame:
    """``key, class_id, copy_id, n_links`` of every row; see above."""
    found = classed_rows(docs, key, text, threshold, target, trees, depth)
    return found.select(key, "class_id", "copy_id", "n_links")


def classed_rows(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = TARGET,
    trees: int = TREES, depth: int = DEPTH,
) -> DataFrame:
    """The same with ``row`` and ``class_row``, the row keys of the text and of the first text of its class."""
    shortest = matched_depth(trees, depth, threshold, target)
    levels = min(depth - shortest, 31 // LABEL_BITS)
    rows = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), row_key(text).alias("row"), F.col(text).alias("content")
    )
    signed = materialised(signatures(rows, text, trees, shortest + levels, shortest), "jaccard_signatures")
    own_set = ["set_a", "set_b", "size"]
    full = signed.where(F.col("size") > 0)
    classes = full.groupBy(*own_set).agg(
        F.min(F.struct("doc", "row")).alias("first"), F.count("*").alias("copies"), F.first("nodes").alias("nodes"),
        F.first("labels").alias("labels"),
    )
    classes = classes.select(
        F.col("first.doc").alias("doc"), F.col("first.row").alias("row"), *own_set, "copies", "nodes", "labels"
    ).withColumn("node", F.xxhash64(*own_set))
    classes = materialised(classes, "jaccard_classes")

    groups = components(forest_matches(classes, levels), "jaccard_groups")
    members = groups.join(classes.select("node", "doc", "row", "size", "copies"), "node")
    members = materialised(members, "jaccard_members")
    sums = members.groupBy("root").agg(F.sum("size").alias("runs"), F.count("*").alias("n"))
    blocks = F.greatest(F.ceil(F.col("runs") / BLOCK_RUNS), F.ceil(F.col("n") / BLOCK_CLASSES)).cast("int")
    placed = members.join(sums.select("root", blocks.alias("blocks")), "root").withColumn(
        "block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    )
    # A block meets itself and every other block of its group: as (lower, upper).
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sent = with_partner(rows, members, "doc", "row").join(placed, ["doc", "row"]).dropDuplicates(["doc", "row"]).select("root", "node", "block", "blocks", "copies", "content")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            sets = [shingles(t, hashes).view(np.int64) for t in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sets, pa.list_(pa.int64()))],
                names=["root", "node", "block", "blocks", "copies", "runs"],
            )

    sets = sent.mapInArrow(shingled, "root long, node long, block int, blocks int, copies long, runs array<long>")
    tasks = sets.select("*", other).select(
        "root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "runs"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in row_groups(batches, 3):
            low, high = table.column(1)[0].as_py(), table.column(2)[0].as_py()
            nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            lists = table.column("runs").combine_chunks()
            flat = lists.values.to_numpy().view(np.uint64)
            cuts = lists.offsets.to_numpy()
            runs = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            block = table.column("block").to_numpy()
            a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
            if not len(a) or not len(b):
                continue
            links = linked([runs[i] for i in a], [runs[i] for i in b], threshold)
            if low == high:
                np.fill_diagonal(links, False)
            n = np.zeros(len(nodes), np.int64)
            n[a] += links @ copies[b]
            if low != high:
                n[b] += links.T @ copies[a]
            at = {v: i for i, v in enumerate(nodes.tolist())}
            edges = forest_edges(nodes, links, nodes[a], nodes[b])
            x = [e[0] for e in edges] + nodes.tolist()
            y = [e[1] for e in edges] + nodes.tolist()
            counts = [0] * len(edges) + [int(n[at[v]]) for v in nodes.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(counts, pa.int64())], names=["a", "b", "n"])

    dealt = tasks.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    verified = materialised(dealt.mapInArrow(verify, "a long, b long, n long"), "jaccard_links")
    roots = components(verified.select("a", "b"), "jaccard_components")
    links = verified.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    smallest = roots.join(classes.select("node", "doc", "row"), "node").groupBy("root").agg(F.min(F.struct("doc", "row")).alias("class"))
    classed = roots.join(smallest, "root").select("node", "class")
    known = classes.select("node", "doc", "row", F.col("doc").alias("copy_id"), "copies", *own_set).join(links, "node", "left").join(classed, "node", "left")
    known = known.select(
        *own_set, "copy_id", F.coalesce("class.doc", "doc").alias("class_id"), F.coalesce("class.row", "row").alias("class_row"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    some = full.select("doc", "row", *own_set).join(known, own_set).select(
        F.col("doc").alias(key), "class_id", "copy_id", "n_links", "row", "class_row"
    )
    blank = signed.where(F.col("size") == 0).select(
        F.col("doc").alias(key), F.col("doc").alias("class_id"), F.col("doc").alias("copy_id"), F.lit(0).cast("long").alias("n_links"),
        "row", F.col("row").alias("class_row"),
    )
    nameless = docs.where(F.col(key).isNull()).select(
        F.lit(None).cast("long").alias(key), F.lit(None).cast("long").alias("class_id"),
        F.lit(None).cast("long").alias("copy_id"), F.lit(0).cast("long").alias("n_links"),
        row_key(text).alias("row"), row_key(text).alias("class_row"),
    )
    return some.unionByName(blank).unionByName(nameless)
