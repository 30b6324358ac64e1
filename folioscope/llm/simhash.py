"""Operator 13: SimHash near-duplicates, linked by BK-trees.

A BK-tree keeps a point in every node and its children under their integer Hamming distance to it; a search within
radius ``r`` of a point at distance ``d`` of a node follows only the edges ``d - r`` to ``d + r``. ``links_in_trees``
builds the trees of many shards at once, level by level, and lets all searches walk them together, so the work is
array operations.

Shards: two fingerprints at ``radius`` or fewer differing bits are equal in at least one of ``radius + 1`` blocks of
bits. Each distinct fingerprint is dealt to one shard per block, named by the block's value, so a linked pair meets
in some tree and no other shard needs to be searched. A shard that holds more than ``shard_size`` fingerprints is
dealt again by the blocks of the bits that it does not fix yet, for as long as it is too large: a pair that agrees in a
block still differs in at most ``radius`` of the others. Every level leaves fewer free bits, and a shard can't hold
more fingerprints than its free bits can spell, so every tree is of bounded size whatever the data. Since each search
starts in its own shard, trees and searches travel by the shard's key; nothing is broadcast, as trees of all
fingerprints have no bound.

Copies share a fingerprint and enter the trees once. A tree reports only who is connected within it (an edge to the
smallest fingerprint of its part of the shard), never all pairs; the parts are joined by connected components.

Rows: a null or empty text, or one of blanks alone, has fingerprint zero and is linked like any other. Repeated rows
and repeated ids keep their lines. Rows without an id are linked too, and are no one's smallest id; a component of such
rows alone has a null id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import components, materialised

#: Bits in which linked fingerprints may differ.
RADIUS = 4
WIDTH = 4
#: Fingerprints of a shard that become one tree.
SHARD_SIZE = 4096
#: Shingles hashed, and steps of tree searches walked, at a time.
SHINGLES = 1 << 15
STEPS = 1 << 20
BITS = 64


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The bits set in over half of the shingle hashes (XXH64, seed 42), as an unsigned number."""
    from xxhash import xxh64_intdigest

    # On bytes, lower() and split() know A-Z and the six ASCII blanks only.
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), 42)
    n = len(words) - width + 1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES):
        some = words[at : at + SHINGLES + width - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(width)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key, code``: the fingerprint's bits as a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc", "code"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("content"))
    return rows.mapInArrow(score, "doc long, code long").withColumnRenamed("doc", key)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int64)


class Forest:
    """A BK-tree for each run of equal ``shards``, over ``codes`` that are distinct within a shard.

    Nodes are positions, the first of a run is its root. ``edge`` holds ``parent * 128 + distance``, sorted, and
    ``child`` the node at the other end.
    """

    def __init__(self, shards: np.ndarray, codes: np.ndarray):
        self.codes = codes
        n = len(codes)
        starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])[:n])
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        parent, waiting = self.root.copy(), np.flatnonzero(self.root != np.arange(n))
        edges, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(waiting):
            # The first to come along an edge stays as its child; the others go on to that child.
            place = parent[waiting] * 128 + distance(codes[waiting], codes[parent[waiting]])
            kept, first, at = np.unique(place, return_index=True, return_inverse=True)
            edges.append(kept)
            nodes.append(waiting[first])
            parent[waiting] = waiting[first][at]
            waiting = np.delete(waiting, first)
        edge, child = np.concatenate(edges), np.concatenate(nodes)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def hits(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs within the radius in one tree, as arrays ``(point, neighbour)``, the later position first."""
        n, part = len(self.codes), STEPS // 64
        stack = [(np.arange(at, min(at + part, n)), self.root[at : at + part]) for at in range(0, n, part)]
        while stack:
            points, nodes = stack.pop()
            if len(points) > STEPS:
                half = len(points) // 2
                stack += [(points[half:], nodes[half:]), (points[:half], nodes[:half])]
                continue
            d = distance(self.codes[points], self.codes[nodes])
            near = (d <= radius) & (points > nodes)
            if near.any():
                yield points[near], nodes[near]
            # The edges d - radius to d + radius of a node are one run of the sorted list.
            first = np.searchsorted(self.edge, nodes * 128 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.edge, nodes * 128 + d + radius, side="right") - first
            if total := int(count.sum()):
                begin = np.repeat(first - np.cumsum(count) + count, count)
                stack.append((np.repeat(points, count), self.child[np.arange(total) + begin]))

    def parts(self, radius: int) -> np.ndarray:
        """Of each point, the first position that it is connected with by links within its tree."""
        label = np.arange(len(self.codes))
        for x, y in self.hits(radius):
            while True:
                a, b = label[x], label[y]
                apart = a != b
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label != (shorter := label[label])).any():
                    label = shorter
        return label


def block_masks(level: int, radius: int) -> list[int]:
    """The bits, dealt to ``radius + 1`` blocks, as signed masks; each level deals them differently."""
    order = np.random.default_rng(level).permutation(BITS) if level else np.arange(BITS)
    blocks = np.array_split(order, radius + 1)
    return [int(np.array(sum(1 << int(b) for b in block), np.uint64).view(np.int64)) for block in blocks]


def dealt_to_shards(codes: DataFrame, radius: int, shard_size: int) -> DataFrame:
    """``mask, part, code``: every fingerprint in its shards; ``part`` is what the shard's members have under ``mask``.

    Two fingerprints within the radius share a shard, and no shard holds more than ``shard_size``.
    """
    waiting, settled, level = codes.select(F.lit(0).cast("long").alias("mask"), "code"), None, 0
    while True:
        blocks = F.explode(F.array(*[F.lit(m) for m in block_masks(level, radius)])).alias("block")
        finer = waiting.select("mask", "code", blocks).select(F.col("mask").bitwiseOR(F.col("block")).alias("mask"), "code")
        dealt = materialised(
            finer.select("mask", F.col("mask").bitwiseAND(F.col("code")).alias("part"), "code"), "simhash_shards"
        )
        sizes = dealt.groupBy("mask", "part").agg(F.count("*").alias("n")).where(F.col("n") > shard_size)
        large = materialised(sizes.select("mask", "part"), "simhash_large")
        small = dealt.join(large, ["mask", "part"], "left_anti")
        settled = small if settled is None else settled.unionByName(small)
        if large.isEmpty():
            return settled
        waiting, level = dealt.join(large, ["mask", "part"], "left_semi").select("mask", "code"), level + 1


def links_in_trees(shards: DataFrame, radius: int) -> DataFrame:
    """``a, b``: a fingerprint and the smallest one that it is connected with inside a shard, where they differ."""

    def linked(runs: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(runs)
        mask, part, code = (table.column(i).to_numpy() for i in range(3))
        names = np.cumsum(np.append(True, (mask[1:] != mask[:-1]) | (part[1:] != part[:-1])))
        root = Forest(names, code.view(np.uint64)).parts(radius)
        found = root != np.arange(len(code))
        return pa.RecordBatch.from_arrays([pa.array(code[found]), pa.array(code[root[found]])], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted; a batch's last shard may go on in the next batch.
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if waiting:
                last = waiting[-1].slice(waiting[-1].num_rows - 1)
                change = np.append((mask[0], part[0]) != (last.column(0)[0].as_py(), last.column(1)[0].as_py()),
                                   (mask[1:] != mask[:-1]) | (part[1:] != part[:-1]))
            else:
                change = np.append(False, (mask[1:] != mask[:-1]) | (part[1:] != part[:-1]))
            cuts = np.flatnonzero(change)
            if len(cuts):
                cut = int(cuts[-1])
                yield linked([*waiting, batch.slice(0, cut)])
                waiting, batch = [], batch.slice(cut)
            waiting.append(batch)
        if waiting:
            yield linked(waiting)

    ordered = shards.repartition("mask", "part").sortWithinPartitions("mask", "part", "code")
    return ordered.select("mask", "part", "code").mapInArrow(search, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, width: int = WIDTH,
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """``key, fingerprint, component_id`` for each row of ``docs``."""
    scored = materialised(with_fingerprint(docs, key, text, width), "simhash_rows")
    codes = materialised(scored.groupBy("code").agg(F.min(key).alias("first")), "simhash_codes")
    shards = dealt_to_shards(codes.select("code"), radius, shard_size)
    linked = components(links_in_trees(shards, radius), "simhash_links")
    linked = linked.join(codes, F.col("node") == F.col("code"))
    firsts = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.select("code", "root").join(firsts, "root").select("code", "least")
    named = codes.join(linked, "code", "left").select("code", F.coalesce("least", "first").alias("component_id"))
    return scored.join(named, "code").select(
        key, F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )
