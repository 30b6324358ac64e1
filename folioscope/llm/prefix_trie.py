"""Operator 12: the prefix trie of conversations, from padded matrices of turn ids.

A turn is named by two 64-bit hashes of its role and text. The conversations are dealt out by ranges of their turn ids
(equal ones by ``conv_id``), so a node of the trie is a run of neighbouring rows. A shard is sorted with ``np.lexsort``
over padded matrices of turn ids, a block of columns at a time and only for rows that reach the block. A row starts a
node at every depth from its first changed column on: the OR-accumulated change mask of the columns. ``np.reduceat``
over the starts then adds up each depth, from the deepest to the root.

Only nodes that hold a shard's first or last row can go on in another shard. A shard gives these as partial sums along
the paths of its two outer rows; the partial sums of a node are added up by its depth and the hash of its path, and its
subtree by suffix sums along the paths. That table has two paths per shard, whatever the number of conversations.

The digest of the conversations that end in a node is taken in the shard; for an outer node each shard gives one chunk
of them, and the chunks of a node are hashed in order as a stream.

Rows: a null turn comes first; equal turns are ordered by role, then text; null role or text is empty; rows without a
``conv_id`` belong to no conversation; the remainder of a negative one has its sign, as in SQL. Rows alike are turns of
their own. An empty table has no nodes. One conversation is the unit of work: its turn ids (20 bytes a turn) must fit
into a task, its texts need not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialised
from folioscope.session import measured_broadcast

#: Turns in a block of columns.
BLOCK = 8
#: Turns of a shard, about; there are never fewer shards than shuffle partitions.
SHARD_TURNS = 1 << 20
#: Conversations of a family share the first turns of its first one.
FAMILY, MOST_SHARED = 100, 6
LEAST = np.iinfo(np.int64).min


def turn_lists(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the hashes and lengths of each conversation's turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    # The least number is kept for padding.
    ids = [F.greatest(h, F.lit(LEAST + 1)) for h in (F.xxhash64("role", "text"), F.xxhash64("text", F.lit(0), "role"))]
    named = rows.select(
        "conv_id", place.alias("place"), ids[0].alias("x"), ids[1].alias("y"), F.length("text").alias("size")
    )
    lists = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "size"))).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t.x, t.y, t.size)).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """Each conversation behind the first turns of its family's first one: ``conv_id, ids, sizes``."""
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = lists.where(F.col("conv_id") == first).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, MOST_SHARED).alias("head")
    )
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    joined = lists.withColumn("first", first).join(heads, "first", "left").withColumn("shared", shared)
    own = F.slice("turns", F.col("shared") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("shared")))
    whole = joined.select("conv_id", F.when(head.isNull(), own).otherwise(F.concat(head, own)).alias("turns"))
    return whole.select(
        "conv_id", F.flatten(F.transform("turns", lambda t: F.array(t.x, t.y))).alias("ids"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
    )


class Shard:
    """Conversations that are neighbours in the order of their turns: ids ``x, y`` and sizes, flat, with offsets."""

    def __init__(self, conv: np.ndarray, ids: np.ndarray, sizes: np.ndarray, length: np.ndarray):
        self.conv, self.length = conv, length
        self.offset = np.cumsum(length) - length
        self.ids, self.sizes = ids.reshape(-1, 2), sizes
        self.n, self.depth = len(conv), int(length.max(initial=0))
        self.starts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.sort()

    def block(self, rows: np.ndarray, begin: int) -> np.ndarray:
        """The padded matrix of the turns from ``begin`` on: two columns of ids per turn."""
        place = begin + np.arange(BLOCK)
        there = place < self.length[rows, None]
        matrix = np.full((len(rows), BLOCK, 2), LEAST, np.int64)
        matrix[there] = self.ids[(self.offset[rows, None] + place)[there]]
        return matrix.reshape(len(rows), 2 * BLOCK)

    def sort(self) -> None:
        """Order the rows by their turns, then ``conv_id``, and note the places where nodes of each depth start.

        ``prefix`` numbers the runs of rows that agree in all turns before the block.
        """
        order, places = np.arange(self.n), np.arange(self.n)
        prefix, begin = np.zeros(self.n, np.int64), 0
        while len(places):
            rows = order[places]
            matrix = self.block(rows, begin)
            further = self.length[rows] > begin + BLOCK
            keys = [self.conv[rows], further, *matrix.T[::-1], prefix]
            rank = np.lexsort(keys)
            order[places] = rows = rows[rank]
            matrix, prefix, further = matrix[rank], prefix[rank], further[rank]
            change = np.ones((len(rows), BLOCK), bool)
            turns = matrix.reshape(len(rows), BLOCK, 2)
            change[1:] = (turns[1:] != turns[:-1]).any(axis=2)
            change[1:, 0] |= prefix[1:] != prefix[:-1]
            change = np.logical_or.accumulate(change, axis=1)
            there = begin + np.arange(BLOCK) < self.length[rows, None]
            for column in range(min(BLOCK, self.depth - begin)):
                self.starts.append(places[change[:, column] & there[:, column]])
            prefix = np.cumsum(change[:, -1])[further]
            places = places[further]
            begin += BLOCK
        self.order = order
        self.lengths = self.length[order]
        self.convs = self.conv[order]

    def path(self, row: int) -> np.ndarray:
        """The hash of each prefix of a row, from the empty one on: two numbers a prefix."""
        at = self.offset[self.order[row]]
        ids = self.ids[at : at + self.lengths[row]].view(np.uint64)
        out = np.zeros((len(ids) + 1, 2), np.uint64)
        for column, base in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
            step = np.full(len(ids), base, np.uint64)
            if len(ids):
                out[1:, column] = np.cumsum(ids[:, column] * np.multiply.accumulate(step))
        return out.view(np.int64)

    def nodes(self) -> Iterator[dict[str, np.ndarray]]:
        """Every depth's nodes, from the deepest on.

        ``outer`` is 0 for a node inside the shard, 1 for one that holds the first row, 2 for one that holds the last
        row but not the first. The sums of an outer node leave out all outer nodes, itself included.
        """
        leaves, saved = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        below = np.zeros(0, np.int64)
        outer_below = np.zeros(0, np.int64)
        for depth in range(self.depth, -1, -1):
            reach = np.flatnonzero(self.lengths >= depth)
            start = self.starts[depth]
            at = np.searchsorted(reach, start)
            if not len(start):
                continue
            count = np.diff(np.append(at, len(reach)))
            end = start + count
            outer = np.where(start == 0, 1, np.where(end == self.n, 2, 0))
            deeper = np.maximum.reduceat(self.lengths[reach], at) > depth
            # Children start inside their parent.
            children = np.searchsorted(below[outer_below == 0], end) - np.searchsorted(below[outer_below == 0], start)
            size = self.sizes[self.offset[self.order[start]] + depth - 1] if depth else np.zeros(len(start), np.int64)
            own = outer == 0
            leaves[start] += own & ~deeper
            saved[start] += np.where(own, (count - 1) * size, 0)
            ends = np.add.reduceat((self.lengths[reach] == depth).astype(np.int64), at)
            yield {
                "depth": np.full(len(start), depth), "start": start, "outer": outer, "deeper": deeper, "size": size,
                "conv_id": np.minimum.reduceat(self.convs[reach], at), "n_convs": count, "n_children": children,
                "n_leaves": np.add.reduceat(leaves[reach], at), "saved_tokens": np.add.reduceat(saved[reach], at),
                "ends": ends,
            }
            below, outer_below = start, outer


def joined(convs: np.ndarray) -> str:
    return ",".join(map(str, convs.tolist()))


#: outer 0: a whole node; its parent's conv_id, or (x, y), the parent's path, if that is an outer node.
#: outer 1 or 2: partial sums of the node with path (x, y) and parent (up_x, up_y); ``chunk`` are its ends.
FIELDS = (
    "outer int, path int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, x long, y long, up_x long, up_y long, deeper boolean, size long, "
    "chunk_first long, chunk string"
)


def shard_nodes(shard: Shard) -> Iterator[pa.Table]:
    """The rows of a shard, a depth at a time, then those of its two outer paths."""
    first, last = shard.path(0), shard.path(shard.n - 1)
    levels = list(shard.nodes())
    partial: dict[tuple[int, int], dict] = {}
    above: dict[str, np.ndarray] | None = None
    for level in levels[::-1]:
        depth = int(level["depth"][0])
        inner = level["outer"] == 0
        for k in np.flatnonzero(~inner).tolist():
            begin, ends = int(level["start"][k]), int(level["ends"][k])
            own = shard.convs[begin : begin + ends]
            partial[int(level["outer"][k]), depth] = {
                "conv_id": int(level["conv_id"][k]), "n_convs": int(level["n_convs"][k]),
                "n_children": int(level["n_children"][k]), "n_leaves": int(level["n_leaves"][k]),
                "saved_tokens": int(level["saved_tokens"][k]), "deeper": bool(level["deeper"][k]),
                "chunk_first": int(own[0]) if ends else None, "chunk": joined(own) if ends else None,
            }
        if inner.any():
            up = np.searchsorted(above["start"], level["start"][inner], side="right") - 1
            over = above["outer"][up]
            ends = [path[min(depth - 1, len(path) - 1)] for path in (last, first)]
            paths = np.where((over == 2)[:, None], *ends)
            digests = [
                hashlib.sha256(joined(shard.convs[b : b + e]).encode()).hexdigest()
                for b, e in zip(level["start"][inner].tolist(), level["ends"][inner].tolist(), strict=True)
            ]
            own = over == 0
            columns = {c: pa.array(level[c][inner]) for c in (
                "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")}
            columns |= {
                "outer": pa.array(np.zeros(len(up), np.int32)), "ends_sha256": pa.array(digests),
                "parent_conv_id": pa.array(above["conv_id"][up], mask=~own),
                "x": pa.array(paths[:, 0], mask=own), "y": pa.array(paths[:, 1], mask=own),
            }
            yield pa.table(columns)
        above = level
    # Both outer paths from the root on; where they share a node, the sums stand on the first.
    nothing = {"n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "deeper": False, "conv_id": None,
               "chunk_first": None, "chunk": None}
    rows = []
    for path, (hashes, row) in enumerate(((first, 0), (last, shard.n - 1)), 1):
        at = int(shard.offset[shard.order[row]])
        for depth in range(len(hashes)):
            x, y = hashes[depth].tolist()
            up_x, up_y = hashes[depth - 1].tolist() if depth else (None, None)
            rows.append(partial.get((path, depth), nothing) | {
                "outer": path, "depth": depth, "x": x, "y": y, "up_x": up_x, "up_y": up_y,
                "size": int(shard.sizes[at + depth - 1]) if depth else 0,
            })
    yield pa.Table.from_pylist(rows)


def in_shards(convs: DataFrame, shards: int) -> DataFrame:
    """The nodes of each range of conversations, as ``FIELDS``; ``path`` numbers the outer paths."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in FIELDS.split(", ")])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, number = pa.Table.from_batches(held), TaskContext.get().partitionId()
        ids, sizes = (table.column(c).combine_chunks() for c in ("ids", "sizes"))
        shard = Shard(
            table.column("conv_id").to_numpy(), ids.flatten().to_numpy(), sizes.flatten().to_numpy().astype(np.int64),
            sizes.value_lengths().to_numpy().astype(np.int64),
        )
        for part in shard_nodes(shard):
            columns = []
            for field in schema:
                if field.name == "path":
                    columns.append(pa.array(number * 2 + part.column("outer").to_numpy(), pa.int32()))
                elif field.name in part.column_names:
                    columns.append(part.column(field.name).cast(field.type).combine_chunks())
                else:
                    columns.append(pa.nulls(part.num_rows, field.type))
            yield from pa.table(columns, names=names).to_batches(max_chunksize=16384)

    dealt = convs.select("conv_id", "ids", "sizes").repartitionByRange(shards, "ids", "conv_id")
    return dealt.mapInArrow(build, FIELDS)


def streamed_digests(chunks: DataFrame) -> DataFrame:
    """``depth, x, y, ends_sha256`` from ``depth, x, y, chunk_first, chunk``: one digest per node, chunk after chunk."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            for d, x, y, _, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (d, x, y) == node:
                    state.update(b"," + chunk.encode())
                    continue
                if node:
                    yield told(node, state)
                node, state = (d, x, y), hashlib.sha256(chunk.encode())
        if node:
            yield told(node, state)

    def told(node: tuple, state) -> pa.RecordBatch:
        row = dict(zip(("depth", "x", "y", "ends_sha256"), (*node, state.hexdigest()), strict=True))
        return pa.RecordBatch.from_pylist([row])

    ordered = chunks.repartition("depth", "x", "y").sortWithinPartitions("depth", "x", "y", "chunk_first")
    return ordered.select("depth", "x", "y", "chunk_first", "chunk").mapInArrow(
        digest, "depth long, x long, y long, ends_sha256 string"
    )


def outer_nodes(partial: DataFrame) -> DataFrame:
    """The nodes of the outer paths, whole: partial sums by node, and subtrees by suffix sums along the paths."""
    node = ["depth", "x", "y"]
    sums = partial.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner_children"),
        F.max("deeper").alias("deeper"), F.max("size").alias("size"), F.min("path").alias("path"),
        F.first("up_x").alias("up_x"), F.first("up_y").alias("up_y"),
        F.sum("n_leaves").alias("inner_leaves"), F.sum("saved_tokens").alias("inner_saved"),
    )
    sums = materialised(sums, "trie_outer")
    # The inner nodes below a node are in its sums already. What an outer node is itself stands on one of the paths
    # through it, and on no other.
    own = sums.select(
        *node, "path", F.when(F.col("deeper"), 0).otherwise(1).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    along = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    placed = partial.select(*node, "path").join(own, [*node, "path"], "left").select(
        *node, F.sum(F.coalesce("leaves", zero)).over(along).alias("leaves"),
        F.sum(F.coalesce("saved", zero)).over(along).alias("saved"),
    )
    totals = placed.groupBy(*node).agg(F.sum("leaves").alias("outer_leaves"), F.sum("saved").alias("outer_saved"))
    children = sums.where(F.col("depth") > 0).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")
    ).agg(F.count("*").alias("outer_children"))
    above = sums.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    digests = streamed_digests(partial.where(F.col("chunk").isNotNull()))
    whole = sums.join(totals, node).join(children, node, "left").join(above, ["depth", "up_x", "up_y"], "left")
    return whole.join(digests, node, "left").select(
        *node, "conv_id", "parent_conv_id", "n_convs",
        (F.col("inner_children") + F.coalesce("outer_children", zero)).alias("n_children"),
        (F.col("inner_leaves") + F.col("outer_leaves")).alias("n_leaves"),
        (F.col("inner_saved") + F.col("outer_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, from ``conv_id, turn, role, text``."""
    spark = turns.sparkSession
    lists = materialised(turn_lists(turns), "trie_turns")
    convs = materialised(rebuilt(lists), "trie_convs")
    total = convs.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_turns))
    found = materialised(in_shards(convs, shards), "trie_nodes")
    outer = materialised(outer_nodes(found.where(F.col("outer") > 0)), "trie_outer_nodes")
    parents = measured_broadcast(outer.select(
        (F.col("depth") + 1).alias("depth"), "x", "y", F.col("conv_id").alias("outer_parent")
    ))
    inner = found.where(F.col("outer") == 0).join(parents, ["depth", "x", "y"], "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "outer_parent"))
    return inner.select(*COLUMNS).unionByName(outer.select(*COLUMNS))
