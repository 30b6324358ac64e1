"""Operator 10: line dedup by pairwise alignment.

Lines are compared without surrounding blanks; a document is the sequence of hashes of its lines. Documents are paired
through runs of lines: for each line, the shortest run from it on and the shortest run up to it that have ``MIN_CHARS``
characters. Two documents with a common block of that size hold the same such runs, and these cover the whole block,
however frequent its lines are. All holders of a run are sorted by document, in range shards, so that a run that a
third of all documents hold is walked by many tasks; each holder is paired with the first holder of its shard and with
the holder before it, and a shard's first holder with one of the shard before. So no run is skipped, a document has an
earlier partner for each run that an earlier document holds, and there are at most two pairs for each run it holds.

Each pair is aligned with patience diff: common ends, then lines that are unique in both, in their longest increasing
sequence, and the gaps between them in turn. A block of consecutive aligned lines with ``MIN_CHARS`` characters or more
is deleted from the later document, the one with the larger id. All decisions are made on the input. A run that the
alignment with both partners leaves out, because it stands in another order there, stays.

Rows: a null or empty text has no lines and stays; rows without an id take no part and stay; rows with the same id and
text are one document, with the same id and other texts they are no copies of each other. A text loses whole lines.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import BASES, materialised, mixed, powers, row_key

MIN_CHARS = 50


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: pairs of positions of equal lines, increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = once(a, a0, a1), once(b, b0, b1)
        shared = sorted((i, once_b[h]) for h, i in once_a.items() if h in once_b)
        anchors = increasing(shared)
        if not anchors:
            continue
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        for (i, j), (k, m) in zip(edges, edges[1:]):
            if k - i > 1 and m - j > 1:
                todo.append((i + 1, k, j + 1, m))
    return sorted(found)


def once(lines: list[int], begin: int, end: int) -> dict[int, int]:
    """The lines that occur once in the range, with their places."""
    places: dict[int, int] = {}
    for i in range(begin, end):
        places[lines[i]] = -1 if lines[i] in places else i
    return {h: i for h, i in places.items() if i >= 0}


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that increases in the second place too; pairs come sorted by the first."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect.bisect_left(tails, j)
        before[k] = at[place - 1] if place else -1
        if place == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[place], at[place] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_blocks(later: list[int], earlier: list[int], sizes: list[int], min_chars: int) -> list[int]:
    """Places of the lines of ``later`` in aligned blocks of at least ``min_chars`` characters."""
    out: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*aligned(later, earlier), (-9, -9)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= min_chars:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def line_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, row, hashes, sizes, places``: the lines that are not blank, of every document with an id."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    rows = docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), row_key(text).alias("row"),
        F.filter(
            F.transform(lines, lambda s, i: F.struct(i.alias("place"), F.xxhash64(s).alias("hash"), F.length(s).alias("size"))),
            lambda s: s["size"] > 0,
        ).alias("lines"),
    )
    return rows.where(F.size("lines") > 0).select(
        "doc", "row", F.col("lines.hash").alias("hashes"), F.col("lines.size").alias("sizes"), F.col("lines.place").alias("places")
    )


def run_hashes(hashes: np.ndarray, sizes: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first line and hash of every shortest run; ``ends`` is where each line's document ends."""
    n = len(hashes)
    chars = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    least = max(min_chars, 1)
    begins = np.zeros(n, np.int64)
    if n:
        new = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
        begins = np.repeat(new, np.diff(np.append(new, n)))
    places = np.arange(n)
    onward = np.searchsorted(chars, chars[:-1] + least, "left")
    back = np.searchsorted(chars, chars[1:] - least, "right") - 1
    first = np.concatenate([places[onward <= ends], back[back >= begins]])
    stop = np.concatenate([onward[onward <= ends], places[back >= begins] + 1])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(hashes) * powers(BASES[0], n), out=total[1:])
    inverse = powers(pow(BASES[0], -1, 1 << 64), n + 1)
    return first, mixed((total[stop] - total[first]) * inverse[first] + (stop - first).astype(np.uint64))


def runs_of(table: DataFrame, min_chars: int) -> DataFrame:
    """``run, doc, row`` of ``table (doc, row, hashes, sizes)``: the shortest runs of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            counts = batch.column(2).value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(doc)), counts)
            hashes = batch.column(2).flatten().to_numpy().view(np.uint64)
            first, runs = run_hashes(hashes, batch.column(3).flatten().to_numpy(), np.cumsum(counts)[owner], min_chars)
            order = np.lexsort((runs, owner[first]))
            runs, holder = runs[order], owner[first][order]
            kept = np.ones(len(runs), bool)
            kept[1:] = (runs[1:] != runs[:-1]) | (holder[1:] != holder[:-1])
            runs, at = runs[kept].view(np.int64), holder[kept]
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(doc[at]), pa.array(row[at])], names=["run", "doc", "row"])

    return table.select("doc", "row", "hashes", "sizes").mapInArrow(cut, "run long, doc long, row long")


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``run, doc, row, other, other_row`` of one shard of the sorted holders ``(run, doc, row)``.

    Each holder with the first holder of its run and with the last one of a smaller id. The holders with the shard's
    first run and id, and its last row, are reported without ``other``. Keeps one batch and three rows.
    """
    carried = np.zeros((3, 0), np.int64)
    outer = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
        if outer is None:
            outer = rows[:2, 0]
        edge = rows[:, (rows[0] == outer[0]) & (rows[1] == outer[1])]
        held = carried.shape[1]
        rows = np.concatenate([carried, rows], axis=1)
        n = rows.shape[1]
        run, doc = rows[0], rows[1]
        new_run, new_doc = np.ones(n, bool), np.ones(n, bool)
        new_run[1:] = run[1:] != run[:-1]
        new_doc[1:] = new_run[1:] | (doc[1:] != doc[:-1])
        places = np.arange(n)
        first = np.maximum.accumulate(np.where(new_run, places, 0))
        own = np.maximum.accumulate(np.where(new_doc, places, 0))
        later = np.flatnonzero((own > first) & (places >= held))
        yield pair_batch(np.concatenate([rows[:, later]] * 2, axis=1), np.concatenate([rows[1:, first[later]], rows[1:, own[later] - 1]], axis=1))
        if edge.shape[1]:
            yield pair_batch(edge, None)
        # The first holder, the last of a smaller id, and one of the last id.
        carried = rows[:, sorted({int(first[-1]), max(int(own[-1]) - 1, int(first[-1])), n - 1})]
    if outer is not None:
        yield pair_batch(carried[:, -1:], None)


def pair_batch(rows: np.ndarray, others: np.ndarray | None) -> pa.RecordBatch:
    arrays = [pa.array(c) for c in rows]
    arrays += [pa.array(c) for c in others] if others is not None else [pa.nulls(rows.shape[1], pa.int64())] * 2
    return pa.RecordBatch.from_arrays(arrays, names=["run", "doc", "row", "other", "other_row"])


def partners(table: DataFrame, min_chars: int) -> DataFrame:
    """``doc, row, other, other_row``: the earlier documents that each document is aligned with."""
    order = ["run", "doc", "row"]
    shards = runs_of(table, min_chars).repartitionByRange(*order).sortWithinPartitions(*order)
    found = materialised(shards.mapInArrow(paired, "run long, doc long, row long, other long, other_row long"), "line_pairs")
    before = Window.partitionBy("run").orderBy("doc").rangeBetween(Window.unboundedPreceding, -1)
    outer = found.where(F.col("other").isNull()).withColumn("before", F.max(F.struct("doc", "row")).over(before))
    outer = outer.where(F.col("before").isNotNull()).select(
        "doc", "row", F.col("before.doc").alias("other"), F.col("before.row").alias("other_row")
    )
    return found.where(F.col("other").isNotNull()).select(*outer.columns).unionByName(outer).distinct()


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS
) -> DataFrame:
    """``docs`` with ``text`` without the lines deleted, and ``n_lines, n_removed`` (lines that are not blank)."""
    table = materialised(line_hashes(docs, key, text).dropDuplicates(["doc", "row"]), "lines")
    pairs = partners(table, min_chars)
    other = table.select(F.col("doc").alias("other"), F.col("row").alias("other_row"), F.col("hashes").alias("other_hashes"))
    joined = pairs.join(other, ["other", "other_row"]).join(table, ["doc", "row"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, sizes, places in zip(*[batch.column(j).to_pylist() for j in range(2, 6)], strict=True):
                out.append([places[i] for i in common_blocks(a, b, sizes, min_chars)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["doc", "row", "gone"]
            )

    gone = joined.select("doc", "row", "hashes", "other_hashes", "sizes", "places").mapInArrow(
        align, "doc long, row long, gone array<int>"
    )
    gone = gone.where(F.size("gone") > 0).groupBy("doc", "row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("all"), F.col(key).alias("id"), row_key(text).alias("found")
    )
    found = gone.select(F.col("doc").alias("id"), F.col("row").alias("found"), "gone")
    joined = rows.join(found, ["id", "found"], "left")
    lines = F.split(F.col("all")[text], "\n")
    rest = F.array_join(F.filter(lines, lambda s, i: ~F.array_contains("gone", i)), "\n")
    solid = F.filter(lines, lambda s: F.length(F.regexp_replace(s, "\\s+", "")) > 0)
    new_text = F.when(F.col("gone").isNull(), F.col("all")[text]).otherwise(rest)
    return joined.select(
        *[(new_text if c == text else F.col("all")[c]).alias(c) for c in kept],
        F.when(F.col("all")[text].isNull(), 0).otherwise(F.size(solid)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
