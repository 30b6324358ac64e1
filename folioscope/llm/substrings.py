"""Operator 5: substring dedup on a compacted de Bruijn graph.

A word run that is ``WIDTH`` words long and starts in a document with a smaller id too is a repeat; every word that a
repeat covers is removed. All windows are judged on the input.

* Nodes: of the ``WIDTH - K + 1`` k-mers in a window, the one with the smallest hash is the window's node, so equal
  windows have equal nodes, and about one k-mer in twenty is one. Edges join the successive nodes of a document; an edge
  is the word run from the first to the last word of its two nodes.
* Compaction: a node that occurs more than once and is always entered by one edge and left by one edge does not branch:
  all documents with it go the same way. Joining this verdict to the occurrences, runs of such nodes become one path
  per document, named by its first node. A whole group of copies is one path, one row per document.
* Repeats: a window that lies within a path and whose node does not branch occurs exactly in the documents with that
  path. The other windows with a repeated node, those at branches and at the ends of paths, are hashed themselves
  (128 bits). A path or a window is a repeat where its smallest document id is below the document's own.
* The source coordinates of both kinds, word places in the document, say which words go.

Windows whose node occurs once cannot be repeats and are never shuffled. Rows: a null text has no words; rows without
an id take no part and keep all words; rows with one id are no repeats of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import BASES, Hashes, materialised, mixed, powers, row_key, windowed_hash

WIDTH = 50
K = 10


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_nodes(ids: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers and, for each window, the place of its node: the leftmost k-mer of the smallest hash."""
    grams = windowed_hash(ids, k)
    n = len(ids) - width + 1
    if n <= 0:
        return grams, np.zeros(0, np.int64)
    span = width - k + 1
    # Smallest of each span by doubling; ties keep the left one.
    best, reach = np.arange(len(grams)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        reach += step
    return grams, best[:n]


def edge_keys(ids: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """A hash of the word run of each edge between successive nodes."""
    base = BASES[1]
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(ids * powers(base, len(ids)), out=total[1:])
    begin, end = places[:-1], places[1:] + k
    inverse = powers(pow(base, -1, 1 << 64), len(ids) + 1)
    return mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for begin, end in spans:
        out += words[at:begin]
        at = end
    return out + words[at:]


def node_lists(rows: DataFrame, width: int, k: int) -> DataFrame:
    """``doc, row, nodes, edges`` of documents with a window: node hashes in order, and the edges around them (one
    more than nodes; 0 before the first, 1 after the last)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            docs, keys, nodes, edges = [], [], [], []
            for doc, row, text in zip(*[batch.column(j).to_pylist() for j in range(3)], strict=True):
                words = words_of(text)
                if len(words) < width:
                    continue
                ids = hashes.of(words)
                grams, places = window_nodes(ids, width, k)
                places = np.unique(places)
                docs.append(doc)
                keys.append(row)
                nodes.append(grams[places].view(np.int64))
                edges.append(np.concatenate([[0], edge_keys(ids, places, k).view(np.int64), [1]]))
            long_list = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(nodes, long_list), pa.array(edges, long_list)],
                names=["doc", "row", "nodes", "edges"],
            )

    return rows.mapInArrow(find, "doc long, row long, nodes array<long>, edges array<long>")


def claims_of(text: str, at: list[int], straight: list[bool], width: int, k: int, hashes: Hashes) -> Iterator[tuple[int, int, int, int]]:
    """(key, key, first window, last window) of a document whose repeated nodes are the ``at``-th ones."""
    ids = hashes.of(words_of(text))
    grams, owner = window_nodes(ids, width, k)
    places, rank = np.unique(owner, return_inverse=True)
    repeated, plain = np.zeros(len(places), bool), np.zeros(len(places), bool)
    repeated[at], plain[at] = True, straight
    # Paths: maximal runs of plain nodes, with the nodes next to them as their ends.
    edge = np.flatnonzero(np.diff(np.concatenate([[0], plain.astype(np.int8), [0]])))
    windows = np.arange(len(owner))
    open_ = repeated[rank]
    for first, stop in zip(edge[::2].tolist(), edge[1::2].tolist()):
        begin, end = places[max(first - 1, 0)], places[min(stop, len(places) - 1)] + k
        inside = windows[(rank >= first) & (rank < stop) & (windows >= begin) & (windows + width <= end)]
        if len(inside):
            open_[inside] = False
            yield int(grams[places[first]].view(np.int64)), 0, int(inside[0]), int(inside[-1])
    rest = windows[open_]
    if len(rest):
        one, two = windowed_hash(ids, width, BASES[0])[rest].view(np.int64), windowed_hash(ids, width, BASES[1])[rest].view(np.int64)
        for a, b, p in zip(one.tolist(), two.tolist(), rest.tolist(), strict=True):
            yield a, b, p, p


def removed_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """``doc, row, content, spans``: the documents with words to remove, and where, as [begin, end) word places."""
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("long").alias("doc"), row_key(text).alias("row"), F.col(text).alias("content")
    )
    lists = materialised(node_lists(rows, width, k), "substring_nodes")
    occurrences = lists.select("doc", "row", F.posexplode("nodes").alias("at", "node"), "edges").select(
        "doc", "row", "at", "node", F.get("edges", F.col("at")).alias("before"), F.get("edges", F.col("at") + 1).alias("after")
    )
    nodes = occurrences.groupBy("node").agg(
        F.count("*").alias("n"), F.min("before").alias("b0"), F.max("before").alias("b1"),
        F.min("after").alias("a0"), F.max("after").alias("a1"), F.min("doc").alias("d0"), F.max("doc").alias("d1"),
    ).where("n > 1 AND d0 < d1").select("node", ((F.col("b0") == F.col("b1")) & (F.col("a0") == F.col("a1"))).alias("plain"))
    places = lists.select("doc", "row", F.posexplode("nodes").alias("at", "node")).join(nodes, "node")
    repeated = places.groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.struct("at", "plain"))).alias("found"))
    some = rows.join(repeated, ["doc", "row"]).select(
        "doc", "row", "content", F.col("found.at").alias("at"), F.col("found.plain").alias("plain")
    )
    some = materialised(some.dropDuplicates(["doc", "row"]), "substring_candidates")

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for doc, row, content, at, plain in zip(*[batch.column(j).to_pylist() for j in range(5)], strict=True):
                found = np.array(list(claims_of(content, at, plain, width, k, hashes)), np.int64).reshape(-1, 4)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, doc, np.int64)), pa.array(np.full(n, row, np.int64)), pa.array(found[:, 0]),
                     pa.array(found[:, 1]), pa.array(found[:, 2].astype(np.int32)), pa.array(found[:, 3].astype(np.int32))],
                    names=["doc", "row", "a", "b", "first", "last"],
                )

    claims = some.mapInArrow(claim, "doc long, row long, a long, b long, first int, last int")
    lowest = claims.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most")
    repeats = claims.join(lowest, ["a", "b"]).where("least < doc")
    spans = repeats.groupBy("doc", "row").agg(
        F.collect_list(F.struct("first", (F.col("last") + width).alias("end"))).alias("spans")
    )
    return some.select("doc", "row", "content").join(spans, ["doc", "row"])


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, k: int = K) -> DataFrame:
    """``key, n_words, n_removed, kept``: every row with the words that stay, joined by one space."""
    spans = materialised(
        removed_spans(docs, key, text, width, k).select("doc", "row", "spans"), "substring_spans"
    )
    rows = docs.select(F.col(key).cast("long").alias("doc"), row_key(text).alias("row"), F.col(text).alias("content"))
    joined = rows.join(spans, ["doc", "row"], "left").select(
        "doc", "content", F.col("spans.first").alias("first"), F.col("spans.end").alias("end")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                some = batch.slice(part, 512)
                total, gone, kept = [], [], []
                for content, first, end in zip(*[some.column(j).to_pylist() for j in (1, 2, 3)], strict=True):
                    words = words_of(content)
                    rest = kept_words(words, merged(list(zip(first, end, strict=True)))) if first else words
                    total.append(len(words))
                    gone.append(len(words) - len(rest))
                    kept.append(b" ".join(rest).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc", "n_words", "n_removed", "kept"],
                )

    out = joined.mapInArrow(cut, "doc long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("doc", key)
