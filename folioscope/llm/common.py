"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialised

__all__ = ["Hashes", "components", "materialised", "row_key", "row_groups", "same_row", "windowed_hash"]


class Hashes(dict):
    """word (bytes) -> 64-bit hash. Remembers words while there is room; forgetting only costs time."""

    def __init__(self, room: int = 1 << 18):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.room:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2 … modulo 2^64."""
    steps = np.full(max(n, 1), base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Odd multipliers of two independent window hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def windowed_hash(ids: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of each run of ``width`` values: sum of ids[p + j] * base^j modulo 2^64, then mixed."""
    n = len(ids)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(ids * powers(base, n), out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    return mixed((total[width:] - total[:-width]) * powers(inverse, n - width + 1))


def row_key(text: str = "text") -> Column:
    """With the document's id, names a row: rows alike in both are one document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def same_row(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Null-safe equality of the named columns."""
    found = left[columns[0]].eqNullSafe(right[columns[0]])
    for name in columns[1:]:
        found = found & left[name].eqNullSafe(right[name])
    return found


def row_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first ``n_keys`` columns, of a stream sorted by these.

    Holds one run and one batch at a time. Key columns must not be null.
    """
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        change = np.zeros(n, bool)
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        first = tuple(key[0] for key in keys)
        change[0] = last is not None and first != last
        last = tuple(key[-1] for key in keys)
        begin = 0
        for cut in np.flatnonzero(change):
            if cut > begin:
                waiting.append(batch.slice(begin, cut - begin))
            if waiting:
                yield pa.Table.from_batches(waiting)
            waiting, begin = [], int(cut)
        waiting.append(batch.slice(begin))
    if waiting:
        yield pa.Table.from_batches(waiting)


def components(edges: DataFrame, name: str = "component", max_rounds: int = 100) -> DataFrame:
    """Connected components of ``edges (a, b)``: rows ``(node, root)``, root being the smallest node.

    Alternates the large-star and the small-star step (Kiveris et al. 2014): the number of edges never grows, a hub
    is summarised by a minimum before it is joined, and the rounds are logarithmic in practice. Each round is a table
    in the shared folder.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        joined = both.join(lowest, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(
                lowest.select("a", F.col("root").alias("b"))
            )
        return out.where(F.col("a") != F.col("b")).distinct()

    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = materialised(pairs.where(F.col("a") != F.col("b")).distinct(), name)

    def state(frame: DataFrame):
        return tuple(frame.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())

    seen = state(pairs)
    for _ in range(max_rounds):
        pairs = materialised(stars(stars(pairs, True), False), name)
        now = state(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return nodes.unionByName(roots)
