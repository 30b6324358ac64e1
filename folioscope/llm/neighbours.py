"""Operator 3: nearest neighbours by inner product, with an adaptive scan of dimensions in probed lists.

The index is fitted on at most ``SAMPLE`` vectors: a random rotation and the centroids of ``LISTS`` lists. How many
lists a query probes is the smallest number that finds ``TARGET`` of the neighbours within the sample. Every vector is
indexed: it goes to the list of its nearest centroid.

Vectors are dealt by hash to parts of about ``PART`` rows, sorted by list within a part; every query visits every part
(the queries are a stated set). There it scans its nearest list in full, which gives a bar, and then the other probed
lists, rotated column block by column block: as rotated coordinates are like a random sample, the distance over the
blocks seen so far estimates the whole distance, and a candidate whose estimate is beyond what chance explains is
abandoned (ADSampling, Gao and Long 2023). Inner product and distance are tied by the norms, so each candidate has its
own limit. Survivors are scored in double precision on the original vectors.

Vectors that are null, zero, hold null or non-finite components, or have no id, take no part. Every row is a vector of
its own, also where rows share an id; a row finds the others with its id. A shorter vector counts as if zeros followed.
Fewer candidates than asked for: all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialised

SAMPLE, LISTS, PART, BLOCK, TARGET = 4096, 64, 8192, 16, 0.98
#: How many standard errors a partial distance may exceed its limit by.
CAUTION = 2.1


class Lists:
    """Rotation, centroids and the number of probes, fitted on a sample."""

    def __init__(self, sample: np.ndarray, k: int, lists: int = LISTS, target: float = TARGET, seed: int = 11):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        rotated = sample @ self.rotation
        lists = max(1, min(lists, len(rotated) // 16))
        self.centroids = rotated[rng.permutation(len(rotated))[:lists]]
        for _ in range(8):
            own = self.nearest(rotated)
            for c in range(lists):
                if (own == c).any():
                    self.centroids[c] = rotated[own == c].mean(axis=0)
        own, queries = self.nearest(rotated), rotated[rng.permutation(len(rotated))[:256]]
        scores = queries @ rotated.T
        best = np.argsort(-scores, axis=1, kind="stable")[:, : min(k, len(rotated))]
        rank = np.argsort(np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
        self.probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1

    def nearest(self, rotated: np.ndarray) -> np.ndarray:
        return (rotated @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)).argmax(axis=1)


class Part:
    """The vectors of one part, sorted by list."""

    def __init__(self, ids: np.ndarray, names: np.ndarray, vectors: np.ndarray, lists: Lists):
        rotated = vectors @ lists.rotation
        own = lists.nearest(rotated)
        order = np.lexsort((names, ids, own))
        self.lists, self.ids, self.names, self.vectors, self.own = lists, ids[order], names[order], vectors[order], own[order]
        self.blocks = [np.ascontiguousarray(rotated[order][:, d : d + BLOCK]) for d in range(0, rotated.shape[1], BLOCK)]
        self.norms = (vectors[order] ** 2).sum(axis=1)
        self.bounds = np.searchsorted(self.own, np.arange(len(lists.centroids) + 1))

    def search(self, name: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, row names and scores of the best rows but the one called ``name``."""
        rotated = query @ self.lists.rotation
        order = np.argsort(-(self.lists.centroids @ rotated), kind="stable")[: self.lists.probes]
        seen, found, scores, bar = 0, [], [], -np.inf
        # The nearest lists in full until there are enough rows for a bar.
        while seen < len(order) and sum(map(len, found)) <= k:
            rows = np.arange(self.bounds[order[seen]], self.bounds[order[seen] + 1])
            rows = rows[self.names[rows] != name]
            found.append(rows)
            scores.append(self.vectors[rows] @ query)
            seen += 1
        have = np.concatenate(scores) if scores else np.zeros(0)
        if len(have) >= k:
            bar = np.partition(have, len(have) - k)[len(have) - k]
        probed = np.zeros(len(self.lists.centroids), bool)
        probed[order[seen:]] = True
        rows = np.flatnonzero(probed[self.own])
        rows = rows[self.names[rows] != name]
        limit = query @ query + self.norms[rows] - 2 * bar
        partial, dims, total = np.zeros(len(rows)), 0, len(query)
        for b, block in enumerate(self.blocks):
            at = b * BLOCK
            partial += ((block[rows] - rotated[at : at + BLOCK]) ** 2).sum(axis=1)
            dims += block.shape[1]
            slack = (1 + CAUTION / np.sqrt(dims)) ** 2 if dims < total else 1 + 1e-9
            keep = partial * (total / dims) <= limit * slack + 1e-9
            rows, partial, limit = rows[keep], partial[keep], limit[keep]
        found.append(rows)
        scores.append(self.vectors[rows] @ query)
        rows, have = np.concatenate(found), np.concatenate(scores)
        top = np.lexsort((self.names[rows], self.ids[rows], -have))[:k]
        return self.ids[rows[top]], self.names[rows[top]], have[top]


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, name, v`` of the vectors that take part, all of one length."""
    v = F.col(vector).cast("array<double>")
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = embeddings.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    rows = rows.where(sound)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - F.size("v")))
    # A row is named once and for all: the table is written.
    return materialised(rows.select("id", F.monotonically_increasing_id().alias("name"), padded.alias("v")), "vectors")


def nearest_neighbours(
    embeddings: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
    sample: int = SAMPLE, part: int = PART,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row for which ``queries`` (over ``id``) holds."""
    spark = embeddings.sparkSession
    rows = usable(embeddings, key, vector)
    n = rows.count()
    share = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1)))
    known = rows.where(share).orderBy("id", "name").limit(2 * sample).toArrow().column("v").to_pylist()
    if not known:
        known = [r.v for r in rows.limit(sample).collect()]
    empty = "query_id long, rank int, vec_id long, score double"
    if not known:
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(Lists(np.array(known), k))
    parts = max(1, -(-n // part))
    dealt = rows.select(F.pmod(F.xxhash64("id", "name"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("asks"), "id", "name", "v")
    asked = rows.where(queries).select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("asks"), "id", "name", "v")

    def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return flat.flatten().to_numpy().reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, names, vectors, held, here = shared.value, [], [], [], None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            part, asks = table.column("part").to_numpy(), table.column("asks").to_numpy()
            cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(part)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if part[i] != here:
                    here, ids, names, vectors, held = part[i], [], [], [], None
                own, called = table.column("id").to_numpy()[i:j], table.column("name").to_numpy()[i:j]
                values = matrix(table.column("v").slice(i, j - i))
                if not asks[i]:
                    ids.append(own)
                    names.append(called)
                    vectors.append(values)
                    continue
                if held is None:
                    held = Part(*map(np.concatenate, (ids, names, vectors)), index) if ids else False
                if held is False:
                    continue
                for query_id, name, query in zip(own.tolist(), called.tolist(), values, strict=True):
                    found, found_names, scores = held.search(name, query, k)
                    asked = [[x] * len(found) for x in (query_id, name)]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(x, pa.int64()) for x in (*asked, found, found_names)), pa.array(scores, pa.float64())],
                        names=["query_id", "query", "vec_id", "name", "score"],
                    )

    together = dealt.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "asks", "id", "name")
    found = together.mapInArrow(search, "query_id long, query long, vec_id long, name long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "name")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
