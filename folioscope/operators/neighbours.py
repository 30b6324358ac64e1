"""Exact k-nearest-neighbour vote in the plane, over a partition tree split at ranks of the data.

Equal coordinates are one *site*: all its points share their neighbours, and only its ``k`` smallest keys can be a
neighbour of anything, so a third of the table at one spot costs ``k`` entries.

Sites are dealt to strips, ranges of ``x`` that hold about equally many of them wherever they lie; there are about
``sqrt(n)`` strips. A task splits its strip at medians, of the longer side of each part, down to parts of ``leaf``
sites: a balanced tree, so a point at 1e15 costs no level and a dense spot no depth. First each site is searched in its
own strip. Its k-th distance there bounds the rest, so in the one further round it visits just the strips that come
that near, and the best of all are merged. Nothing is capped, and distances are compared as they are computed: rounding
keeps order, so a part that is left out can't hold a neighbour, and the result is the brute-force one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import materialised

#: Sites of a part that is not split further.
LEAF = 32
#: Sites of a strip, at most about; their search holds some hundred bytes a site.
STRIP = 1 << 18
#: Pairs of a site and a part, or of two sites, that are looked at in one step.
STEPS = 1 << 20


class Strip:
    """The sites of a strip in a balanced tree. ``ids`` and ``labels`` list the sites' points one after the other."""

    def __init__(self, x: np.ndarray, y: np.ndarray, near: pa.ListArray, k: int, leaf: int):
        self.at, self.k, n = np.stack([x, y]), k, len(x)
        points = near.flatten()
        self.ids, self.labels = points.field(0), points.field(1)
        self.first = np.append(0, np.cumsum(near.value_lengths().to_numpy(zero_copy_only=False)))
        self.rank = np.unique(self.ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        self.order, starts = np.arange(n), np.zeros(1, np.int64)
        # Every part holds k sites, unless the whole strip doesn't.
        while n > max(leaf, 2 * k) * len(starts):
            low, high = self.box(starts)
            wide = np.argmax(high - low, axis=0)
            part = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            own = self.at[:, self.order]
            self.order = self.order[np.lexsort((np.where(wide[part] == 0, *own), part))]
            middle = starts + np.diff(np.append(starts, n)) // 2
            starts = np.stack([starts, middle], axis=1).ravel()
        self.starts, self.ends = starts, np.append(starts[1:], n)
        self.boxes = [self.box(starts)]
        while len(self.boxes[0][0][0]) > 1:
            low, high = self.boxes[0]
            self.boxes.insert(0, (np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2])))

    def box(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.at[:, self.order]
        return np.minimum.reduceat(own, starts, axis=1), np.maximum.reduceat(own, starts, axis=1)

    def gap2(self, site: np.ndarray, level: int, part: np.ndarray) -> np.ndarray:
        """Squared distance of ``site`` (2 x n) to the boxes of the parts."""
        return box_gap2(site, self.boxes[level][0][:, part], self.boxes[level][1][:, part])

    def reach2(self, site: np.ndarray, known: np.ndarray) -> np.ndarray:
        """``known``, or the k-th squared distance in the part that a descent to the nearer half ends in."""
        part = np.zeros(site.shape[1], np.int64)
        for level in range(1, len(self.boxes)):
            left = self.gap2(site, level, 2 * part)
            part = 2 * part + (self.gap2(site, level, 2 * part + 1) < left)
        size = self.ends[part] - self.starts[part]
        place = self.starts[part][:, None] + np.arange(size.max(initial=0))
        there = place < self.ends[part][:, None]
        if place.shape[1] < self.k:
            return known
        found = self.at[:, self.order[np.where(there, place, 0)]]
        d2 = np.where(there, squared(site[:, :, None], found), np.inf)
        return np.minimum(known, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1])

    def search(self, site: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ``k`` best points of each site within its known reach: ``(site, d2, point)``, sorted by site and rank."""
        found = []
        for begin in range(0, site.shape[1], STEPS // 64):
            some = np.arange(begin, min(begin + STEPS // 64, site.shape[1]))
            found.append(self.within(some, site, self.reach2(site[:, some], known[some])))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def within(self, some: np.ndarray, site: np.ndarray, reach: np.ndarray):
        base = some[0]
        stack = [(0, some, np.zeros(len(some), np.int64))]
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        while stack:
            level, who, part = stack.pop()
            if len(who) > STEPS // 32:
                half = len(who) // 2
                stack += [(level, who[half:], part[half:]), (level, who[:half], part[:half])]
                continue
            kept = self.gap2(site[:, who], level, part) <= reach[who - base]
            who, part = who[kept], part[kept]
            if level + 1 < len(self.boxes):
                if len(who):
                    stack.append((level + 1, np.repeat(who, 2), np.stack([2 * part, 2 * part + 1], axis=1).ravel()))
                continue
            who, place = spelt_out(who, self.starts[part], self.ends[part])
            other = self.order[place]
            d2 = squared(site[:, who], self.at[:, other])
            kept = d2 <= reach[who - base]
            who, d2, other = who[kept], d2[kept], other[kept]
            who, point, d2 = *spelt_out(who, self.first[other], self.first[other + 1]), np.repeat(
                d2, self.first[other + 1] - self.first[other])
            best = self.best(*(np.concatenate(x) for x in zip(best, (who, d2, point), strict=True)))
        return best

    def best(self, who: np.ndarray, d2: np.ndarray, point: np.ndarray):
        order = np.lexsort((self.rank[point], d2, who))
        who, d2, point = who[order], d2[order], point[order]
        start = np.flatnonzero(np.append(True, who[1:] != who[:-1])[: len(who)])
        kept = np.arange(len(who)) - np.repeat(start, np.diff(np.append(start, len(who)))) < self.k
        return who[kept], d2[kept], point[kept]

    def told(self, n: int, who: np.ndarray, d2: np.ndarray, point: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """For ``n`` sites their best points as a list column, and the k-th squared distance or infinity."""
        count = np.bincount(who, minlength=n)
        ends = np.cumsum(count)
        entries = pa.StructArray.from_arrays(
            [pa.array(d2), self.ids.take(pa.array(point)), self.labels.take(pa.array(point))], ["d2", "id", "label"]
        )
        reach = np.full(n, np.inf)
        whole = count == self.k
        reach[whole] = d2[ends[whole] - 1]
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), entries), reach


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        gap_x, gap_y = b[0] - a[0], b[1] - a[1]
        return gap_x * gap_x + gap_y * gap_y


def box_gap2(site: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        gap = np.maximum(np.maximum(low - site, site - high), 0.0)
        return gap[0] * gap[0] + gap[1] * gap[1]


def spelt_out(who: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``who`` once for each number from ``first`` to before ``last``, and these numbers."""
    count = last - first
    before = np.cumsum(count) - count
    return np.repeat(who, count), np.arange(int(count.sum())) + np.repeat(first - before, count)


def in_own_strips(sites: DataFrame, strips: int, k: int, leaf: int, best_type: T.ArrayType) -> DataFrame:
    """``sites`` with ``strip``, ``best`` and ``reach2``: a task holds one strip."""
    schema = T.StructType([
        *sites.schema.fields, T.StructField("strip", T.IntegerType()), T.StructField("best", best_type),
        T.StructField("reach2", T.DoubleType()),
    ])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, number = pa.Table.from_batches(held).combine_chunks(), TaskContext.get().partitionId()
        x, y, near = whole_columns(table)
        strip, site = Strip(x, y, near, k, leaf), np.stack([x, y])
        best, reach = strip.told(len(x), *strip.search(site, np.full(len(x), np.inf)))
        columns = [pa.array(x), pa.array(y), near, pa.array(np.full(len(x), number, np.int32)), best, pa.array(reach)]
        yield from pa.table(columns, names=schema.names).to_batches(max_chunksize=8192)

    return sites.repartitionByRange(strips, "_x", "_y").mapInArrow(search, schema)


def whole_columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    near = table.column("near").combine_chunks()
    near = near.chunk(0) if isinstance(near, pa.ChunkedArray) else near
    return table.column("_x").to_numpy(), table.column("_y").to_numpy(), near


def visits(found: DataFrame) -> DataFrame:
    """``strip, _x, _y, reach2``: the other strips that come as near to a site as its k-th distance.

    What is broadcast is a box per strip, 40 bytes each, and there are about ``sqrt(n)`` strips.
    """
    rows = found.groupBy("strip").agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).orderBy("strip").collect()
    boxes = np.array([tuple(r)[1:] for r in rows], float).reshape(-1, 4)
    shared = found.sparkSession.sparkContext.broadcast(([r[0] for r in rows], boxes[:, ::2].T, boxes[:, 1::2].T))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = shared.value
        names = np.array(names, np.int32)
        for batch in batches:
            own, x, y, reach = (c.to_numpy() for c in batch.columns)
            # Strips follow each other in x: a run of them is near enough, with a margin for rounding.
            wide = np.sqrt(reach) * (1 + 1e-9) + np.abs(x) * 1e-12
            first = np.searchsorted(high[0], x - wide)
            last = np.searchsorted(low[0], x + wide, side="right")
            ahead = np.append(0, np.cumsum(last - first))
            while len(own):
                # As many sites as make a step, at least one.
                n = max(1, int(np.searchsorted(ahead, ahead[0] + STEPS, side="right")) - 1)
                who, strip = spelt_out(np.arange(n), first[:n], last[:n])
                site = np.stack([x[who], y[who]])
                near = (box_gap2(site, low[:, strip], high[:, strip]) <= reach[who]) & (names[strip] != own[who])
                who, strip = who[near], strip[near]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[strip]), pa.array(x[who]), pa.array(y[who]), pa.array(reach[who])],
                    names=["strip", "_x", "_y", "reach2"],
                )
                own, x, y, reach, first, last, ahead = (v[n:] for v in (own, x, y, reach, first, last, ahead))

    return found.select("strip", "_x", "_y", "reach2").mapInArrow(
        look, "strip int, _x double, _y double, reach2 double"
    )


def in_other_strips(found: DataFrame, asked: DataFrame, k: int, leaf: int, best_type: T.ArrayType) -> DataFrame:
    """``_x, _y, best`` for each visit that finds something. A strip's sites come first, its visitors stream past."""
    schema = T.StructType([
        T.StructField("_x", T.DoubleType()), T.StructField("_y", T.DoubleType()), T.StructField("best", best_type),
    ])
    kind = found.schema["near"].dataType
    rows = found.select("strip", F.lit(0).alias("visitor"), "_x", "_y", "reach2", "near").unionByName(
        asked.select("strip", F.lit(1).alias("visitor"), "_x", "_y", "reach2", F.lit(None).cast(kind).alias("near"))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, strip = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            state = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(state[1:] != state[:-1]) + 1).tolist(), len(state)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                some = batch.slice(begin, end - begin)
                if state[begin] // 2 != number:
                    held, number, strip = [], state[begin] // 2, None
                if state[begin] % 2 == 0:
                    held.append(some)
                    continue
                if strip is None:
                    strip = Strip(*whole_columns(pa.Table.from_batches(held).combine_chunks()), k, leaf)
                    held = []
                x, y, reach = (some.column(c).to_numpy() for c in ("_x", "_y", "reach2"))
                best, _ = strip.told(len(x), *strip.search(np.stack([x, y]), reach))
                out = pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), best], names=schema.names)
                yield out.filter(pa.array(best.value_lengths().to_numpy(zero_copy_only=False) > 0))

    return rows.repartition("strip").sortWithinPartitions("strip", "visitor").mapInArrow(search, schema)


def nearest_labels(
    df: DataFrame, key: str, label: str, x: str, y: str, k: int = 10, leaf: int = LEAF, strip: int = STRIP
) -> DataFrame:
    """``(_x, _y, neighbours)`` per site: its ``k`` nearest points as ``array<struct<d2, id, label>>``.

    The site's own points are included. Order is distance, then key. Points without two finite coordinates take no
    part.
    """
    points = df.select(
        F.col(key).alias("id"), F.col(label).alias("label"), F.col(x).cast("double").alias("_x"),
        F.col(y).cast("double").alias("_y"),
    ).where(finite("_x") & finite("_y"))
    # A rank filter on row_number is applied by every task before the shuffle, so copies stay local.
    first = Window.partitionBy("_x", "_y").orderBy("id")
    sites = (
        points.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") <= k)
        .groupBy("_x", "_y")
        .agg(F.collect_list(F.struct("id", "label")).alias("near"))
    )
    sites = materialised(sites, "sites")
    n = sites.count()
    strips = max(1, math.ceil(math.sqrt(n / 64)), math.ceil(n / strip))
    entry = T.StructType([
        T.StructField("d2", T.DoubleType()), *[T.StructField(f.name, f.dataType) for f in points.schema.fields[:2]]
    ])
    best_type = T.ArrayType(entry)
    found = materialised(in_own_strips(sites, strips, k, leaf, best_type), "strips")
    others = in_other_strips(found, visits(found), k, leaf, best_type)
    best = found.select("_x", "_y", "best").unionByName(others)
    return best.groupBy("_x", "_y").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("neighbours")
    )


def finite(column: str):
    """True for a number, false for null, NaN and the infinities (NaN compares above all numbers)."""
    return F.coalesce(F.abs(F.col(column)) < F.lit(math.inf), F.lit(False))


def majority(labels):
    """Most frequent element of an array; ties go to the smallest."""
    tallies = F.transform(
        F.array_distinct(labels),
        lambda one: F.struct((-F.size(F.filter(labels, lambda other: other == one))).alias("n"), one.alias("label")),
    )
    return F.array_min(tallies)["label"]


def neighbour_outliers(
    df: DataFrame, key: str, label: str, x: str, y: str, k: int = 10, leaf: int = LEAF, strip: int = STRIP
) -> DataFrame:
    """Add ``parti_geographique`` (label of the neighbourhood) and ``is_outlier_knn`` (it differs from its own).

    A point without two finite coordinates has no neighbourhood: null and false.
    """
    voted = nearest_labels(df, key, label, x, y, k, leaf, strip).select(
        "_x", "_y", majority(F.transform("neighbours", lambda p: p["label"])).alias("parti_geographique")
    )
    placed = df.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    out = placed.join(voted, ["_x", "_y"], "left")
    differs = finite("_x") & finite("_y") & ~F.col(label).eqNullSafe(F.col("parti_geographique"))
    return out.withColumn("is_outlier_knn", differs).drop("_x", "_y")
