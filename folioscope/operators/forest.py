"""Random forests whose trees are grown where their rows are.

Spark's own forest fills a histogram per partition for every node, however few rows it has, so a tree that is grown
down to single rows costs partitions x nodes x histogram. Here only nodes of more than ``ROWS_IN_TASK`` rows are split
by histograms that all tasks add up. The rows of a smaller node are sent to one task, once, and the rest of the tree
below it is grown there. Every tree still draws from all rows.

The forest is the one that is described by Breiman and grown by Spark: a Poisson(1) draw of rows and a random set of
features per node, splits at quantiles of a feature (32 bins) by Gini impurity, down to pure nodes. Class shares of the
leaves are averaged; equal-voting leaves are not merged. All draws are hashes of row, tree and place in the tree, so
the trees do not depend on where they are grown.

Rows travel in packed blocks, so what is shuffled is rows x trees x features bytes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialised, spread

BINS = 32
#: Rows of nodes whose bins are numbered without the empty ones.
FEW_ROWS = (4, 8, 16)
#: Drawn rows of the largest node whose subtree one task grows.
ROWS_IN_TASK = 200_000
#: Bytes of the histograms that are judged at once; 32 times as many are added up over the tasks in one job.
HISTOGRAMS = 2 << 20
#: Shares of the leaves are added up as whole numbers, so that their sum has no order.
VOTE = 1 << 32
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])
PACKED = "block long, row binary, x binary, y binary, w binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (splitmix64)."""
    x = np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def child_seeds(seeds: np.ndarray) -> np.ndarray:
    """Seeds of the left and right children of nodes, side by side."""
    return np.stack([mixed(seeds ^ np.uint64(1)), mixed(seeds ^ np.uint64(2))], axis=1)


@dataclass
class Rules:
    """What every node is split by."""

    n_features: int
    n_classes: int
    tried: int
    seed: int
    max_depth: int
    min_leaf: int
    min_split: int = 2

    def root_seed(self, tree: int) -> np.ndarray:
        return mixed(mixed(np.array([self.seed])) + np.uint64(tree))

    def drawn(self, row: np.ndarray, tree: int) -> np.ndarray:
        """How often each row is in the sample of a tree."""
        u = mixed(mixed(row) ^ self.root_seed(tree)) >> np.uint64(11)
        return np.searchsorted(POISSON, u / float(1 << 53), side="right")

    def tried_features(self, seeds: np.ndarray) -> np.ndarray:
        """``(nodes, tried)``: the features that each node looks at."""
        order = mixed(seeds[:, None] + np.arange(1, self.n_features + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B9))
        return np.argsort(order, axis=1, kind="stable")[:, : self.tried]

    def node_bytes(self) -> int:
        return 8 * self.tried * BINS * (self.n_classes + 1)

    def histograms(self, at: np.ndarray, n: int, features: np.ndarray, x, y, w, c) -> np.ndarray:
        """``(nodes, tried, bins, classes + 1)``: weights of the classes, and rows, of every bin; ``at`` is the node."""
        return self.added(at, n, np.take_along_axis(x, features[at], axis=1).astype(np.int64), BINS, y, w, c)

    def few_bins(self, at: np.ndarray, n: int, features: np.ndarray, x, y, w, c) -> tuple[np.ndarray, np.ndarray]:
        """The same over the bins that hold a row of the node, and these. ``at`` ascends and names each of the nodes."""
        values = np.take_along_axis(x, features[at], axis=1)
        bit = np.uint32(1) << values.astype(np.uint32)
        taken = np.bitwise_or.reduceat(bit, np.searchsorted(at, np.arange(n)), axis=0)
        place = np.bitwise_count(taken[at] & (bit - np.uint32(1))).astype(np.int64)
        bins = int(np.bitwise_count(taken).max())
        name = np.zeros((n, self.tried, bins), np.uint8)
        name[at[:, None], np.arange(self.tried)[None, :], place] = values
        return self.added(at, n, place, bins, y, w, c), name

    def added(self, at: np.ndarray, n: int, values: np.ndarray, bins: int, y, w, c) -> np.ndarray:
        cell = (at[:, None] * self.tried + np.arange(self.tried)[None, :]) * bins + values
        cells = n * self.tried * bins
        width = self.n_classes
        weights = np.bincount((cell * width + y[:, None]).ravel(), np.repeat(w, self.tried), cells * width)
        counts = np.bincount(cell.ravel(), np.repeat(c, self.tried), cells)
        return np.concatenate([weights.reshape(-1, width), counts[:, None]], axis=1).reshape(n, self.tried, bins, width + 1)

    def best_splits(self, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each node: whether it splits, the place of its feature, the last bin to the left, and both sides' sums."""
        left = np.cumsum(hist, axis=2)
        right = left[:, :, -1:] - left
        least = max(self.min_leaf, 1)

        def purity(side):
            total = side[..., :-1].sum(axis=-1)
            return np.square(side[..., :-1]).sum(axis=-1) / np.where(total > 0, total, 1.0)

        whole = purity(left[:, :1, -1])[:, :, None]
        gain = purity(left) + purity(right) - whole
        allowed = (left[..., -1] >= least) & (right[..., -1] >= least)
        gain = np.where(allowed, gain, -1.0).reshape(len(hist), -1)
        best = gain.argmax(axis=1)
        splits = gain[np.arange(len(hist)), best] > 1e-12 * whole[:, 0, 0]
        place, cut = np.divmod(best, hist.shape[2])
        n = np.arange(len(hist))
        return splits, place, cut, np.stack([left[n, place, cut], right[n, place, cut]], axis=1)


def descended(nodes: dict, x: np.ndarray) -> np.ndarray:
    """The node without children that each row ends in; the right child follows the left."""
    at = np.zeros(len(x), dtype=np.int64)
    going = np.flatnonzero(nodes["left"][at] >= 0)
    while len(going):
        here = at[going]
        at[going] = nodes["left"][here] + (x[going, nodes["feature"][here]] > nodes["cut"][here])
        going = going[nodes["left"][at[going]] >= 0]
    return at


def leaf(shares: np.ndarray) -> dict:
    return {"feature": np.zeros(1, np.int32), "cut": np.zeros(1, np.uint8), "left": np.full(1, -1, np.int32),
            "shares": shares.reshape(1, -1).astype(np.float32)}


def stops(nodes: dict, cuts: list[tuple[int, int]]) -> np.ndarray:
    """``(cuts, nodes)``: where a row at a node ends if the tree stops at a depth and does not split fewer rows.

    Both only take away what lies below a node, so a tree holds all of its smaller ones.
    """
    out = np.tile(np.arange(len(nodes["left"])), (len(cuts), 1))
    depth, size = np.array(cuts).T[:, :, None]
    inner = np.flatnonzero(nodes["left"] >= 0)
    for level in np.split(inner, np.flatnonzero(np.diff(nodes["depth"][inner])) + 1):
        end, left = out[:, level], nodes["left"][level]
        over = (end != level) | (nodes["depth"][level] >= depth) | (nodes["size"][level] < size)
        out[:, left], out[:, left + 1] = np.where(over, end, left), np.where(over, end, left + 1)
    return out


def grown(rules: Rules, seed: np.ndarray, depth: int, x, y, w, c) -> dict:
    """The tree over these rows, level by level; a level's nodes are split together."""
    levels, at, seeds, made = [], np.zeros(len(x), dtype=np.int64), seed, 1
    while len(seeds):
        n = len(seeds)
        sums = np.bincount(at * rules.n_classes + y, w, n * rules.n_classes).reshape(n, rules.n_classes)
        feature, cut, left = np.zeros(n, np.int32), np.zeros(n, np.uint8), np.full(n, -1, np.int32)
        size = np.bincount(at, c, n)
        shares = sums / sums.sum(axis=1, keepdims=True)
        open_ = (shares.max(axis=1) < 1.0) & (size >= rules.min_split)
        impure = np.flatnonzero(open_) if depth < rules.max_depth else np.zeros(0, np.int64)
        # A node of few rows has few bins. Those of up to 4, 8, 16 and more rows are split together.
        scale = np.searchsorted(FEW_ROWS, np.bincount(at, minlength=n)[impure])
        impure, scale = impure[(order := np.argsort(scale, kind="stable"))], scale[order]
        rank = np.full(n, -1)
        rank[impure] = np.arange(len(impure))
        kept = np.flatnonzero(rank[at] >= 0)
        kept = kept[np.argsort(rank[at[kept]], kind="stable")]
        x, y, w, c, at = x[kept], y[kept], w[kept], c[kept], at[kept]
        step = max(1, HISTOGRAMS // rules.node_bytes())
        begins = np.searchsorted(scale, np.arange(len(FEW_ROWS) + 2))
        steps = [(low, min(low + step * (BINS // most), end), most < BINS)
                 for begin, end, most in zip(begins[:-1], begins[1:], (*FEW_ROWS, BINS), strict=True)
                 for low in range(begin, end, step * (BINS // most))]
        for low, high, few in steps:
            part = impure[low:high]
            rows = slice(*np.searchsorted(rank[at], [low, high]))
            features, these = rules.tried_features(seeds[part]), rank[at[rows]] - low
            if few:
                hist, bins = rules.few_bins(these, len(part), features, x[rows], y[rows], w[rows], c[rows])
            else:
                hist = rules.histograms(these, len(part), features, x[rows], y[rows], w[rows], c[rows])
            splits, place, last, _ = rules.best_splits(hist)
            if few:
                last = bins[np.arange(len(part)), place, last]
            part, place, last = part[splits], place[splits], last[splits]
            feature[part], cut[part], left[part] = features[splits, place], last, 0
        split = np.flatnonzero(left >= 0)
        left[split] = made + 2 * np.arange(len(split))
        levels.append({"feature": feature, "cut": cut, "left": left, "shares": shares.astype(np.float32),
                       "depth": np.full(n, depth, np.int32), "size": size})
        first = made
        made, depth = made + 2 * len(split), depth + 1
        seeds = child_seeds(seeds[split]).ravel()
        kept = np.flatnonzero(left[at] >= 0)
        x, y, w, c, at = x[kept], y[kept], w[kept], c[kept], at[kept]
        at = left[at] - first + (x[np.arange(len(x)), feature[at]] > cut[at])
    return {name: np.concatenate([level[name] for level in levels]) for name in levels[0]}


# -- rows -------------------------------------------------------------------------------------------------------------


def bin_edges(df: DataFrame, features: str) -> list[np.ndarray]:
    """Of each feature, the values that end its bins: the least one, and quantiles below the largest."""
    long = df.select(F.posexplode(vector_to_array(F.col(features))).alias("j", "x"))
    inner = [i / (BINS - 1) for i in range(1, BINS - 1)]
    rows = long.groupBy("j").agg(
        F.percentile_approx("x", inner, 10_000).alias("q"), F.min("x").alias("least"), F.max("x").alias("most")
    )
    found = rows.orderBy("j").collect()
    if not np.isfinite([[r.least, r.most] for r in found]).all():
        raise ValueError("features must be finite numbers")
    ends = ((np.unique([r.least, *r.q]), r.most) for r in found)
    return [values[values < most] for values, most in ends]


def packed(df: DataFrame, features: str, label: str | None, weight: str | None, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of rows with their features as bins. ``df`` has a column ``_row``; a row without features is left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            row, y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            x = np.empty(values.shape, np.uint8)
            for j, ends in enumerate(edges):
                x[:, j] = np.searchsorted(ends, values[:, j], side="left")
            cells = [row.astype(np.int64), x, y.astype(np.int32), w.astype(np.float64)]
            yield batch_of(block=[int(row[0])], row=[cells[0]], x=[cells[1]], y=[cells[2]], w=[cells[3]])

    known = df.where(F.col(features).isNotNull())
    y = F.lit(0) if label is None else F.col(label).cast("int")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = known.select("_row", vector_to_array(F.col(features)).alias("x"), y.alias("y"), w.alias("w"))
    return materialised(rows.mapInArrow(pack, PACKED), "blocks")


def batch_of(**columns) -> pa.RecordBatch:
    """Lists of numbers as long columns, lists of arrays as binary ones."""
    arrays = {}
    for name, values in columns.items():
        if isinstance(values[0], np.ndarray):
            arrays[name] = pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.binary())
        else:
            arrays[name] = pa.array(values, pa.int64())
    return pa.RecordBatch.from_pydict(arrays)


def joined(values, kind) -> np.ndarray:
    """The arrays of a binary column, one after the other."""
    return np.frombuffer(b"".join(values), dtype=kind)


def blocks_of(batches: Iterator[pa.RecordBatch], n_features: int):
    for batch in batches:
        for block in batch.to_pylist():
            row = np.frombuffer(block["row"], np.int64)
            x = np.frombuffer(block["x"], np.uint8).reshape(len(row), n_features)
            yield block["block"], row, x, np.frombuffer(block["y"], np.int32), np.frombuffer(block["w"], np.float64)


# -- tops of the trees ------------------------------------------------------------------------------------------------

SPLIT, WAITING, IN_TASK, DONE = range(4)


class Top:
    """The nodes of a tree that were split by histograms, and those below them where it goes on."""

    def __init__(self, seed: np.ndarray, n: int):
        self.feature, self.cut, self.left, self.depth = [0], [0], [-1], [0]
        self.seed, self.state, self.shares = [seed], [WAITING if n > ROWS_IN_TASK else IN_TASK], [None]

    def nodes(self) -> dict:
        return {"feature": np.array(self.feature, np.int32), "cut": np.array(self.cut, np.uint8),
                "left": np.array(self.left, np.int64)}

    def split(self, node: int, rules: Rules, feature: int, cut: int, sides: np.ndarray) -> None:
        self.feature[node], self.cut[node], self.left[node], self.state[node] = feature, cut, len(self.left), SPLIT
        for seed, side in zip(child_seeds(self.seed[node])[0], sides, strict=True):
            shares = side[:-1] / side[:-1].sum()
            over = shares.max() == 1.0 or self.depth[node] + 1 == rules.max_depth or side[-1] < rules.min_split
            self.state.append(IN_TASK if side[-1] <= ROWS_IN_TASK else DONE if over else WAITING)
            self.shares.append(shares)
            self.seed.append(np.array([seed], np.uint64))
            self.depth.append(self.depth[node] + 1)
            self.feature.append(0), self.cut.append(0), self.left.append(-1)


def split_by_histograms(blocks: DataFrame, rules: Rules, tops: list[Top], waiting: list[tuple[int, int]]) -> None:
    """Split these nodes. Every task adds up its rows, the sums of a node meet in one task, which finds its split."""
    nodes = [top.nodes() for top in tops]
    features = rules.tried_features(np.concatenate([tops[t].seed[i] for t, i in waiting]))
    places = {}
    for place, (t, i) in enumerate(waiting):
        places.setdefault(t, np.full(len(nodes[t]["left"]), -1))[i] = place

    def added(batches):
        total = None
        for _, row, x, y, w in blocks_of(batches, rules.n_features):
            for t, place in places.items():
                c = rules.drawn(row, t)
                rows = np.flatnonzero(c)
                at = place[descended(nodes[t], x[rows])]
                rows, at = rows[at >= 0], at[at >= 0]
                mine, at = np.unique(at, return_inverse=True)
                if len(mine):
                    if total is None:
                        total = np.zeros((len(waiting), rules.tried, BINS, rules.n_classes + 1))
                    c = c[rows]
                    total[mine] += rules.histograms(at, len(mine), features[mine], x[rows], y[rows], w[rows] * c, c)
        for place in range(len(waiting) if total is not None else 0):
            yield batch_of(place=[place], sums=[total[place]])

    def decided(sums: pd.DataFrame) -> pd.DataFrame:
        hist = sum(np.frombuffer(s) for s in sums["sums"]).reshape(1, rules.tried, BINS, rules.n_classes + 1)
        splits, place, cut, sides = rules.best_splits(hist)
        if not splits[0]:
            sides = np.stack([hist[0, 0].sum(axis=0)] * 2)[None]
        return pd.DataFrame({"place": sums["place"].iloc[:1], "splits": splits, "tried": place, "cut": cut,
                             "sides": [sides[0].ravel()]})

    parts = blocks.mapInArrow(added, "place long, sums binary").groupBy("place")
    found = parts.applyInPandas(decided, "place long, splits boolean, tried long, cut long, sides array<double>")
    for r in found.collect():
        t, i = waiting[r.place]
        sides = np.array(r.sides).reshape(2, -1)
        if r.splits:
            tops[t].split(i, rules, int(features[r.place, r.tried]), r.cut, sides)
        else:
            tops[t].state[i], tops[t].shares[i] = DONE, sides[0][:-1] / sides[0][:-1].sum()


def parts_of(blocks: DataFrame, tops: list[Top]) -> int:
    """Partitions for the parts of the trees."""
    return max(4 * blocks.sparkSession.sparkContext.defaultParallelism, sum(len(top.left) for top in tops) // 8)


def sent(blocks: DataFrame, rules: Rules, tops: list[Top], fitting: bool) -> DataFrame:
    """The rows of every tree, by the node of its top that they end in: drawn rows to grow it, or all to judge them."""
    nodes = [top.nodes() for top in tops]
    wanted = [np.array(top.state) == IN_TASK if fitting else np.array(top.state) >= IN_TASK for top in tops]

    def send(batches):
        for block, row, x, y, w in blocks_of(batches, rules.n_features):
            for t, top in enumerate(nodes):
                c = rules.drawn(row, t) if fitting else np.ones(len(row), np.int64)
                rows = np.flatnonzero(c)
                at = descended(top, x[rows])
                ends = np.argsort(at, kind="stable")
                found, first = np.unique(at[ends], return_index=True)
                for node, mine in zip(found, np.split(ends, first[1:]), strict=True):
                    if wanted[t][node]:
                        r = rows[mine]
                        yield batch_of(tree=[t], node=[int(node)], block=[block], row=[row[r]], x=[x[r]], y=[y[r]],
                                       w=[w[r] * c[r]], c=[c[r].astype(np.uint8)])

    rows = blocks.mapInArrow(send, "tree long, node long, block long, row binary, x binary, y binary, w binary, c binary")
    return rows.repartition(parts_of(blocks, tops), "tree", "node")


# -- the forest -------------------------------------------------------------------------------------------------------


@dataclass
class Forest:
    """A fitted forest: its trees are a table, one row per part that a task grew."""

    features: str
    rules: Rules
    edges: list[np.ndarray]
    tops: list[Top]
    trees: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability``, the mean class shares of the leaves, and ``prediction``, the first most likely class.

        The rows are sent to the parts of the trees that they end in, and their shares back to their block.
        """
        rules = self.rules
        stored = materialised(df.withColumn("_row", F.monotonically_increasing_id()), "judged")
        blocks = packed(spread(stored, "_row"), self.features, None, None, self.edges)
        rows = sent(blocks, rules, self.tops, fitting=False).select("tree", "node", "block", "row", "x")
        trees = self.trees.repartition(parts_of(blocks, self.tops), "tree", "node")

        def judged(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
            out = {"block": [], "row": [], "class": [], "vote": []}
            tree = pickle.loads(trees["model"].iloc[0]) if len(rows) else None
            for block, row, x in zip(rows["block"], rows["row"], rows["x"], strict=True):
                row = np.frombuffer(row, np.int64)
                shares = tree["shares"][descended(tree, np.frombuffer(x, np.uint8).reshape(len(row), -1))]
                r, k = np.nonzero(shares)
                out["block"].append(block)
                out["row"].append(row[r].tobytes())
                out["class"].append(k.astype(np.int32).tobytes())
                out["vote"].append(np.rint(shares[r, k].astype(float) * VOTE).astype(np.int64).tobytes())
            return pd.DataFrame(out)

        def added(votes: pd.DataFrame) -> pd.DataFrame:
            row, at = np.unique(joined(votes["row"], np.int64), return_inverse=True)
            cell = at * rules.n_classes + joined(votes["class"], np.int32)
            total = np.bincount(cell, joined(votes["vote"], np.int64), len(row) * rules.n_classes)
            total = total.reshape(len(row), rules.n_classes)
            return pd.DataFrame({"_row": row, "_p": list(total / total.sum(axis=1, keepdims=True))})

        votes = rows.groupBy("tree", "node").cogroup(trees.groupBy("tree", "node")).applyInPandas(
            judged, "block long, row binary, class binary, vote binary"
        )
        cores = df.sparkSession.sparkContext.defaultParallelism
        shares = votes.repartition(4 * cores, "block").groupBy("block").applyInPandas(added, "_row long, _p array<double>")
        out = stored.join(materialised(shares, "shares"), "_row", "left")
        first = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return out.withColumns({"probability": F.when(F.col("_p").isNotNull(), array_to_vector("_p")), "prediction": first}).drop("_row", "_p")


def tried_count(strategy: str, n: int) -> int:
    """How many of ``n`` features a node looks at."""
    named = {"sqrt": math.sqrt(n), "auto": math.sqrt(n), "log2": math.log2(n), "onethird": n / 3, "all": n}
    return min(n, max(1, math.ceil(named[strategy] if strategy in named else float(strategy))))


def grow_forest(
    train: DataFrame, features: str, label: str, weight: str, seed: int, n_trees: int, max_depth: int, min_leaf: int,
    strategy: str, min_split: int = 2, row: str | None = None,
) -> Forest:
    """Fit on rows that all have a class index and finite features; others are an error, as they are in Spark ML.

    The rows are drawn by their number in the column ``row``, if one is named.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row).cast("long")
    stored = materialised(train.select(features, label, weight, number.alias("_row")), "drawn")
    named = F.coalesce((F.col(label) >= 0) & (F.col(label) == F.floor(label)), F.lit(False))
    n, most, odd = stored.agg(F.count("*"), F.max(label), F.count_if(~named | F.col(features).isNull())).first()
    if odd:
        raise ValueError("labels must be class indices and features must not be null")
    if not n:
        raise ValueError("there is no row, so there is no forest to fit")
    edges = bin_edges(stored, features)
    rules = Rules(len(edges), int(most) + 1, tried_count(strategy, len(edges)), seed, max_depth, min_leaf, min_split)
    blocks = packed(spread(stored, "_row"), features, label, weight, edges)
    tops = [Top(rules.root_seed(t), n) for t in range(n_trees)]
    at_once = max(1, 32 * HISTOGRAMS // rules.node_bytes())
    while waiting := [(t, i) for t, top in enumerate(tops) for i, state in enumerate(top.state) if state == WAITING]:
        for low in range(0, len(waiting), at_once):
            split_by_histograms(blocks, rules, tops, waiting[low : low + at_once])
    places = [{i: (top.seed[i], top.depth[i]) for i, s in enumerate(top.state) if s == IN_TASK} for top in tops]

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(rows["tree"].iloc[0]), int(rows["node"].iloc[0])
        y, w, c = joined(rows["y"], np.int32), joined(rows["w"], np.float64), joined(rows["c"], np.uint8)
        # In the order of the rows, so that sums don't depend on how blocks arrive.
        order = np.argsort(joined(rows["row"], np.int64))
        x = joined(rows["x"], np.uint8).reshape(len(y), -1)[order]
        seed, depth = places[tree][node]
        model = grown(rules, seed, depth, x, y[order].astype(np.int64), w[order], c[order].astype(float))
        return pd.DataFrame({"tree": [tree], "node": [node], "model": [pickle.dumps(model)]})

    parts = sent(blocks, rules, tops, fitting=True).groupBy("tree", "node").applyInPandas(
        grow, "tree long, node long, model binary"
    )
    ended = [(t, i, bytearray(pickle.dumps(leaf(top.shares[i])))) for t, top in enumerate(tops)
             for i, state in enumerate(top.state) if state == DONE]
    parts = parts.unionByName(train.sparkSession.createDataFrame(ended, parts.schema))
    return Forest(features, rules, edges, tops, materialised(parts, "trees"))


# -- search over folds and points -------------------------------------------------------------------------------------

#: Trees that a task of a search grows, held-out rows whose votes it sends together.
TREES, JUDGED = 125, 256
#: Bytes of the features of all rows that a task of a search may hold.
IN_TASK_BYTES = 64 << 20
ENDLESS = 1 << 30


def cut_of(point: dict) -> tuple[int, int]:
    return point["max_depth"] or ENDLESS, point["min_samples_split"]


def search_forest_folds(
    rows: DataFrame, k: int, points: list[dict], seed: int = 42, features: str = "features", label: str = "label_index"
) -> DataFrame:
    """``row, fold, predicted``: for each held-out row the class that the forest of every point and its fold gives it.

    ``rows`` is a table with ``row``, a number of its own for each, and ``fold``. Only the points of different leaf
    sizes and numbers of tried features have trees of their own: a forest of fewer trees is the beginning of a larger
    one, and depth and ``min_samples_split`` only cut a tree off, see ``stops``. A task holds the rows of a fold as bins, grows
    some trees on the training rows, and adds up their votes for the held-out rows for every cut. Classes are balanced.
    """
    known = F.col(label).isNotNull()
    named = (F.col(label) >= 0) & (F.col(label) == F.floor(label))
    if rows.where((known & ~named) | F.col(features).isNull()).count():
        raise ValueError("labels must be class indices and features must not be null")
    counts = [(r[0], int(r[1]), r[2]) for r in rows.where(known).groupBy("fold", label).count().collect()]
    kinds = list(dict.fromkeys((p["min_samples_leaf"], p["max_features"]) for p in points))
    cuts = list(dict.fromkeys(cut_of(p) for p in points))
    ends = sorted({p["n_estimators"] for p in points})
    steps = sorted({*ends, *range(0, ends[-1], TREES)})
    batches = [(kind, low, high) for low, high in zip(steps, steps[1:]) for kind in range(len(kinds))]
    edges, n_classes, folds = [], [], []
    for f in range(k):
        seen = {}
        for fold, c, n in counts:
            if fold != f:
                seen[c] = seen.get(c, 0) + n
        if not seen:
            raise ValueError("there is no row, so there is no forest to fit")
        total, training = sum(seen.values()), (F.col("fold") != f) & known
        weight = F.create_map(*[F.lit(x) for c, n in seen.items() for x in (float(c), total / (len(seen) * n))])
        edges.append(bin_edges(rows.where(training), features))
        n_classes.append(max(seen) + 1)
        mine = rows.where((F.col("fold") == f) | known).select(
            features, F.col("row").alias("_row"), F.coalesce(label, F.lit(0)).alias("y"),
            F.when(training, F.try_element_at(weight, F.col(label).cast("double"))).otherwise(0.0).alias("w"),
        )
        blocks = packed(spread(mine, "_row"), features, "y", "w", edges[-1])
        folds.append(blocks.withColumn("fold", F.lit(f)))
    blocks = folds[0]
    for other in folds[1:]:
        blocks = blocks.unionByName(other)

    def grow(parts: pd.DataFrame) -> pd.DataFrame:
        f, batch = int(parts["fold"].iloc[0]), int(parts["batch"].iloc[0])
        kind, low, high = batches[batch]
        row, w = joined(parts["row"], np.int64), joined(parts["w"], np.float64)
        order = np.argsort(row)
        row, w, y = row[order], w[order], joined(parts["y"], np.int32)[order].astype(np.int64)
        x = joined(parts["x"], np.uint8).reshape(len(row), -1)[order]
        del parts
        held = np.flatnonzero(w == 0)
        judged, leaf_size, strategy = x[held], *kinds[kind]
        rules = Rules(x.shape[1], n_classes[f], tried_count(strategy, x.shape[1]), seed, max(d for d, _ in cuts),
                      leaf_size, min(s for _, s in cuts))
        votes = np.zeros((len(cuts), len(held), n_classes[f]), np.int64)
        for tree in range(low, high):
            c = rules.drawn(row, tree) * (w > 0)
            drawn = np.flatnonzero(c)
            if not len(drawn):
                continue
            c = c[drawn].astype(float)
            model = grown(rules, rules.root_seed(tree), 0, x[drawn], y[drawn], w[drawn] * c, c)
            shares, at = np.rint(model["shares"].astype(float) * VOTE).astype(np.int64), descended(model, judged)
            for vote, end in zip(votes, stops(model, cuts), strict=True):
                vote += shares[end[at]]
        out = range(0, len(held), JUDGED)
        return pd.DataFrame({
            "fold": [f] * len(out), "part": [low // JUDGED for low in out], "kind": [kind] * len(out),
            "trees": [high] * len(out), "row": [row[held[low : low + JUDGED]].tobytes() for low in out],
            "votes": [votes[:, low : low + JUDGED].tobytes() for low in out],
        })

    def choose(parts: pd.DataFrame) -> pd.DataFrame:
        row, f = np.frombuffer(parts["row"].iloc[0], np.int64), int(parts["fold"].iloc[0])
        best = np.zeros((len(row), len(points)), np.int32)
        for kind, own in parts.groupby("kind"):
            total, places = 0, [i for i, p in enumerate(points) if (p["min_samples_leaf"], p["max_features"]) == kinds[kind]]
            for high, votes in sorted(zip(own["trees"], own["votes"], strict=True), key=lambda pair: pair[0]):
                total = total + np.frombuffer(votes, np.int64).reshape(len(cuts), len(row), -1)
                for i in places:
                    if points[i]["n_estimators"] == high:
                        best[:, i] = total[cuts.index(cut_of(points[i]))].argmax(axis=1)
        return pd.DataFrame({"row": row, "fold": f, "predicted": list(best)})

    tasks = blocks.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(len(batches) - 1))))
    votes = tasks.repartition(k * len(batches), "fold", "batch").groupBy("fold", "batch").applyInPandas(
        grow, "fold int, part int, kind int, trees int, row binary, votes binary"
    )
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = materialised(votes, "votes").repartition(4 * cores, "fold", "part").groupBy("fold", "part")
    return materialised(parts.applyInPandas(choose, "row long, fold int, predicted array<int>"), "fold_predictions")
