"""Operator 2: benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are compared as words (runs of letters and digits, lower case). An item occurs in a document if some stretch of
the document is within ``RATIO`` times the item's words of it in edit distance over words.

* Seeds: an occurrence with e edits keeps all but ``q * e`` of the item's q-word runs. Windows with fewer runs of any
  item than that cannot hold an occurrence and are not embedded; this filter loses nothing.
* Embedding: a random walk over the window (Chakraborty, Goldenberg, Koucký 2016) copies its words to a sequence three
  times as long, repeating a word or going on as a random function of step and word says. Few edits become few
  differing places.
* LSH: each of the ``TABLES`` tables of a walk samples ``PLACES`` of the places; a window of the size of an item that
  agrees with the item in a table is a candidate. A window at each place of the stretch is tried, with as many walks as
  lead to ``TARGET`` of random occurrences with the most edits that the item's size allows.
* Verification: exact edit distance between the item and the best stretch around the window.

Items of less than five words allow no edit: they occur as whole word runs. Items without a word match nothing. The
items are split into blocks of a bounded size, and each block is broadcast and tried against all documents. Null, empty
and letterless texts hold nothing; every row is judged on its own, whatever its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import BASES, mixed, powers, windowed_hash

RATIO = 0.2
#: Share of the occurrences with as many edits as are allowed that the walks of an item size must lead to.
TARGET = 0.97
#: Tables of a walk, and places that a table samples.
TABLES, PLACES = 24, 2
#: Characters of item text that are broadcast at once.
BLOCK_CHARS = 8_000_000


class TokenWords:
    """Texts to the hashes of their words, a text at a time."""

    def __init__(self):
        self.is_word = np.frompyfunc(lambda c: chr(c).isalnum(), 1, 1)(np.arange(0x110000)).astype(bool)
        self.powers = powers(BASES[1], 64)

    def of(self, text: str) -> np.ndarray:
        lower = text.lower()
        if lower.isascii():
            codes = np.frombuffer(lower.encode(), np.uint8)
        else:
            codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
        places = np.flatnonzero(self.is_word[codes])
        if not len(places):
            return np.zeros(0, np.uint64)
        first = np.flatnonzero(np.append(True, places[1:] != places[:-1] + 1))
        length = np.diff(np.append(first, len(places)))
        if length.max() > len(self.powers):
            self.powers = powers(BASES[1], 2 * int(length.max()))
        within = np.arange(len(places)) - np.repeat(first, length)
        codes = codes[places].astype(np.uint64) + np.uint64(1)
        return mixed(np.add.reduceat(codes * self.powers[within], first))


def seed_width(m: int) -> int:
    """The longest run of up to three words that ``RATIO * m`` edits must leave somewhere in ``m`` words."""
    edits = int(RATIO * m)
    return max(1, min(3, -(-(m - edits) // (edits + 1))))


def cgk(windows: np.ndarray, seed: int = 1) -> np.ndarray:
    """The embedding of each row of ``windows`` (n x m words): n x 3m words, zero beyond the window's end."""
    n, m = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.zeros((n, 3 * m), np.uint64)
    for j in range(3 * m):
        word = padded[rows, at]
        out[:, j] = word
        step = mixed(word + np.uint64((seed * 0x9E3779B97F4A7C15 + j * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)))
        at = np.minimum(at + (step & np.uint64(1)).astype(np.int64), m)
    return out


def sampled_keys(windows: np.ndarray, walk: int) -> np.ndarray:
    """n x ``TABLES`` keys of one random walk over the windows; each hashes the words at the places that its table
    samples, from the first two thirds of the embedding: a walk runs out of words later on."""
    embedded, m = cgk(windows, walk), windows.shape[1]
    chosen = np.random.default_rng([walk, m]).integers(0, 2 * m, (TABLES, PLACES))
    keys = np.zeros((len(windows), TABLES), np.uint64)
    for p in range(PLACES):
        keys = mixed(keys * np.uint64(3) + embedded[:, chosen[:, p]] + np.arange(TABLES, dtype=np.uint64))
    return keys


@lru_cache(maxsize=4096)
def walks_for(m: int, target: float = TARGET, trials: int = 64) -> int:
    """How many walks items of ``m`` words need, by trial: random items with ``RATIO * m`` random edits, tried from the
    window where the edited text begins and two on either side. Windows further off only add to what is found."""
    edits = int(RATIO * m)
    if not edits:
        return 1
    rng = np.random.default_rng([m, 3])
    items = rng.integers(1, 1 << 62, (trials, m)).astype(np.uint64)
    texts = rng.integers(1, 1 << 62, (trials, 2 * m + 4)).astype(np.uint64)
    for i in range(trials):
        own = items[i].tolist()
        for _ in range(edits):
            at, fresh = int(rng.integers(0, len(own))), int(rng.integers(1, 1 << 62))
            own[at : at + 1] = ([], [fresh], [fresh, own[at]])[rng.integers(0, 3)]
        texts[i, 2 : 2 + len(own)] = own
    found, walk = np.zeros(trials, bool), 0
    while found.mean() < target:
        walk += 1
        keys = sampled_keys(items, walk)
        for at in range(5):
            found |= (sampled_keys(texts[:, at : at + m], walk) == keys).any(axis=1)
    return walk


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Edit distance of ``item`` to the nearest stretch of ``text``, and the stretch [begin, end)."""
    n = len(text)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, word in enumerate(item.tolist()):
        new, start = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], start[0] = i + 1, 0
        take = row[:-1] + (text != np.uint64(word))
        drop = row[1:] + 1
        new[1:] = np.minimum(take, drop)
        start[1:] = np.where(take <= drop, begin[:-1], begin[1:])
        # A text word left out: the best to the left plus the distance, as a running minimum.
        shifted = new - np.arange(n + 1)
        lowest = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == lowest, np.arange(n + 1), 0))
        better = lowest < shifted
        start = np.where(better, start[source], start)
        row, begin = lowest + np.arange(n + 1), start
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


class ItemIndex:
    """Seeds and LSH tables of one block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        words = TokenWords()
        self.items = [(i, ids) for i, t in items if len(ids := words.of(t or ""))]
        self.sizes = sorted({len(ids) for _, ids in self.items})
        self.reach = np.array([len(ids) + int(RATIO * len(ids)) for _, ids in self.items], np.int64)
        self.seeds = {}
        for q in (1, 2, 3):
            own = [(k, np.unique(windowed_hash(ids, q))) for k, (_, ids) in enumerate(self.items) if seed_width(len(ids)) == q]
            if own:
                grams = np.concatenate([g for _, g in own])
                holders = np.concatenate([np.full(len(g), k) for k, g in own])
                order = np.argsort(grams, kind="stable")
                marks = np.zeros(1 << 22, bool)
                marks[(grams >> np.uint64(42)).astype(np.int64)] = True
                self.seeds[q] = grams[order], holders[order], marks
        self.needed = np.array([self.least_seeds(len(ids)) for _, ids in self.items], np.int64)
        #: Of each item size, for every table its sorted keys and the items that have them.
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for m in self.sizes:
            same = np.array([k for k, (_, ids) in enumerate(self.items) if len(ids) == m])
            own, self.tables[m] = np.stack([self.items[k][1] for k in same]), []
            # Sizes are rounded up for the trial only.
            for walk in range(1, walks_for(m if m < 32 else -(-m // 32) * 32) + 1):
                keys = sampled_keys(own, walk)
                order = np.argsort(keys, axis=0, kind="stable")
                self.tables[m] += [(keys[order[:, t], t], same[order[:, t]]) for t in range(TABLES)]

    @staticmethod
    def least_seeds(m: int) -> int:
        """Places of a text with one of the item's runs that an occurrence must have; the item may repeat runs."""
        q, edits = seed_width(m), int(RATIO * m)
        return max(1, m - q + 1 - q * edits)

    def starts(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """For each item size the windows where some item of this size has enough seeds."""
        out: dict[int, list[np.ndarray]] = {}
        for q, (grams, holders, marks) in self.seeds.items():
            here = windowed_hash(ids, q)
            at = np.flatnonzero(marks[(here >> np.uint64(42)).astype(np.int64)])
            if not len(at):
                continue
            low, high = np.searchsorted(grams, here[at]), np.searchsorted(grams, here[at], "right")
            n = high - low
            if not n.any():
                continue
            place = np.repeat(at, n)
            item = holders[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            order = np.lexsort((place, item))
            place, item = place[order], item[order]
            last = np.arange(len(item)) + self.needed[item] - 1
            inside = last < len(item)
            last = np.minimum(last, len(item) - 1)
            enough = inside & (item[last] == item) & (place[last] - place <= self.reach[item] - q)
            for k in np.flatnonzero(enough).tolist():
                m, reach = len(self.items[item[k]][1]), int(self.reach[item[k]])
                out.setdefault(m, []).append(np.arange(max(0, int(place[last[k]]) - reach + q), int(place[k]) + 1))
        return {m: np.unique(np.concatenate(own)) for m, own in out.items()}

    def occurrences(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, distance) of the nearest stretch of each item that occurs."""
        best: dict[int, tuple[int, int, int]] = {}
        for m, begins in self.starts(ids).items():
            edits = int(RATIO * m)
            padded = np.concatenate([ids, np.zeros(m, np.uint64)])
            candidates: dict[int, set[int]] = {}
            tables = self.tables[m]
            for part in range(0, len(begins), 2048):
                some = begins[part : part + 2048]
                windows = padded[some[:, None] + np.arange(m)]
                for t, (known, holders) in enumerate(tables):
                    if t % TABLES == 0:
                        keys = sampled_keys(windows, t // TABLES + 1)
                    own = keys[:, t % TABLES]
                    low, high = np.searchsorted(known, own), np.searchsorted(known, own, "right")
                    for w in np.flatnonzero(high > low).tolist():
                        for k in holders[low[w] : high[w]].tolist():
                            candidates.setdefault(k, set()).add(int(some[w]))
            for k, places in candidates.items():
                (name, item), at = self.items[k], np.array(sorted(places))
                # Windows that overlap are verified together.
                for run in np.split(at, np.flatnonzero(np.diff(at) > m) + 1):
                    if name in best and best[name][2] == 0:
                        break
                    low = max(0, int(run[0]) - edits)
                    distance, begin, end = best_stretch(item, ids[low : int(run[-1]) + m + edits])
                    if distance <= edits and (name not in best or distance < best[name][2]):
                        best[name] = low + begin, low + end, distance
        return sorted((i, *x) for i, x in best.items())


HITS = "array<struct<item_id:bigint,begin:int,end:int,distance:int>>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    name: str = "hits", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with the column ``name``: the items that occur, as (item_id, begin, end, distance), word places."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()).select(
        F.col(item).cast("long").alias("item"), F.col(item_text).alias("content")
    )
    size = items.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)), F.count("*")).first()
    blocks = max(1, -(-size[0] // block_chars))
    kept = [c for c in docs.columns if c != name]
    # The columns travel as one, so their names don't matter.
    out = docs.select(
        F.col(f"`{text}`").alias("_content"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_all"),
        F.array().cast(HITS).alias("_hits"),
    )
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(ItemIndex([(r.item, r.content) for r in own.orderBy("item", "content").collect()]))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, words = shared.value, TokenWords()
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))
            for batch in batches:
                found = []
                for content, before in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    hits = index.occurrences(words.of(content)) if content and index.items else []
                    found.append((before or []) + [dict(zip(("item_id", "begin", "end", "distance"), h, strict=True)) for h in hits])
                columns = [batch.column(0), batch.column(1), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["_content", "_all", "_hits"])

        out = out.mapInArrow(search, out.schema)
    return out.select(*[F.col("_all")[c].alias(c) for c in kept], F.col("_hits").alias(name))
