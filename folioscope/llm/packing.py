"""Operator 8: documents as token pieces, packed into few sequences by a swap-based local search.

``token_pieces`` turns every document into its token ids and cuts only those longer than a sequence. ``pack`` deals the
pieces by hash into groups of a bounded size (their number grows with the input) and packs each group on its own: a
first placement, best fit of the longest first, then a local search between the bins that are not full. The search
moves a piece, exchanges one for one, or two for one, whenever that raises the sum of squared fills; this drains the
emptier bins into the fuller ones until they are empty. A group loses less than one bin against its own optimum in
practice, so the loss is a fixed small share however large the input is.

Rows: a null text is empty, an empty text is the end token alone. Rows alike in every column are packed one by one.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import materialised, row_groups

CAPACITY = 4096
END = 1
#: Pieces of one group: a few thousand sequences, packed within seconds and a few megabytes.
GROUP_PIECES = 16_384
#: Words whose tokens a worker remembers.
REMEMBERED = 600_000


class WordTokens(dict):
    """word -> its token ids as little-endian bytes.

    The tokenizer drops white space and works on the words between it one by one, so a text is the concatenation of
    its words. Within a word, runs of letters are tokenised once for all words that hold them. The first words met
    are remembered; the frequent ones are met early.
    """

    def __init__(self, path: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.as_chars = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.simple = regex.compile(r"(\p{Ll}*\p{L}?\p{Ll}+)([.,]?)")
        self.runs: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        match = self.simple.fullmatch(word) if word.isascii() or word.isalpha() else None
        if match is None:
            ids = self.encoded(word)
        else:
            ids = self.run(match[1].lower()) + (self.run(match[2]) if match[2] else b"")
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids

    def run(self, letters: str) -> bytes:
        ids = self.runs.get(letters)
        if ids is None:
            if letters.isascii():
                ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
            else:
                ids = self.encoded(letters)
            if len(self.runs) < REMEMBERED:
                self.runs[letters] = ids
        return ids

    def encoded(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per Python worker, kept from task to task."""
    if path not in _TOKENS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENS.clear()
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """``key, piece, start, length, ids``: ids are little-endian 32-bit numbers, ``end`` closes each document."""
    closing = np.array([end], "<u4").tobytes()
    schema = pa.schema([
        ("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                columns: list[list] = [[], [], [], [], []]
                some = batch.slice(part, 512)
                for doc, content in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = tokens.text(content or "") + closing
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for column, value in zip(columns, (doc, piece, at // 4, len(own) // 4, own), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("content"))
    pieces = rows.mapInArrow(cut, "doc long, piece int, start long, length long, ids binary")
    return pieces.withColumnRenamed("doc", key)


class Bins:
    """The bins of one group: best fit first, then exchanges between those that are not full."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.best_fit(np.argsort(-lengths, kind="stable"))

    def best_fit(self, order: np.ndarray) -> None:
        """Each piece goes to the fullest bin that has room. ``by_room`` holds the open bins by their room."""
        by_room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        rooms: list[int] = []
        for i in order.tolist():
            n = int(self.lengths[i])
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                b, room = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            else:
                room = rooms[at]
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            self.items[b].append(i)
            self.fill[b] += n
            room -= n
            if room:
                if not by_room[room]:
                    bisect.insort(rooms, room)
                by_room[room].append(b)

    def search(self, passes: int = 8) -> None:
        """Drain the emptier bins into the fuller ones while a pass changes anything.

        A pass takes the underfull bins by fill. For each, from the fullest on, an emptier bin is looked for that
        holds a piece to move into its room, a larger piece to take for one of its own, or two pieces to take for one
        of its own. Each step makes the fuller bin fuller at the cost of the emptier one, so squared fill rises and
        the search ends.
        """
        for _ in range(passes):
            changed = False
            open_ = sorted((b for b in range(len(self.items)) if 0 < self.fill[b] < self.capacity),
                           key=lambda b: self.fill[b])
            if len(open_) < 2:
                return
            # The pieces of the emptiest bins, by length: what can be moved into the fuller ones.
            donors = open_[: max(1, min(len(open_) // 2, 64))]
            stock = sorted((int(self.lengths[i]), i, b) for b in donors for i in self.items[b])
            for b in reversed(open_[len(donors):] if len(open_) > len(donors) else open_[1:]):
                changed |= self.improve(b, stock)
            # The emptiest bins among themselves.
            for x in range(len(donors) - 1, 0, -1):
                for y in range(x):
                    changed |= self.between(donors[x], donors[y])
            if not changed:
                return

    def improve(self, b: int, stock: list[tuple[int, int, int]]) -> bool:
        """Make bin ``b`` as full as one move or exchange with the stock allows; repeats while it gains."""
        gained = False
        while self.fill[b] < self.capacity and stock:
            room = self.capacity - self.fill[b]
            best, plan = 0, None
            at = bisect.bisect_right(stock, (room, 1 << 60, 0)) - 1
            if at >= 0 and stock[at][0] > best:
                best, plan = stock[at][0], (None, at, None)
            for own in self.items[b]:
                n = int(self.lengths[own])
                at = bisect.bisect_right(stock, (n + room, 1 << 60, 0)) - 1
                if at >= 0 and stock[at][0] - n > best and stock[at][2] != b:
                    best, plan = stock[at][0] - n, (own, at, None)
                if best < room and at >= 0:  # two for one: the longest that leaves a partner
                    for first in range(at, max(-1, at - 24), -1):
                        second = bisect.bisect_right(stock, (n + room - stock[first][0], 1 << 60, 0)) - 1
                        second = min(second, first - 1)
                        if second >= 0 and stock[second][2] == stock[first][2]:
                            gain = stock[first][0] + stock[second][0] - n
                            if best < gain <= room:
                                best, plan = gain, (own, first, second)
            if plan is None:
                return gained
            self.apply(b, plan, stock)
            gained = True
        return gained

    def apply(self, b: int, plan: tuple, stock: list[tuple[int, int, int]]) -> None:
        own, first, second = plan
        taken = [stock.pop(at) for at in sorted({first, second} - {None}, reverse=True)]
        for n, i, donor in taken:
            self.items[donor].remove(i)
            self.fill[donor] -= n
            self.items[b].append(i)
            self.fill[b] += n
        if own is not None:
            n, donor = int(self.lengths[own]), taken[0][2]
            self.items[b].remove(own)
            self.fill[b] -= n
            self.items[donor].append(own)
            self.fill[donor] += n
            bisect.insort(stock, (n, own, donor))

    def between(self, full: int, empty: int) -> bool:
        """Moves and one-for-one exchanges from the emptier to the fuller of two bins."""
        if self.fill[full] < self.fill[empty]:
            full, empty = empty, full
        if not self.fill[empty] or self.fill[full] == self.capacity:
            return False
        stock = sorted((int(self.lengths[i]), i, empty) for i in self.items[empty])
        return self.improve(full, stock)


def pack(
    pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
    spread_by: tuple[str, ...] = (),
) -> DataFrame:
    """``pieces`` (a table that can be read again) with ``sequence_id`` and ``offset``.

    Lengths must be 1 to ``capacity``. ``spread_by`` names the columns that deal pieces to groups, by default all.
    """
    total = pieces.count()
    groups = max(1, -(-total // group_pieces))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_group", "_length")]
    by = F.pmod(F.xxhash64(*(spread_by or kept)), F.lit(groups)).cast("int")
    dealt = pieces.select(by.alias("_group"), F.col(length).cast("long").alias("_length"), *kept)
    fields = dealt.select(*kept).schema

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in row_groups(batches, 1):
            lengths = table.column(1).to_numpy()
            bins = Bins(lengths, capacity)
            bins.search()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            first = int(table.column(0)[0].as_py()) << 32
            for b, items in enumerate(x for x in bins.items if x):
                at = 0
                for i in items:
                    sequence[i], offset[i] = first + b, at
                    at += int(lengths[i])
            out = table.select(kept).append_column("sequence_id", pa.array(sequence))
            yield from out.append_column("offset", pa.array(offset)).to_batches()

    order = dealt.repartition(groups, "_group") if groups > 1 else dealt.coalesce(1)
    schema = fields.add("sequence_id", "long").add("offset", "long")
    return order.sortWithinPartitions("_group", *kept).mapInArrow(fit, schema)


def packed_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset``.

    The ids are digested as they come out of ``token_pieces``, so only numbers are kept and dealt out.
    """
    pieces = token_pieces(docs, tokenizer_path, key, text).select(
        key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return pack(materialised(pieces, "packing_pieces"))
