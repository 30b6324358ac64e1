"""Operator 11: two tokenizers' tokens of a text, aligned by diagonal run skipping.

Tokenizer A is a byte-level BPE (a ``tokenizers`` file), B a sentencepiece model with byte fallback. Both spell the
same bytes, space + text, so a token is known by the byte where it ends. ``aligned`` walks the two arrays of ends along
a diagonal: while token ``i`` of A ends where token ``i + shift`` of B ends, it compares slices of the arrays that
double in length, and jumps over the whole one-to-one stretch at once. Where a comparison fails, the irregular group
is resolved token by token, and the walk goes on with the shift that it leaves.

Spark work: one pass tokenises, aligns and writes each document's digests and its links (a packed array of id pairs);
the next adds the links up inside tasks before the counts of a pair are shuffled; the last looks the counts up again.
The table of counts has at most |A| x |B| rows; up to ``max_pairs`` it is broadcast as two sorted arrays, beyond that
the links meet it by a shuffle join, which gives the same rows.

Rows: every row keeps its line. Texts that are null or empty, or which one tokenizer does not spell byte by byte (a
literal U+2581 becomes a space), have no tokens: zeros and an empty digest. Rows alike are counted each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import materialised
from folioscope.session import scratch_path

#: Pairs that are broadcast (12 bytes each); a larger table of counts is joined by shuffle.
MAX_PAIRS = 4_000_000
#: Links that a task adds up at a time.
LINK_BATCH = 1 << 22
#: Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies of this family.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself, or else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteTokens:
    """Tokenizer A. Byte-level BPE is decided by its vocabulary order alone, so the ranks are read from the file.

    The fast encoder's pattern engine overflows its stack on endless blanks; such texts go to the file's own tokenizer.
    """

    def __init__(self, path: str):
        import json
        import re

        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.endless = re.compile(r"\s{10000}")
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        own = byte_characters()
        ranks = {
            bytes(map(own.__getitem__, entry)): i for entry, i in vocabulary.items() if all(c in own for c in entry)
        }
        # Special entries come last and can't be the product of a merge of ordinary text.
        special = max(vocabulary.values()) + 1
        ranks = {b: i for b, i in ranks.items() if not (b.startswith(b"<|") and b.endswith(b"|>"))}
        self.model = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.size = special
        self.bytes = [b""] * special
        for b, i in ranks.items():
            self.bytes[i] = b

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [self.one(" " + text) for text in texts]

    def one(self, text: str) -> list[int]:
        if len(text) >= 10000 and self.endless.search(text):
            return self.own.encode(text, add_special_tokens=False).ids
        return self.model.encode_ordinary(text)


class PieceTokens:
    """Tokenizer B. It puts the space before the text itself."""

    def __init__(self, path: str):
        import re

        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        single = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            byte = single.fullmatch(piece) if self.model.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_LOADED: dict[tuple[str, str], tuple[ByteTokens, PieceTokens]] = {}


def tokenizers(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens]:
    """One pair per Python worker, kept from task to task."""
    if (path_a, path_b) not in _LOADED:
        _LOADED.clear()
        _LOADED[path_a, path_b] = ByteTokens(path_a), PieceTokens(path_b)
    return _LOADED[path_a, path_b]


def aligned(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """The last token of A and of B in each group, for two rising arrays with the same last end.

    ``i`` and ``j`` are the first tokens not yet in a group; ``j - i`` is the shift.
    """
    last_a: list[int] = []
    last_b: list[int] = []
    i = j = 0
    n, m = len(ends_a), len(ends_b)
    while i < n:
        if ends_a[i] == ends_b[j]:
            # One to one at this shift: compare 1, 2, 4 … tokens, then halve back to where the stretch breaks off.
            run, width, most = 1, 2, min(n - i, m - j)
            growing = True
            while width and run < most:
                if ends_a[i + run : i + run + width] == ends_b[j + run : j + run + width]:
                    run = min(run + width, most)
                    width = width * 2 if growing else width // 2
                else:
                    growing = False
                    width //= 2
            if run == 1:
                last_a.append(i)
                last_b.append(j)
            else:
                last_a.extend(range(i, i + run))
                last_b.extend(range(j, j + run))
            i += run
            j += run
            continue
        a, b = ends_a[i], ends_b[j]
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
        last_a.append(i)
        last_b.append(j)
        i += 1
        j += 1
    return last_a, last_b


def packing(size_a: int, size_b: int) -> str:
    """The type of a packed link."""
    return "<u4" if size_a * size_b <= 1 << 32 else "<i8"


class Aligner:
    """Texts to digests and links."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokenizers(path_a, path_b)
        self.lengths_a = np.array([len(b) for b in self.a.bytes], np.int64)
        self.lengths_b = np.array([len(b) for b in self.b.bytes], np.int64)
        self.packed = packing(self.a.size, self.b.size)
        # Every id with each of the marks that can follow it: more of its side, the other side, the next group.
        self.spelt = [f"{i}{mark}" for mark in (",", "|") for i in range(self.a.size)]
        self.spelt += [f"{i}{mark}" for mark in (",", ";", "") for i in range(self.b.size)]

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """``n_a, n_b, n_groups, groups_sha256, links`` of each text; a link is ``a * |B| + b``."""
        told = [text for text in texts if text]
        ids = iter(zip(self.a.ids(told), self.b.ids(told), strict=True))
        for text in texts:
            yield self.row(text, *next(ids)) if text else (0, 0, 0, "", b"")

    def row(self, text: str, own_a: list[int], own_b: list[int]) -> tuple:
        content = b" " + text.encode()
        # A spells any text, so its length is enough of a check.
        if b"".join(map(self.b.bytes.__getitem__, own_b)) != content:
            return 0, 0, 0, "", b""
        a, b = np.array(own_a, np.int64), np.array(own_b, np.int64)
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        if ends_a[-1] != len(content):
            return 0, 0, 0, "", b""
        last_a, last_b = (np.array(x, np.int64) for x in aligned(ends_a.tolist(), ends_b.tolist()))
        links = (a[last_a] * self.b.size + b[last_b]).astype(self.packed).tobytes()
        return len(a), len(b), len(last_a), self.digest(a, b, last_a, last_b), links

    def digest(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """Ids in group order, A before B; the code of an id with its mark indexes ``spelt``."""
        na, nb = self.a.size, self.b.size
        code_a, code_b = a.copy(), b + 2 * na
        code_a[last_a] += na
        code_b[last_b] += nb
        code_b[-1] += nb
        # A token of A stands behind the tokens of B in the groups before its own, and the other way round.
        groups = np.arange(len(last_a))
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        group_a, group_b = np.repeat(groups, size_a), np.repeat(groups, size_b)
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + (last_b - size_b + 1)[group_a]] = code_a
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = code_b
        return hashlib.sha256("".join(map(self.spelt.__getitem__, out.tolist())).encode()).hexdigest()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_a, n_b, n_groups, groups_sha256, links`` per row; ``links`` are packed ``a * |B| + b``."""
    schema = pa.schema([
        ("doc", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("groups_sha256", pa.string()), ("links", pa.binary()),
    ])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(path_a, path_b)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                columns = list(zip(*tool.rows(some.column(1).to_pylist()), strict=True))
                arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), *arrays], schema=schema)

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("content"))
    found = rows.mapInArrow(align, "doc long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")
    return found.withColumnRenamed("doc", key)


def flat(column: pa.Array, packed: str) -> np.ndarray:
    """The numbers of a binary column one after the other."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), packed)


def link_counts(found: DataFrame, size_b: int, packed: str) -> DataFrame:
    """``code, n, best``: how often each linked pair occurs, and whether no pair with the same B id occurs more often."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                waiting.append(flat(batch.column(0).slice(at, 512), packed))
                n += len(waiting[-1])
                if n >= LINK_BATCH:
                    codes, counts = np.unique(np.concatenate(waiting), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])
                    waiting, n = [], 0
        if n:
            codes, counts = np.unique(np.concatenate(waiting), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])

    counts = found.select("links").mapInArrow(add_up, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # A B id is paired with at most |A| ids.
    same_b = Window.partitionBy(F.col("code") % size_b)
    return counts.withColumn("best", F.col("n") == F.max("n").over(same_b))


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", max_pairs: int = MAX_PAIRS,
) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs``."""
    a, b = tokenizers(path_a, path_b)
    packed = packing(a.size, b.size)
    found = densely_written(alignments(docs, path_a, path_b, key, text))
    counts = materialised(link_counts(found, b.size, packed), "link_counts")
    looked_up = counted_in_rows if counts.count() <= max_pairs else counted_by_join
    return looked_up(found, counts, packed).select(
        key, "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )


def densely_written(found: DataFrame) -> DataFrame:
    """A table in the shared folder. Links are most of it, and they are dense numbers: they pay for a better codec."""
    path = scratch_path(found.sparkSession, "token_links")
    found.write.option("compression", "zstd").parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def counted_in_rows(found: DataFrame, counts: DataFrame, packed: str) -> DataFrame:
    """``found`` with ``n_best, count_sum``, from the table of counts as sorted arrays in every worker."""
    table = counts.toArrow().sort_by("code")
    codes, n = table.column("code").to_numpy().astype(packed), table.column("n").to_numpy()
    # The sign tells the best pairs.
    signed = np.where(table.column("best").to_numpy(), n, -n)
    shared = found.sparkSession.sparkContext.broadcast((codes, signed))
    names = [c for c in found.columns if c != "links"]
    schema = found.select(*[f"`{c}`" for c in names]).schema

    width = np.dtype(packed).itemsize

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, signed = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                links = some.column(some.num_columns - 1)
                values = signed[np.searchsorted(codes, flat(links, packed))]
                edges = np.zeros(some.num_rows + 1, np.int64)
                np.cumsum([len(x or b"") // width for x in links.to_pylist()], out=edges[1:])
                sums = []
                for value in (values > 0, np.abs(values)):
                    total = np.zeros(len(value) + 1, np.int64)
                    np.cumsum(value, out=total[1:])
                    sums.append(pa.array(total[edges[1:]] - total[edges[:-1]]))
                columns = [some.column(i) for i in range(some.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, *sums], names=[*names, "n_best", "count_sum"])

    return found.select(*[f"`{c}`" for c in names], "links").mapInArrow(
        look_up, schema.add("n_best", "long").add("count_sum", "long")
    )


def counted_by_join(found: DataFrame, counts: DataFrame, packed: str) -> DataFrame:
    """The same by a shuffle join of each row's distinct links; hot pairs are split by the adaptive skew join."""
    rows = materialised(found.withColumn("_row", F.monotonically_increasing_id()), "token_rows")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, times = np.unique(np.frombuffer(links or b"", packed).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), row)), pa.array(codes), pa.array(times)], names=["_row", "code", "times"]
                )

    links = rows.select("_row", "links").mapInArrow(distinct, "_row long, code long, times long")
    sums = links.join(counts, "code").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    zero = F.lit(0).cast("long")
    return rows.drop("links").join(sums, "_row", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}
    ).drop("_row")
