import numpy as np
import pytest

from folioscope.llm.catalog import tokenizer_file
from folioscope.llm.packing import Bins, pack, packed_documents, token_pieces

TEXTS = [
    "Hello world, it's 3 o'clock!", "", None, "ÉTÉ œuvre straße ǅ ŒUVRE naïve", "a\tb\x0bc\x1cd e f", "ﬁ Å é",
    "İstanbul ΣΑΣ", "don't STOP 1234 $$$ *** co-op", "<|endoftext|> x", "日本語 텍스트 😀👍", "word " * 9000, "\n\n  \n",
    "Ab aB AB abc, abc. Abc", "ǅungla ªº ʰ",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    return t


def test_pieces_equal_the_tokenizer(spark, tokenizer):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {(r.doc_id, r.piece): r for r in token_pieces(docs, tokenizer_file()).collect()}
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            row = found.pop((i, piece))
            assert (row.start, row.length) == (at, len(ids[at : at + 4096]))
            assert np.frombuffer(row.ids, "<u4").tolist() == ids[at : at + 4096]
    assert not found


def test_packing_is_gapless_and_tight(spark):
    lengths = np.random.default_rng(5).integers(1, 3000, 4000).tolist() + [4096, 4096, 1]
    rows = [(i, n, "x") for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "k long, length long, offset string")
    found = pack(pieces, group_pieces=1500).collect()
    assert sorted(r.k for r in found) == list(range(len(lengths)))
    bins = {}
    for r in found:
        assert r.length == lengths[r.k]
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(lengths) // 4096) * 1.01 + 3


def test_search_empties_a_bin():
    bins = Bins(np.array([6, 4, 5, 5, 3, 3]), 10)
    bins.items, bins.fill = [[0, 4], [1, 2], [3, 5]], [9, 9, 8]
    bins.search()
    assert sorted(i for b in bins.items for i in b) == list(range(6))
    assert all(sum(int(bins.lengths[i]) for i in b) == f <= 10 for b, f in zip(bins.items, bins.fill))
    assert sum(f * f for f in bins.fill) > 81 + 81 + 64


def test_nulls_repeated_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(None, None), (3, "a b"), (3, "a b"), (4, "")], "doc_id long, text string")
    found = packed_documents(docs, tokenizer_file()).collect()
    assert sorted(r.length for r in found) == [1, 1, 3, 3]
    assert len({(r.sequence_id, r.offset) for r in found}) == 4
    assert packed_documents(docs.limit(0), tokenizer_file()).collect() == []
