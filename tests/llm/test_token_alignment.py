import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioscope.llm.token_alignment import align_tokenizers, aligned, byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NEW = {"n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
TEXTS = [
    "the cat sat on the mat", "the cat sat on the mat", None, "", " ", "  two  blanks  ", "tab\tand\nline\r\n\r\n end \n",
    "it's we'LL 日本語 \U0001f600 é́ ١٢ naïve", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "a" * 3000, " " * 700 + "x",
    "Ützkeit Einungkeitzu einentz enzuchheitgebe. " * 400, "\x00\x01 b", "ﬁ ① Å   　 x",
]


def groups(ends_a, ends_b):
    """Last tokens of each group, from the common ends."""
    common = sorted(set(ends_a) & set(ends_b))
    return [ends_a.index(e) for e in common], [ends_b.index(e) for e in common]


def test_the_walk_equals_the_common_ends():
    rng = random.Random(5)
    for size in (1, 2, 3, 10, 60, 300):
        for share in (0.02, 0.3, 0.9):
            last = size * 3
            ends_a = sorted({*rng.sample(range(1, last), size - 1), last}) if size > 1 else [last]
            ends_b = sorted({e for e in ends_a if rng.random() > share} | {last}
                            | set(rng.sample(range(1, last), int(size * share))))
            assert aligned(ends_a, ends_b) == groups(ends_a, ends_b)
    same = list(range(1, 1000))
    assert aligned(same, same) == (list(range(999)), list(range(999)))


def brute_force(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    own = byte_characters()
    found, links, times = [], [], Counter()
    for text in texts:
        row, pairs = ("", 0, 0, 0), []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(own[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = []
            for i in ids_b:
                piece = b.id_to_piece(i)
                byte = b.is_byte(i)
                bytes_b.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode())
            if b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode():
                ends_a, ends_b = (list(accumulate(map(len, x))) for x in (bytes_a, bytes_b))
                place_a, place_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
                told, i, j = [], 0, 0
                for end in (e for e in ends_a if e in place_b):
                    p, q = place_a[end], place_b[end]
                    told.append(",".join(map(str, ids_a[i : p + 1])) + "|" + ",".join(map(str, ids_b[j : q + 1])))
                    pairs.append((ids_a[p], ids_b[q]))
                    i, j = p + 1, q + 1
                row = (hashlib.sha256(";".join(told).encode()).hexdigest(), len(ids_a), len(ids_b), len(told))
        found.append(row)
        links.append(pairs)
        times.update(pairs)
    most = Counter()
    for (_, y), n in times.items():
        most[y] = max(most[y], n)
    return [
        (i, *row[1:], len(pairs), sum(times[p] == most[p[1]] for p in pairs), sum(times[p] for p in pairs), row[0])
        for i, (row, pairs) in enumerate(zip(found, links, strict=True))
    ]


@pytest.mark.parametrize("max_pairs", [1_000_000, 0])
def test_equals_brute_force(spark, max_pairs):
    rows = [(i, t, "x", 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string, n_a int").repartition(3)
    found = align_tokenizers(docs, A, B, max_pairs=max_pairs)
    assert set(found.columns) == NEW | {"doc_id"}
    order = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.select(order).collect())) == brute_force(TEXTS)
    zeros = {r.doc_id for r in found.collect() if r.n_a == 0}
    assert {2, 3, 8} <= zeros and all(r.groups_sha256 == "" for r in found.collect() if r.doc_id in zeros)


@pytest.mark.parametrize("max_pairs", [1_000_000, 0])
def test_null_and_repeated_ids_and_no_rows(spark, max_pairs):
    schema = "doc_id long, text string, `a.b` int"
    rows = [(None, "one two", 1), (7, "one two", 1), (7, "one two", 1), (7, "three", 2), (8, None, None)]
    found = align_tokenizers(spark.createDataFrame(rows, schema), A, B, max_pairs=max_pairs).collect()
    expected = brute_force([t for _, t, _ in rows])
    assert Counter((r.doc_id, r.n_best, r.count_sum) for r in found) == Counter(
        (row[0], e[5], e[6]) for row, e in zip(rows, expected, strict=True))
    assert align_tokenizers(spark.createDataFrame([], schema), A, B, max_pairs=max_pairs).collect() == []
