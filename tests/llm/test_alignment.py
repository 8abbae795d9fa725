import bisect
import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parlance.llm import alignment
from parlance.llm.alignment import Linker, align, byte_level_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", None, " ", "  two  spaces ", "plain words here", "plain words here", "tab\tand\nline", "<|endoftext|> <s> </s> <unk> <0x0A>", "a▁b", "▁", "naïve çafé 😀 日本語 ﬁ", "don't stop, it's",
    "a" * 3000, "word " * 400, "\x00 nul", " no break", "é́", "x   y", "﻿mark",
]


def brute(rows):
    """Plain loops: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)."""
    lib = Tokenizer.from_file(A)
    lib.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    entries = byte_level_bytes([lib.id_to_token(i) for i in range(lib.get_vocab_size())])
    spelled = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    counts, held = Counter(), []
    for doc_id, text in rows:
        ids = [], []
        if text:
            ids = lib.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
            if any(b"".join(x) != (" " + text).encode() for x in ([entries[i] for i in ids[0]], [spelled(i) for i in ids[1]])):
                ids = [], []
        placed = []
        for side, size in zip(ids, (lambda i: len(entries[i]), lambda i: len(spelled(i))), strict=True):
            at, own = 0, []
            for i in side:
                own.append((i, at, at + size(i)))
                at += size(i)
            placed.append(own)
        links, k = Counter(), 0
        for a, start, end in placed[0]:
            while placed[1][k][2] <= start:
                k += 1
            j = k
            while j < len(placed[1]) and placed[1][j][1] < end:
                links[a, placed[1][j][0]] += 1
                j += 1
        ends = sorted({e for *_, e in placed[0]} & {e for *_, e in placed[1]})
        groups = [([], []) for _ in ends]
        for side, own in enumerate(placed):
            for i, _, e in own:
                groups[bisect.bisect_left(ends, e)][side].append(str(i))
        counts.update(links.keys())
        held.append((doc_id, ids, groups, links))
    top = {}
    for (a, _), n in counts.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for doc_id, ids, groups, links in held:
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        best = sum(m for p, m in links.items() if counts[p] == top[p[0]])
        out.append((doc_id, len(ids[0]), len(ids[1]), len(groups), sum(links.values()), best, sum(m * counts[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if ids[0] else ""))
    return out


def same(got, want):
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_edges_equal_plain_loops(spark):
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, slice int")
    same(align(docs, A, B).collect(), brute(rows))


def test_query_equals_plain_loops(spark, sf_dir):
    from parlance.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    same(QUERIES["op13_token_alignment"](spark, sf_dir).collect(), brute(rows))


@pytest.mark.parametrize("limits", [{"GROUP_BYTES": 400}, {"MEMO_WORDS": 40}, {"JOIN_WORDS": 7}])
def test_limits_change_no_result(spark, sf_dir, limits, monkeypatch):
    """Spread of an id's postings over ranges of slices; memos that start again; long texts digested in parts."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()] + TEXTS
    want = brute(list(enumerate(texts)))
    for name, value in limits.items():
        monkeypatch.setattr(alignment, name, value)
    if "GROUP_BYTES" in limits:
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        return same(align(docs, A, B).collect(), want)
    link = Linker(A, B)
    for k in range(0, len(texts), 9):
        sums, digests, *_ = link.texts(pa.array([t or "" for t in texts[k : k + 9]]))
        for row, (n, digest) in enumerate(zip(sums.tolist(), digests, strict=True)):
            assert (*n, digest) == (*want[k + row][1:5], want[k + row][7])


def test_packed_integers():
    for top in (0, 255, 256, 1 << 16, 1 << 32):
        values = np.array([0, 1, top])
        assert (alignment._unpacked(alignment._packed(values), 3) == values).all()


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
