import bisect
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parlance.llm.exact_dedup import drop_copies
from parlance.llm.near_dedup import drop_near_copies
from parlance.llm.packing import best_fit_decreasing, pack
from parlance.llm.token_files import token_files, write_token_files

TEXTS = ["", "a  b", "  x", "trail ", "tab\t x", "a \n b", "a\n\nb c", "don't  stop", "İstanbul ﬁ é", None, " ", "y" * 5000, "w1 " * 6000, "same text", "same text", "Hello, world. it's, e.g. x., ..., a.b, É. 3. 4, U.S. hello, Hello"]


def frame(spark, texts=TEXTS):
    rows = [(None if i == 3 else i // 2 if i > 12 else 1000 - i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length int")


@pytest.mark.parametrize("dtype", ["u4", None])
def test_token_files_round_trip(spark, dtype):
    name = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(name)
    docs = frame(spark)
    got = token_files(spark, docs, name, dtype=dtype).collect()
    want = {}
    for r in docs.collect():
        ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))


def test_every_long_is_an_id_of_its_own(spark):
    ids = [None, -(2**63), 0, 2**63 - 1, None]
    docs = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    got = token_files(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), shards=2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(2**63), 0, 2**63 - 1]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(5)]


def test_copies_with_other_columns_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", None), (2, "other", "z")], "doc_id long, text string, source string")
    for drop in (drop_copies, drop_near_copies):
        assert sorted(r.doc_id for r in drop(docs).collect()) == [1, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert write_token_files(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert token_files(spark, none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_is_gapless_and_whole(spark):
    name = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(name)
    docs = frame(spark)
    got = pack(docs, name, size=64).collect()
    want = []
    for r in docs.collect():
        ids = np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(r.doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 64) + 1


def test_best_fit_equals_one_piece_at_a_time():
    rng = np.random.default_rng(1)
    for _ in range(100):
        size = int(rng.choice([8, 16, 50]))
        lengths = rng.integers(1, size + 1, int(rng.integers(0, 200))).tolist()
        runs = best_fit_decreasing({x: lengths.count(x) for x in set(lengths)}, size)
        used = {s + i for _, _, c, s, _ in runs for i in range(c)}
        bins = []
        for x in sorted(lengths, reverse=True):
            fit = [b for b in bins if b[0] >= x]
            if fit:
                min(fit, key=lambda b: b[0])[0] -= x
            else:
                bins.append([size - x])
        assert len(used) == len(bins)
        assert sum(r[2] for r in runs) == len(lengths)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_encoder_equals_the_library(name):
    import pyarrow as pa

    from parlance.llm import encoding

    rng = np.random.default_rng(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "!", "\x01", " ", "́", "é", "1", "<|endoftext|>", "Ġ", "　", "\x1f", "\r\n", "İ", "x" * 60]
    texts = ["".join(rng.choice(parts, size=rng.integers(0, 25))) for _ in range(3000)] + [t or "" for t in TEXTS]
    enc = encoding.WordEncoder(public_tokenizers.path(name))
    want = enc.library(texts)
    for _ in range(2):  # with an empty memo, and with a full one
        ids, per = enc.encode(pa.array(texts))
        assert per.tolist() == [len(x) for x in want] and ids.tolist() == np.concatenate(want).tolist()


def test_memo_starts_again(monkeypatch):
    import pyarrow as pa

    from parlance.llm import encoding

    monkeypatch.setattr(encoding, "MEMO_WORDS", 50)
    enc = encoding.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(6):
        texts = [f"w{k} w{i} v{i * k} u" for i in range(40)]
        ids, per = enc.encode(pa.array(texts))
        assert ids.tolist() == np.concatenate(enc.library(texts)).tolist()


def test_queries_on_documents(spark, sf_dir):
    from parlance.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, want = 0, []
    for i in sorted(docs):
        ids = np.array(lib.encode(docs[i], add_special_tokens=False).ids + [2], dtype="<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_files"](spark, sf_dir).collect()) == want
    lib, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i in sorted(docs):
        ids = np.array(lib.encode(docs[i], add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = QUERIES["op9_packing"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    free: list[int] = []  # plain best-fit decreasing: the tightest open sequence, else a new one
    for n in sorted((r.length for r in got), reverse=True):
        k = bisect.bisect_left(free, n)
        left = free.pop(k) - n if k < len(free) else 2048 - n
        bisect.insort(free, left)
    assert len(filled) == len(free) and sorted(2048 - x for x in filled.values()) == free
