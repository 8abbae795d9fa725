import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from parlance.llm import pii, toxicity
from parlance.llm.near_dedup import aligned, labelled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(rng, n):
    return " ".join(f"w{rng.integers(4000)}" for _ in range(n))


def corpus(spark, path):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        text = words(rng, int(rng.integers(20, 200)))
        if i % 5 == 0:
            text += " you stupid idiot clown " + words(rng, 5)
        if i % 7 == 0:
            text += " mail a.b@example.com or +49 (30) 123-4567"
        rows.append(text)
    rows += [rows[1], rows[1], rows[2] + " tail", rows[3].replace("w1", "v1", 1), "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(rows)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return docs, labels


def brute(docs, labels):
    """The stages on a list of rows."""
    scorer = toxicity.Scorer(*toxicity.fit([(r.text, r.y) for r in toxicity.training_sample(docs, labels).collect()]))
    import pyarrow as pa

    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    rows = [r for r, s in zip(rows, scorer(pa.array([t for _, t in rows])), strict=True) if s < 0.3]
    last = {t: i for i, t in rows}
    rows = [(i, t) for i, t in rows if last[t] == i]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, x) in enumerate(rows):
        at = {g: n for n, g in enumerate(labelled(x))}
        for j, y in rows[:k]:
            if aligned(at, labelled(y), 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    rows = [(i, t) for i, t in rows if find(i) == i]
    found = pii.spans_of(pii.trained(), [t for _, t in rows])
    rows = [(i, pii.redact_text(t, b + a)) for (i, t), b, a in zip(rows, *found, strict=True)]
    lib, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t in rows:
        ids = np.array(lib.encode(t, add_special_tokens=False).ids + [0], dtype="<u4")
        out += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels = corpus(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(docs, labels)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048


def test_stages_keep_the_columns(spark, tmp_path):
    docs, _ = corpus(spark, tmp_path)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == COLUMNS, name
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    texts = [r.text or "" for r in kept.collect()]
    assert not any("@example.com" in t for t in texts)
    assert any(re.search(r"\[EMAIL\]", t) for t in texts)
    assert kept.where(F.col("text").contains("idiot")).count() == 0


def test_registered():
    q = __spark_entry__.queries()
    assert q["pipeline"] is corpus_pipeline.run
    assert all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))


def test_stages_with_edges(spark, tmp_path):
    """Nulls, repeated rows and doc_ids, clashing column names, and an empty table go through every stage."""
    rows = [(1, "same text here now ok"), (1, "same text here now ok"), (None, None), (None, "null id"), (2, ""), (3, "x" * 100_000), (3, "other text of the same id"), (4, "mail a.b@example.com " * 3)]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(c) for c in ("score", "_score", "keep_id", "own_sha", "node", "label", "row_key", "p", "at")}
    named = docs.withColumns(extra)
    spark.createDataFrame([(1, 0), (None, 1), (4, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for start in (named, named.limit(0)):
        kept = start
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, str(tmp_path))
            if name != "packing":
                assert kept.columns == named.columns, name
            kept.write.mode("overwrite").parquet(f"{tmp_path}/out-{name}")
            kept = spark.read.parquet(f"{tmp_path}/out-{name}")
        if start is named:
            texts = {r.text for r in spark.read.parquet(f"{tmp_path}/out-pii").collect()}
            assert "same text here now ok" in texts and "x" * 100_000 in texts and any("[EMAIL]" in (t or "") for t in texts)
            assert spark.read.parquet(f"{tmp_path}/out-exact_dedup").count() == 7 - 1
            assert {r.label for r in spark.read.parquet(f"{tmp_path}/out-pii").collect()} == {"label"}
        else:
            assert kept.count() == 0
