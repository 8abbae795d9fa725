"""Token-ID / binary output: flat unsigned-integer shards, 64-bit document offsets, memory-mapped reads.

Layout below one folder, in ascending document order:

* ``ids-<shard>.bin``: the ids of the shard's documents, back to back, little-endian unsigned 16-bit
  integers where the whole vocabulary fits, else 32-bit (``dtype`` in the manifest);
* ``docs-<shard>.i64``: pairs of little-endian 64-bit integers, document id and place in the shard; where the
  id is null, the place is complemented (negative), and the id stands for nothing;
* ``offsets-<shard>.i64``: the global 64-bit offset of each document and of the shard's end.

Shards come from a range partitioning on doc_id, so shard order is document order. Each task writes to
a name of its own and renames, so retried or duplicated tasks leave whole files. The driver handles
only one (ids, documents) pair per shard: their prefix sums are the shards' bases.

Defined results: null text counts as empty (only the end id); rows with equal doc_id are all kept, in
order of their text hash; a null doc_id sorts first and is read back as null, and every 64-bit integer as
itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import partitions, posix, shared_dir, ship, slices, text_or_empty
from parlance.llm.encoding import encoder

def _put(path: str, write) -> None:
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(own, "wb") as f:
        write(f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(own, path)


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 2, dtype: str | None = None, shards: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write the files; returns the manifest (shard, n_docs, n_ids, base)."""
    spark = docs.sparkSession
    ship(spark)
    folder = posix(folder or shared_dir(spark, "token-files"))
    os.makedirs(folder, exist_ok=True)
    dtype = dtype or ("u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "u4")

    def write(batches):
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        ids_path = f"{folder}/ids-{shard:06d}.bin"
        own = f"{ids_path}.{uuid.uuid4().hex}.tmp"
        rows, at = [], 0
        with open(own, "wb") as f:
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, per = enc.encode(part.column("text"))
                    out = np.full(len(ids) + len(per), end_id, dtype=f"<{dtype}")
                    if len(ids) and ids.max() > np.iinfo(out.dtype).max:
                        raise ValueError(f"ids do not fit {dtype}")
                    mark = np.cumsum(per + 1) - 1
                    keep = np.ones(len(out), dtype=bool)
                    keep[mark] = False
                    out[keep] = ids
                    f.write(out.tobytes())
                    doc, place = part.column("doc_id"), at + mark - per
                    none = np.asarray(doc.is_null())
                    rows.append(np.stack([np.asarray(doc.fill_null(0), dtype="<i8"), np.where(none, ~place, place)], axis=1))
                    at += len(out)
            f.flush()
            os.fsync(f.fileno())
        if not rows:
            os.remove(own)
            return
        os.replace(own, ids_path)
        _put(f"{folder}/docs-{shard:06d}.i64", lambda f: [f.write(np.ascontiguousarray(r, dtype="<i8").tobytes()) for r in rows])
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "n_docs": pa.array([sum(map(len, rows))], pa.int64()), "n_ids": pa.array([at], pa.int64())})

    n = shards or partitions(spark)
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .repartitionByRange(n, F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    )
    done = sorted(tuple(r) for r in dealt.mapInArrow(write, "shard long, n_docs long, n_ids long").collect())
    base, rows = 0, []
    for shard, n_docs, n_ids in done:
        rows.append((shard, n_docs, n_ids, base, folder, dtype))
        base += n_ids
    manifest = spark.createDataFrame(rows, "shard long, n_docs long, n_ids long, base long, folder string, dtype string")
    return manifest.repartition(max(1, min(len(rows), n)), "shard")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Write the shards' global offsets, then read every document back through memory maps."""
    ship(manifest.sparkSession)

    def read(frames):
        import pandas as pd

        for frame in frames:
            for shard, n_docs, n_ids, base, folder, dtype in frame[["shard", "n_docs", "n_ids", "base", "folder", "dtype"]].itertuples(index=False):
                docs = np.memmap(f"{folder}/docs-{shard:06d}.i64", dtype="<i8", mode="r").reshape(-1, 2)
                path = f"{folder}/offsets-{shard:06d}.i64"
                offsets = np.append(np.where(docs[:, 1] < 0, ~docs[:, 1], docs[:, 1]), n_ids) + base
                _put(path, lambda f, x=offsets: f.write(x.astype("<i8").tobytes()))
                offsets, ids = np.memmap(path, dtype="<i8", mode="r"), np.memmap(f"{folder}/ids-{shard:06d}.bin", dtype=f"<{dtype}", mode="r")
                if len(docs) != n_docs or len(ids) != n_ids:
                    raise ValueError(f"shard {shard} is not whole")
                for a in range(0, n_docs, 20_000):
                    b = min(n_docs, a + 20_000)
                    local = np.asarray(offsets[a : b + 1]) - base
                    held = np.ascontiguousarray(ids[local[0] : local[-1]], dtype="<u4")
                    cut = (local - local[0]) * 4
                    view = memoryview(held).cast("B")
                    crc = [zlib.crc32(view[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    doc = pd.arrays.IntegerArray(np.array(docs[a:b, 0], dtype=np.int64), np.array(docs[a:b, 1] < 0))
                    yield pd.DataFrame({"doc_id": doc, "start": offsets[a:b], "n_tokens": np.diff(local), "ids_crc32": np.asarray(crc, dtype=np.int64)})

    return manifest.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Both steps: per document its global start, number of ids and CRC-32 as read from the files."""
    return read_token_files(write_token_files(docs, tokenizer, **how))
