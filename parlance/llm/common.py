"""Shared helpers: table access, the shared folder, shipping code to executors, Arrow word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.shipping import ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A driver table; with ``cols`` only those columns are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = tempfile.mkdtemp(prefix="parlance-")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def posix(path: str) -> str:
    """The path for ``open()``: memory-mapped files need a shared folder that is mounted."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped output needs a mounted shared folder")
    return path


@contextmanager
def clean_shuffles(spark: SparkSession):
    """Within, a query's shuffle files go when it has ended: what it wrote is whole, nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def save(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read the table back."""
    path = shared_dir(spark, name)
    with clean_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more; frames that are not saved tables are passed over."""
    for df in tables:
        if not hasattr(df, "saved_at"):
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def strings(column) -> pa.Array:
    """An Arrow column as one string array, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 8_000_000):
    """Cut a batch of rows so that each part holds about ``max_bytes`` of text (at least one row).

    Memory that a part's work has freed is given back before the next.
    """
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    group = np.cumsum(size) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))
            release()


def release() -> None:
    """Give freed memory back: workers live on for other tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``start .. start + length`` as one index array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """ASCII-white-space words of each text: distinct words, code of each word, words per text."""
    parts = pc.ascii_split_whitespace(texts)
    flat, counts = parts.flatten(), np.asarray(pc.list_value_length(parts), dtype=np.int64)
    keep = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not keep.all():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(keep))
    coded = flat.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64), counts
