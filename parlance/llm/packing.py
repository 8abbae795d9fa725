"""Best-fit packing: best-fit decreasing over pieces of tokenised documents.

Documents become pieces of at most ``size`` tokens. Pieces of equal length are interchangeable to the
packer, so best-fit decreasing runs on the histogram of lengths: at most ``size`` rows whatever the
input, which is all that reaches the driver. Open sequences are kept per remaining capacity, and a
segment tree over capacities finds the tightest one that fits in logarithmic time; a run of equal
pieces goes into a run of equal sequences in one step. The result is the packing that best-fit
decreasing finds for the whole input. Pieces then get their place by their rank within their length:
the table is dealt by (length, doc_id, piece) ranges, and bases are prefix sums of one count per
partition.

Defined results: null text counts as empty (one piece: the end id); repeated doc_ids are kept, each
row with its own pieces (``row_key`` separates them); an empty table gives no rows; extra columns of
the input do not matter.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import partitions, save, ship, slices, text_or_empty
from parlance.llm.encoding import encoder


class CapacityTree:
    """Segment tree over remaining capacities; finds the least capacity >= need that has open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = self.leaves + capacity
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = self.leaves + need
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset): pieces of one length in rank order."""
    tree, open_runs, runs, sequences = CapacityTree(size), [deque() for _ in range(size + 1)], [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                per = size // length
                full, rest = divmod(left, per)
                # A new sequence stays the tightest for this length until it is full.
                for k in range(per):
                    runs.append((length, rank + k * full, full, sequences, k * length)) if full else None
                if full and size - per * length:
                    open_runs[size - per * length].append((sequences, full))
                    tree.add(size - per * length, full)
                sequences += full
                for k in range(rest):
                    runs.append((length, rank + per * full + k, 1, sequences, k * length))
                if rest:
                    open_runs[size - rest * length].append((sequences, 1))
                    tree.add(size - rest * length, 1)
                    sequences += 1
                break
            first, n = open_runs[capacity][0]
            take = min(n, left)
            runs.append((length, rank, take, first, size - capacity))
            if take == n:
                open_runs[capacity].popleft()
            else:
                open_runs[capacity][0] = (first + take, n - take)
            tree.add(capacity, -take)
            if capacity > length:
                open_runs[capacity - length].append((first, take))
                tree.add(capacity - length, take)
            rank += take
            left -= take
    return runs


def pieces_of(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, row_key, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", 6_000_000):
                ids, per = enc.encode(part.column("text"))
                out = np.full(len(ids) + len(per), end_id, dtype="<u4")
                total = per + 1
                ends = np.cumsum(total)
                keep = np.ones(len(out), dtype=bool)
                keep[ends - 1] = False
                out[keep] = ids
                count = -(-total // size)
                row = np.repeat(np.arange(len(per)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, total[row] - start)
                at = (ends - total)[row] + start
                view = memoryview(out).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), part.column("row_key").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))],
                    names=["doc_id", "row_key", "piece", "start", "length", "ids_crc32"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), text_or_empty().alias("text"))
    return own.mapInArrow(cut, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long".replace("piece int", "piece long"))


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    cut = save(spark, pieces_of(docs, tokenizer, size, end_id), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    runs = best_fit_decreasing(histogram, size)
    dealt = save(
        spark,
        cut.repartitionByRange(partitions(spark), "length", "doc_id", "row_key", "piece").sortWithinPartitions("length", "doc_id", "row_key", "piece").withColumn("at", F.monotonically_increasing_id()),
        "ranked",
    )
    part, low = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    base, total = {}, 0
    for p, n in sorted(tuple(r) for r in dealt.groupBy(part.alias("p")).count().collect()):
        base[p] = total
        total += n
    below, n = {}, 0
    for length in sorted(histogram):
        below[length] = n
        n += histogram[length]
    by_length: dict[int, list] = {}
    for length, rank, count, sequence, offset in runs:
        by_length.setdefault(length, []).append((rank, count, sequence, offset))
    table = {k: np.asarray(sorted(v), dtype=np.int64) for k, v in by_length.items()}
    held = spark.sparkContext.broadcast((base, below, table))

    def place(batches):
        base, below, table = held.value
        for batch in batches:
            p = np.asarray(batch.column("p"))
            length = np.asarray(batch.column("length"))
            rank = np.asarray(batch.column("low")) + np.fromiter((base[x] for x in p.tolist()), dtype=np.int64, count=len(p))
            sequence, offset = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                runs, own = table[n], rank[rows] - below[n]
                k = np.searchsorted(runs[:, 0], own, side="right") - 1
                sequence[rows], offset[rows] = runs[k, 2] + own - runs[k, 0], runs[k, 3]
            names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = dealt.select("doc_id", "row_key", "piece", "start", "length", "ids_crc32", part.alias("p"), low.alias("low"))
    return out.mapInArrow(place, "doc_id long, row_key long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
