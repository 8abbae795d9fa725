"""Exact top-k search: exhaustive term-at-a-time accumulation.

Rows are sparse vectors (terms, integer weights). The stated query set is stored once and goes out in
blocks of about ``block`` queries, one broadcast at a time whatever their number. Each corpus partition
turns its rows, a batch at a time, into postings by term; every posting of a query scatters query weight
x corpus weights into the query's dense score array. Each partition selects its k best per query, the
selections of a block are merged, and every block appends its results to one folder, which is read once.

Scores are exact: where a bound on them leaves 64 bits, the accumulation runs in Python integers.

Defined results: the candidates are all rows but those with the query's own id; ties go to the smaller
id; a query row that is repeated gets its own result (``query_row`` tells them apart); rows without an
id or a vector, or holding null or non-finite components, take no part; components beyond the 64-bit
range saturate at it, and so do reported scores (their order stays exact); a query with fewer than k
candidates gets them all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import clean_shuffles, discard, save, shared_dir, ship
from parlance.llm.wide import HIGHEST, LIMBS, LOWEST, descending, limbs, saturated

CELLS = 3_000_000


def quantised(df: DataFrame, id_col: str, vector: str, scale: int = 1024) -> DataFrame:
    """Dense vectors as sparse integer rows (id, terms, weights): floor(scale * x), zeros left out."""
    x = F.col(vector).cast("array<double>")
    whole = F.col(vector).isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    floor = F.transform(x, lambda v, i: F.struct(i.alias("t"), F.floor(v * scale).alias("w")))
    held = F.filter(floor, lambda s: s["w"] != 0)
    return df.where(whole).select(F.col(id_col).cast("long").alias("id"), held["t"].alias("terms"), held["w"].alias("weights"))


class Postings:
    """Rows by term: for each term the rows that hold it and their weights."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, counts: np.ndarray):
        self.rows = len(counts)
        row = np.repeat(np.arange(self.rows), counts)
        order = np.argsort(terms, kind="stable")
        self.row, self.weight = row[order], weights[order]
        self.terms, first = np.unique(terms[order], return_index=True)
        self.cut = np.append(first, len(terms))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.row[self.cut[k] : self.cut[k + 1]], self.weight[self.cut[k] : self.cut[k + 1]]


def accumulate(queries: Postings, corpus: Postings) -> tuple[np.ndarray, int]:
    """Dense scores, queries x corpus rows (int64, or Python integers where those may overflow), and postings scattered."""
    both, qi, ci = np.intersect1d(queries.terms, corpus.terms, return_indices=True)
    top = lambda w: max(abs(int(w.min(initial=0))), abs(int(w.max(initial=0))))
    per_row = max(1, int(np.bincount(corpus.row, minlength=1).max(initial=0)))
    exact = top(queries.weight) * top(corpus.weight) * per_row < 1 << 62
    kind = np.int64 if exact else object
    score = np.zeros((queries.rows, corpus.rows), dtype=kind)
    held, scattered = np.empty(corpus.rows, dtype=kind), 0
    for q, c in zip(qi, ci, strict=True):
        rows, weights = corpus.of(c)
        weights = weights.astype(kind, copy=False)
        everywhere = len(rows) == corpus.rows and bool((np.diff(rows) == 1).all())
        for r, w in zip(*queries.of(q), strict=True):
            np.multiply(weights, w if exact else int(w), out=held[: len(rows)])
            if everywhere:  # the postings hold every row, in order
                score[r] += held
            else:
                np.add.at(score[r], rows, held[: len(rows)])
        scattered += len(rows) * int(queries.cut[q + 1] - queries.cut[q])
    return score, scattered


def _sparse(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    terms, weights = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column("terms"), batch.column("weights")))
    counts = np.diff(np.asarray(terms.offsets, dtype=np.int64))
    return np.asarray(batch.column("id"), dtype=np.int64), np.asarray(terms.flatten(), dtype=np.int64), np.asarray(weights.flatten(), dtype=np.int64), counts


def _select(score: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of each query's k best at or above its floor; ids ascend, so ties go left."""
    qs, rows = [], []
    mask = (score >= floor[:, None]).astype(bool)
    many = np.flatnonzero(mask.sum(axis=1) > 4 * k)
    for q in many.tolist():
        s = score[q]
        kth = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else s.min()
        at = np.concatenate([np.flatnonzero(s > kth), np.flatnonzero((s == kth) & mask[q])[:k]])
        qs.append(np.full(len(at), q))
        rows.append(at)
    mask[many] = False
    q, r = np.nonzero(mask)
    return np.concatenate([*qs, q]), np.concatenate([*rows, r])


def _order(best_q: np.ndarray, best_s: np.ndarray, best_i: np.ndarray) -> np.ndarray:
    if best_s.dtype != object:
        return np.lexsort((best_i, -best_s, best_q))
    return np.array(sorted(range(len(best_q)), key=lambda k: (best_q[k], -best_s[k], best_i[k])), dtype=np.int64)


def exact_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """``corpus`` and ``queries`` are (id, terms, weights); returns query_id, query_row, rank, id, score."""
    spark = corpus.sparkSession
    ship(spark)
    stored = save(spark, queries.select("id", "terms", "weights").withColumn("row", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-stored.count() // block))
    of_block = F.pmod(F.xxhash64("row"), F.lit(blocks))  # about even whatever ids repeat
    rows, folder = corpus.select("id", "terms", "weights"), shared_dir(spark, "topk")
    if blocks > 1:
        rows = save(spark, rows, "corpus")  # read once a block
    for b in range(blocks):
        sent = spark.sparkContext.broadcast(stored.where(of_block == b).orderBy("row").toArrow())

        def score(batches, sent=sent):
            if not sent.value.num_rows:
                return
            qid, qt, qw, qn = _sparse(sent.value)
            qrow = np.asarray(sent.value.column("row"))
            qcut = np.concatenate([[0], np.cumsum(qn)])
            best_s, best_i, best_q = (np.zeros(0, np.int64) for _ in range(3))
            floor = np.full(len(qid), LOWEST).astype(object)
            for batch in batches:
                if not batch.num_rows:
                    continue
                batch = batch.sort_by("id")
                ids, t, w, n = _sparse(batch)
                postings = Postings(t, w, n)
                step = max(1, CELLS // len(ids))
                for a in range(0, len(qid), step):
                    z = min(len(qid), a + step)
                    s, _ = accumulate(Postings(qt[qcut[a] : qcut[z]], qw[qcut[a] : qcut[z]], qn[a:z]), postings)
                    low = LOWEST if s.dtype != object else -(1 << 200)
                    lo, hi = np.searchsorted(ids, qid[a:z]), np.searchsorted(ids, qid[a:z], side="right")
                    for q in np.flatnonzero(hi > lo).tolist():
                        s[q, lo[q] : hi[q]] = low
                    least = floor[a:z] if s.dtype == object else np.array([min(max(int(x), LOWEST + 1), HIGHEST) for x in floor[a:z]], dtype=np.int64)
                    q, r = _select(s, ids, k, np.maximum(least, low + 1))
                    best_q, best_i, best_s = np.concatenate([best_q, q + a]), np.concatenate([best_i, ids[r]]), np.concatenate([best_s, s[q, r]])
                order = _order(best_q, best_s, best_i)
                best_q, best_i, best_s = best_q[order], best_i[order], best_s[order]
                first = np.searchsorted(best_q, best_q)
                keep = np.arange(len(best_q)) - first < k
                best_q, best_i, best_s = best_q[keep], best_i[keep], best_s[keep]
                n_each = np.bincount(best_q, minlength=len(qid))
                full = np.flatnonzero(n_each == k)
                floor[full] = best_s[np.cumsum(n_each)[full] - 1]
            # Exact scores travel in three limbs, so the merge orders them as integers too.
            wide = {c: pa.array(x, pa.int64()) for c, x in limbs(best_s).items()}
            yield pa.RecordBatch.from_pydict({"query_id": qid[best_q], "query_row": qrow[best_q], "id": best_i, **wide})

        part = rows.mapInArrow(score, f"query_id long, query_row long, id long, {LIMBS}")
        w = Window.partitionBy("query_id", "query_row").orderBy(*descending(), F.asc("id"))
        out = part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", saturated().alias("score"), "query_row")
        if blocks == 1:
            return out
        with clean_shuffles(spark):
            out.write.mode("append").parquet(folder)
        sent.unpersist()
    discard(spark, stored, rows)
    return spark.read.schema(out.schema).parquet(folder)
