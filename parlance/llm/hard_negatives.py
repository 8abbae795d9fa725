"""Hard-negative mining with a pivot table.

Vectors of integers are augmented so that the inner product becomes a distance: with M the largest norm, a row
gets the further component sqrt(M^2 - |x|^2) and an anchor 0, and |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Some rows
are pivots; every row's distances to them are stored beside it. The triangle inequality then brackets the
distance of an anchor to a row by |d(q,p) - d(x,p)| and d(q,p) + d(x,p), over all pivots, and so the score.
Rows whose bracket lies outside what is asked for are passed over; survivors are checked by exact integers.

Anchors go out in blocks of bounded size, one broadcast at a time. For a block, two searches run over the table:
the best rows of the anchor's own label, then, for each of those, the best rows of other labels whose score lies
in the band that the positive's score sets. A task first checks the rows with the highest upper brackets, which
raises its thresholds, then all others that still can matter; selections of tasks are merged. All blocks append
to one folder, which is read once.

Pivots are fitted on the ``SAMPLE`` rows with the smallest hash (a bounded sample); the table of distances covers
all rows. Brackets are widened by the rounding of their arithmetic, so no row is lost to it.

Defined results: rows whose id, label or vector is null, or whose vector holds null or non-finite components,
take no part; shorter vectors count as padded with zeros; an anchor's other rows are all rows but those with its
id; ties go to the smaller id; repeated anchors and repeated positives get their own results; components beyond
64 bits saturate, and so do reported scores (their order stays exact); a positive with a score below 0 has an
empty band; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import clean_shuffles, discard, save, shared_dir, ship
from parlance.llm.wide import HIGHEST, LIMBS, LOWEST, descending, limbs, saturated, value

PIVOTS, SAMPLE, SEED_ROWS = 8, 512, 256
BLOCK_BYTES = 8_000_000
SLACK = 1e-9


def prepared(df: DataFrame, id_col: str, label: str | Column, vector: str, scale: int = 256) -> DataFrame:
    """(id, label, v, norm2): floor(scale * x) of dense vectors that take part."""
    x = F.col(vector).cast("array<double>")
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")).where(F.col("label").isNotNull())
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(column.offsets, dtype=np.int64))
    flat = np.asarray(column.flatten(), dtype=np.int64)
    if len(size) and (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``points`` far from each other: each next one is the farthest from those chosen."""
    if not len(points):
        return points
    chosen, near = [0], None
    while len(chosen) < min(count, len(points)):
        d = np.linalg.norm(points - points[chosen[-1]], axis=1)
        near = d if near is None else np.minimum(near, d)
        if near.max() <= 0:
            break
        chosen.append(int(near.argmax()))
    return points[chosen]


def augmented(v: np.ndarray, norm2: np.ndarray, top2: float) -> np.ndarray:
    return np.concatenate([v.astype(np.float64), np.sqrt(np.maximum(top2 - norm2, 0))[:, None]], axis=1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Rows x pivots."""
    return np.stack([np.linalg.norm(points - p, axis=1) for p in pivots], axis=1) if len(pivots) else np.zeros((len(points), 0))


def pivot_table(rows: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, float, int]:
    """The stored rows with their distances ``d``; the pivots, the largest squared norm, the vectors' length."""
    spark = rows.sparkSession
    ship(spark)
    top2, dims = rows.agg(F.max("norm2"), F.max(F.size("v"))).first()
    top2, dims = float(top2 or 0), int(dims or 0)
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow()
    chosen = choose_pivots(augmented(_matrix(sample.column("v"), dims), np.asarray(sample.column("norm2")), top2), pivots)

    def measure(batches):
        for batch in batches:
            d = distances(augmented(_matrix(batch.column("v"), dims), np.asarray(batch.column("norm2")), top2), chosen)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, max(1, len(chosen))) if d.size else np.zeros(len(d) + 1), pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "d"])

    table = rows.mapInArrow(measure, "id long, label long, v array<long>, norm2 double, d array<double>")
    return save(spark, table, "pivot-table"), chosen, top2, dims


class Batch:
    """Corpus rows in arrays; scores of some of them against an anchor are exact integers."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        self.id, self.label = np.asarray(batch.column("id")), np.asarray(batch.column("label"))
        self.v = _matrix(batch.column("v"), dims)
        pivots = np.asarray(batch.column("d").flatten())
        self.d = np.ascontiguousarray(pivots.reshape(len(self.id), -1).T)
        self.top = int(np.abs(self.v.astype(np.float64)).max(initial=0)) + 1
        self.float = self.v.astype(np.float64)

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        bound = (int(np.abs(q.astype(np.float64)).max(initial=0)) + 1) * self.top * max(1, len(q))
        if bound < 1 << 53:
            return (self.float[rows] @ q.astype(np.float64)).astype(np.int64)
        if bound < 1 << 62:
            return self.v[rows] @ q
        return (self.v[rows].astype(object) * q.astype(object)).sum(axis=1) if len(rows) else np.zeros(0, dtype=np.int64)


def brackets(d: np.ndarray, dq: np.ndarray, q2: float, top2: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score that each row can have, from its distances ``d`` (pivots x rows) and the anchor's."""
    low, high = np.zeros(d.shape[1]), np.full(d.shape[1], np.inf)
    for own, other in zip(d, dq, strict=True):
        np.maximum(low, np.abs(own - other), out=low)
        np.minimum(high, own + other, out=high)
    slack = SLACK * (q2 + top2) + 1e-6
    return (q2 + top2 - high * high) / 2 - slack, (q2 + top2 - low * low) / 2 + slack


class Best:
    """The k best (score, id) within a band, of one search."""

    def __init__(self, k: int, low=None, high=None):
        self.k, self.low, self.high = k, low, high
        self.rows: list[tuple] = []

    def need(self):
        """Lowest score that still can enter; None: any."""
        if len(self.rows) < self.k:
            return self.low
        return self.rows[-1][0] if self.low is None else max(self.low, self.rows[-1][0])

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        keep = np.ones(len(score), dtype=bool)
        need = self.need()
        if need is not None:
            keep &= np.asarray(score >= need, dtype=bool)
        if self.high is not None:
            keep &= np.asarray(score <= self.high, dtype=bool)
        at = np.flatnonzero(keep)
        if len(at) > 4 * self.k:
            s = score[at]
            kth = np.partition(s, len(s) - self.k)[len(s) - self.k]
            tied = at[np.asarray(s == kth, dtype=bool)]
            at = np.concatenate([at[np.asarray(s > kth, dtype=bool)], tied[np.argsort(ids[tied], kind="stable")[: self.k]]])
        self.rows = sorted([*self.rows, *zip(score[at].tolist(), ids[at].tolist(), strict=True)], key=lambda r: (-r[0], r[1]))[: self.k]


def _search(batch: Batch, rows: np.ndarray, q: np.ndarray, dq: np.ndarray, q2: float, top2: float, asked: list[Best]) -> int:
    """Offer the anchor's survivors among ``rows`` to each of ``asked``; how many were checked exactly."""
    low, high = brackets(batch.d[:, rows], dq, q2, top2)

    def open_rows(at):
        most = [b.high for b in asked]
        needs = [b.need() for b in asked]
        keep = np.ones(len(at), dtype=bool)
        if None not in needs:
            keep &= high[at] >= float(min(needs))
        if None not in most:
            keep &= low[at] <= float(max(most))
        return at[keep]

    at = open_rows(np.arange(len(rows)))
    checked = 0
    if len(at) > 2 * SEED_ROWS:
        order = np.argpartition(high[at], len(at) - SEED_ROWS)
        first, at = at[order[len(at) - SEED_ROWS :]], at[order[: len(at) - SEED_ROWS]]
        for part in (first, None):
            part = open_rows(at) if part is None else part
            score = batch.exact(q, rows[part])
            for b in asked:
                b.offer(score, batch.id[rows[part]])
            checked += len(part)
        return checked
    score = batch.exact(q, rows[at])
    for b in asked:
        b.offer(score, batch.id[rows[at]])
    return len(at)


class Anchors:
    """A block of anchors in arrays."""

    def __init__(self, table: pa.Table, pivots: np.ndarray, dims: int):
        self.row, self.id, self.label = (np.asarray(table.column(c)) for c in ("row", "id", "label"))
        self.v, self.norm2 = _matrix(table.column("v"), dims), np.asarray(table.column("norm2"))
        own = np.concatenate([self.v.astype(np.float64), np.zeros((len(self.v), 1))], axis=1)
        self.d = distances(own, pivots)


def _run(batches, anchors: Anchors, top2: float, dims: int, searches, same_label: bool):
    """``searches``: per anchor its list of Best. Yields (row, slot, id, limbs)."""
    for raw in batches:
        if not raw.num_rows:
            continue
        batch = Batch(raw, dims)
        every = np.arange(len(batch.id))
        for label in np.unique(anchors.label):
            has = batch.label == label
            rows = every[has] if same_label else every[~has]
            if not len(rows):
                continue
            for k in np.flatnonzero(anchors.label == label).tolist():
                if searches[k]:
                    own = rows if not (batch.id[rows] == anchors.id[k]).any() else rows[batch.id[rows] != anchors.id[k]]
                    _search(batch, own, anchors.v[k], anchors.d[k], float(anchors.norm2[k]), top2, searches[k])
    found = [(anchors.row[k], slot, i, s) for k, own in enumerate(searches) for slot, b in enumerate(own) for s, i in b.rows]
    if found:
        row, slot, ids, score = zip(*found, strict=True)
        yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int64()), "slot": pa.array(slot, pa.int32()), "id": pa.array(ids, pa.int64())} | {c: pa.array(x, pa.int64()) for c, x in limbs(score).items()})


FOUND = f"row long, slot int, id long, {LIMBS}"


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("row", "slot").orderBy(*descending(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def band(score: int, low: int, high: int) -> tuple[int, int]:
    """Scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, pivots: int = PIVOTS) -> DataFrame:
    """Of ``prepared`` rows: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    stored, chosen, top2, dims = pivot_table(rows, pivots)
    asked = save(spark, stored.where(anchor).select("id", "label", "v", "norm2").withColumn("row", F.monotonically_increasing_id()), "anchors")
    blocks = max(1, -(-asked.count() * 8 * max(1, dims + len(chosen)) // BLOCK_BYTES))
    corpus, folder = stored.select("id", "label", "v", "d"), shared_dir(spark, "negatives")
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast(Anchors(block, chosen, dims))

        def near(batches, sent=sent):
            yield from _run(batches, sent.value, top2, dims, [[Best(positives)] for _ in sent.value.id], True)

        held = _merged(corpus.mapInArrow(near, FOUND), positives).select("row", "id", "rank", "h", "m", "l").toArrow()  # a block's positives
        held = sorted((r["row"], r["rank"], r["id"], value(r["h"], r["m"], r["l"])) for r in held.to_pylist())
        place = {r: k for k, r in enumerate(sent.value.row.tolist())}
        bands: list[list[tuple[int, int]]] = [[] for _ in place]
        for row, _, _, score in held:
            bands[place[row]].append(band(score, low, high))
        bounds = spark.sparkContext.broadcast(bands)

        def hard(batches, sent=sent, bounds=bounds):
            # A slot is a positive; an empty band gets a search that nothing enters.
            asked = [[Best(negatives, a, z) for a, z in own] if any(a <= z for a, z in own) else [] for own in bounds.value]
            yield from _run(batches, sent.value, top2, dims, asked, False)

        found = _merged(corpus.mapInArrow(hard, FOUND), negatives).select("row", "slot", "rank", F.col("id").alias("negative_id"), saturated().alias("negative_score"))
        ids = dict(zip(sent.value.row.tolist(), sent.value.id.tolist(), strict=True))
        clip = lambda s: min(max(s, int(LOWEST)), int(HIGHEST))
        own = spark.createDataFrame([(row, rank - 1, ids[row], i, clip(score)) for row, rank, i, score in held], "row long, slot int, anchor_id long, positive_id long, positive_score long")
        out = found.join(F.broadcast(own), ["row", "slot"])  # a block's anchors and positives, bounded like the block
        with clean_shuffles(spark):
            out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(folder)
        sent.unpersist()
        bounds.unpersist()
    discard(spark, stored, asked)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(folder)
