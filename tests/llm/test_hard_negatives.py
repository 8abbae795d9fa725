import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import hard_negatives as hn
from parlance.llm.hard_negatives import Anchors, Batch, Best, augmented, band, brackets, choose_pivots, distances, hard_negatives, pivot_table, prepared
from parlance.llm.wide import HIGHEST, LOWEST

SCHEMA = "vec_id long, embedding array<double>, label int, d string, row int"


def brute(rows, every=50, scale=256, low=50, high=95):
    """Plain loops over (vec_id, embedding, label)."""
    whole = lambda x: [min(max(math.floor(scale * c), int(LOWEST)), int(HIGHEST)) for c in x]
    own = [(i, whole(x), l) for i, x, l in rows if i is not None and l is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]  # noqa: E741
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    clip = lambda s: min(max(s, int(LOWEST)), int(HIGHEST))
    out = []
    for i, q, label in own:
        if i % every:
            continue
        others = sorted(((dot(q, x), j, m) for j, x, m in own if j != i), key=lambda r: (-r[0], r[1]))
        for ps, pid, _ in [r for r in others if r[2] == label][:5]:
            found = [r for r in others if r[2] != label and low * ps <= 100 * r[0] <= high * ps][:3]
            out += [(i, pid, k + 1, j, clip(ps), clip(s)) for k, (s, j, _) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives(prepared(df, "vec_id", "label", "embedding"), F.col("id") % 50 == 0, **how).collect()))


def clustered(n, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, dims))
    kind = rng.integers(0, 6, n)
    return [(int(i), (centres[k] + rng.normal(0, 0.2, dims)).tolist(), int((k + (i % 5 == 0)) % 4)) for i, k in enumerate(kind)]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_BYTES": 200}, {"SEED_ROWS": 3}])
def test_equals_plain_loops(spark, limits, monkeypatch):
    for name, value in limits.items():
        monkeypatch.setattr(hn, name, value)
    rows = clustered(400)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 50


def test_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.integers(-2, 3, 3)], int(rng.integers(0, 2))) for i in range(60)]
    rows += [(7, [1.0, 1.0, 1.0], 0), (7, [1.0, 1.0, 1.0], 0), (50, [1.0, 0.0, 1.0], 1), (100, [2.0, 2.0, 2.0], 0), (100, [2.0, 2.0, 2.0], 0)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (61, None, 0), (62, [1.0, None, 1.0], 0), (63, [math.nan, 1.0, 1.0], 0), (64, [math.inf, 1.0, 1.0], 0), (65, [1.0, 1.0, 1.0], None)]
    rows += [(66, [2.0], 0), (67, [1.0, 1.0, 1.0, 5.0], 1), (68, [], 0), (150, [0.0, 0.0, 0.0], 0)]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1e7, 1e12, 1e300])
def test_scores_of_any_size(spark, size):
    rows = [(i * 10, [size * math.sin(i + k) for k in range(3)], i % 2) for i in range(40)]
    got = mined(spark, rows)
    assert got == brute(rows) and got


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 0)]) == []  # no anchors
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_brackets_hold_and_rule_rows_out(spark):
    rows = clustered(2000, 6, 9)
    df = prepared(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), "vec_id", "label", "embedding")
    stored, pivots, top2, dims = pivot_table(df)
    batch = stored.select("id", "label", "v", "d").toArrow().combine_chunks().to_batches()[0]
    own = Batch(batch, dims)
    norm2 = (own.v.astype(float) ** 2).sum(axis=1)
    assert np.allclose(own.d.T, distances(augmented(own.v, norm2, top2), pivots)) and len(pivots) == 8
    anchors = Anchors(stored.where("id % 50 = 0").withColumn("row", F.col("id")).select("row", "id", "label", "v", "norm2").toArrow(), pivots, dims)
    checked = total = 0
    for k in range(len(anchors.id)):
        low, high = brackets(own.d, anchors.d[k], float(anchors.norm2[k]), top2)
        score = own.v @ anchors.v[k]
        assert (low <= score).all() and (score <= high).all()
        checked += hn._search(own, np.arange(len(own.id)), anchors.v[k], anchors.d[k], float(anchors.norm2[k]), top2, [Best(5)])
        total += len(own.id)
    assert checked < 0.6 * total


def test_pivots_of_equal_rows():
    assert len(choose_pivots(np.ones((5, 3)), 4)) == 1


def test_band():
    for score in range(-30, 200):
        low, high = band(score, 50, 95)
        assert [s for s in range(-40, 220) if 50 * score <= 100 * s <= 95 * score] == list(range(low, high + 1))


def test_query_equals_sql_and_plain_loops(spark, sf_dir):
    from parlance.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    rel = con.execute(SQL["op12_hard_negatives"])
    cols = [d[0] for d in rel.description]
    got = sorted(tuple(r[c] for c in cols) for r in QUERIES["op12_hard_negatives"](spark, sf_dir).collect())
    assert got == sorted(rel.fetchall())
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got == brute(rows)
