import duckdb
import pytest

from parlance.plans.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    rel = con.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    want = sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=str)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(cols)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    assert len(rows) == len(want)
    assert rows == want
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
