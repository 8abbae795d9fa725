from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm.exact_dedup import drop_copies, exact_dedup
from parlance.llm.queries import QUERIES, SQL, URL_RULES
from parlance.llm.topk import Postings, accumulate, exact_topk, quantised
from parlance.llm.url_filter import FEATURES, BoostedTrees, features, labelled_urls, parts, train, url_verdicts


def oracle(sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    return cols, sorted(map(tuple, rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    cols, want = oracle(sf_dir, name)
    got = QUERIES[name](spark, sf_dir)
    assert sorted(cols) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == want


def brute(rows, queries, k):
    out = []
    for q, (qi, qv) in enumerate(queries):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(qv, v, strict=True)), i) for i, v in rows if i != qi)
        out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_topk_edges(spark):
    rng = np.random.default_rng(0)
    base = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 1024]) for i in range(300)]
    base += [(300 + i, base[5][1]) for i in range(400)]  # one very common vector
    base += [(900, [1e9, -1e9, 0.0, 0.0, 0.0, 0.0]), (901, [300_000.5, 2.0, -131_073.0, 0.0, 0.0, 0.0]), (902, [1e13, 1e13, 0.0, 0.0, 0.0, 0.0]), (1900, [-1e13, 1.0, 0.0, 0.0, 0.0, 0.0])]
    bad = [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (None, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in base + bad], "vec_id long, embedding array<double>, score string").repartition(3)
    rows = quantised(df, "vec_id", "embedding")
    whole = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in base]
    in_long = lambda rows: [(q, r, i, min(max(s, -(2**63)), 2**63 - 1)) for q, r, i, s in rows]
    got = exact_topk(rows, rows.where("id % 100 = 0"), k=10, block=3).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == in_long(brute(whole, [x for x in whole if x[0] % 100 == 0], 10))
    twice = exact_topk(rows, rows.where("id = 200").unionByName(rows.where("id in (200, 300)")), k=3).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in twice) == sorted(in_long(brute(whole, [x for x in whole if x[0] == 200] * 2 + [x for x in whole if x[0] == 300], 3)))
    assert len({r.query_row for r in twice}) == 3
    few = exact_topk(rows.where("id < 4"), rows.where("id = 0"), k=10).collect()
    assert len(few) == 3
    assert exact_topk(rows.where("id < 0"), rows.where("id < 0")).count() == 0
    assert exact_topk(rows, rows.where("id < 0")).count() == 0


def test_scores_are_scattered_postings(spark, sf_dir):
    rng = np.random.default_rng(1)
    dense = lambda n: Postings(np.tile(np.arange(5), n), rng.integers(1, 9, 5 * n), np.full(n, 5))
    q, c = dense(3), dense(7)
    score, scattered = accumulate(q, c)
    assert scattered == 5 * 3 * 7 and score.shape == (3, 7)
    sparse = Postings(np.array([4, 4, 0, 4]), np.array([2, 3, 5, 7]), np.array([1, 2, 0, 1]))
    score, scattered = accumulate(q, sparse)
    assert scattered == 3 * 3 + 3 and (score[:, 2] == 0).all()
    at = lambda r, t: int(q.weight[(q.row == r) & (np.repeat(q.terms, np.diff(q.cut)) == t)].sum())
    assert score.tolist() == [[2 * at(r, 4), 3 * at(r, 4) + 5 * at(r, 0), 0, 7 * at(r, 4)] for r in range(3)]


def test_exact_dedup_edges(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (None, "z"), (7, "q" * 200_000), (8, "q" * 200_000), (9, "dup"), (9, "dup"), (None, "n"), (None, "n")] + [(100 + i, "hot") for i in range(300)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, keep_id string, n int").repartition(40)
    got = exact_dedup(df, fan_in=4).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    want = sorted(((i, max((x for x in by[t or ""] if x is not None), default=None), len(by[t or ""])) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(by)
    kept = drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(by)
    assert exact_dedup(df.limit(0)).count() == 0
    least = {r.doc_id: r.keep_id for r in exact_dedup(df.unionByName(df.limit(1).selectExpr("-9223372036854775808 doc_id", "'a' text", "'x' keep_id", "0 n")), keep="min").collect()}
    assert least[1] == least[2] == -(2**63) and least[7] == least[8] == 7 and least[101] == 100
    named = df.withColumns({c: F.lit(c) for c in ("_id", "_sha", "_sha_own", "keep_sha", "Own_SHA")})
    got = drop_copies(named)
    assert got.columns == named.columns and got.count() == len(by) and {tuple(r)[4:] for r in got.collect()} == {("_id", "_sha", "_sha_own", "keep_sha", "Own_SHA")}


def test_exact_dedup_is_native(spark, sf_dir):
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(9), fan_in=2)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # Runs are merged in order at every level: 9, 5, 3, 2, 1 runs, each by a sort-based aggregation before and after its exchange.
    assert out._jdf.queryExecution().executedPlan().toString().count("SortAggregate(key=[digest") >= 5


def test_exact_dedup_by_any_fan_in(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(13)
    rows = [sorted(map(tuple, exact_dedup(docs, fan_in=n).collect())) for n in (2, 3, 16)]
    assert rows[0] == rows[1] == rows[2]


def test_url_rules_and_parts(spark):
    urls = ["http://a.net/", "http://net/x", "http://a.example.net/en/q", "http://example.net/en", "http://EXAMPLE.com/de/1?x", "http://x.org/fr/a#b", "http://a.net", "http://xnet/", None, "no scheme", "", "a://b://c/d", "http://h?q=/x", "http://h#f/", "http://h\n/p\nq?z", "http://a.net:80/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id int, url string, host string")
    got = {r.page_id: r for r in url_verdicts(df, URL_RULES).collect()}
    rule = lambda i: (got[i].rule, got[i].verdict)
    assert [rule(i) for i in range(6)] == [("net/", "block"), ("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert all(got[i].rule is None for i in range(6, 16))
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path) == parts(u)[:2]
        assert got[i].verdict in ("allow", "block")
    assert url_verdicts(df.limit(0), URL_RULES).count() == 0


def test_trees_generalise():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = BoostedTrees(trees=40).fit(x[:1500], y[:1500], np.ones(1500))
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    urls = labelled_urls(2000, seed=3)
    trees = train([(0.9, 10), (0.5, 2)])
    p = trees.predict(features([u for u, _ in urls], np.full(len(urls), 0.9)))
    y = np.array([y for _, y in urls])
    assert ((p > 0.5) == y).mean() > 0.93


def plain_features(url, suffix):
    host, path, rest = parts(url)
    whole = host + path + rest
    n, data = max(1, len(whole)), whole.encode()
    entropy = -sum(c / len(data) * np.log2(c / len(data)) for c in Counter(data).values()) if data else 0.0
    last = ".".join(host.split(".")[-2:])
    digits = lambda s: sum(c in "0123456789" for c in s)
    signs = sum(not (c.isascii() and c.isalnum()) for c in whole)
    return [len(url or ""), len(host), len(path), len(rest), path.count("/"), host.count("."), host.count("-"), digits(whole) / n, digits(host), entropy, rest.count("=") + rest.count("&"), float("#" in rest), float((url or "").startswith("https:")), signs / n, (url or "").count("%"), suffix, len(host) - len(last)]


ODD_URLS = [None, "", "x", "http://", "http://a", "https://É.com/é?x=é#q", "http://a.b.c.d/", "a://b\nc/d\n?e", "http://1.2.3.4/%20", "http://" + "long" * 30_000 + ".com/" + "p/" * 10_000]


def test_features_equal_a_plain_count():
    urls = ODD_URLS + [u for u, _ in labelled_urls(300)]
    got = features(urls, np.linspace(0, 1, len(urls)))
    assert got.shape[1] == len(FEATURES)
    assert np.allclose(got, [plain_features(u, s) for u, s in zip(urls, np.linspace(0, 1, len(urls)), strict=True)])


def test_url_query_against_brute_force(spark, sf_dir):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    got = {r.page_id: r for r in QUERIES["op8_url_filter"](spark, sf_dir).collect()}
    of = {i: ".".join(parts(u)[0].split(".")[-2:]) for i, u in rows}
    n = Counter(of.values())
    stat = lambda s: np.log1p(n[s]) / np.log1p(len(rows))
    trees = train([(stat(s), c) for s, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))])
    score = dict(zip([i for i, _ in rows], trees.predict(np.array([plain_features(u, stat(of[i])) for i, u in rows])), strict=True))
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, _ = parts(u)
        fits = sorted((len(h + p), h + p, said) for said, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p))
        rule, said = fits[-1][1:] if fits else (None, "block" if score[i] >= 0.5 else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, said) and abs(got[i].score - score[i]) < 1e-9


def test_pages_that_no_rule_decides(spark):
    """Rules teach nothing: ordinary pages pass on every suffix, spam-like hosts do not."""
    rows = [f"https://www.therre.example.com/en/{i}?page=2&ref=x" for i in range(40)] + [f"http://thther.example.org/en/{i}" for i in range(40)] + [f"http://blog.ththon.example.com/de/{i}" for i in range(40)]
    bad = ["https://www.cheap-pills.example.com/fr/176/", "http://m.adult-x.example.org/en/780#top", "http://10.20.30.40/x?a=1f9c77e0aa&b=99c0aa1f77&c=0f0f0f0faa&d=77aa77aa11"]
    df = spark.createDataFrame(list(enumerate(rows + bad)), "page_id int, url string")
    got = {r.page_id: r for r in url_verdicts(df, URL_RULES).collect()}
    assert [got[i].verdict for i in range(80)] == ["allow"] * 80 and all(got[i].rule is None for i in range(80))
    assert all(got[i].verdict == "block" for i in range(80, 123))
    again = {r.page_id: r.score for r in url_verdicts(df.where("page_id < 80 or page_id >= 120").unionByName(df.where("page_id < 3")), URL_RULES).collect()}
    assert all((again[i] >= 0.5) == (got[i].score >= 0.5) for i in range(80))
    odd = spark.createDataFrame(list(enumerate(ODD_URLS * 2)), "page_id int, url string")
    assert url_verdicts(odd, URL_RULES).count() == 2 * len(ODD_URLS)


def test_suffixes_are_counted_over_all_pages(spark, monkeypatch):
    from parlance.llm import url_filter

    trees = BoostedTrees()  # block where the suffix's statistic is above a half
    at = FEATURES.index("suffix")
    trees.edges, trees.bias = [np.array([0.5]) if f == at else np.array([]) for f in range(len(FEATURES))], 0.0
    trees.forest = [([(np.array([at]), np.array([0]))], np.array([-5.0, 5.0]))]
    monkeypatch.setattr(url_filter, "train", lambda *a: trees)
    urls = [f"http://a{i}.shop.test/{i}" for i in range(60)] + [f"http://www.example.net/en/{i}" for i in range(10)] + ["http://rare.test.one/"]
    got = url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), URL_RULES).collect()
    assert {r.page_id for r in got if r.score > 0.5} == set(range(70)) and len(got) == 71
    assert {r.verdict for r in got if r.page_id < 60} == {"block"}
