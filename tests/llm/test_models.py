import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from parlance.llm import hpylm, pii, toxicity
from parlance.llm.pieces import PieceEncoder, decode, encode, round_trip
from parlance.llm.queries import QUERIES

ODD = ["", "a  b", "  x", "tab\t x\x0b\x0cy", "İ ﬁ é", "▁ lit▁eral", "日本語 テスト a😀", None, "A b\nA", "x\x1cy", "q" * 4000, "w " * 5000]


def odd(spark):
    return spark.createDataFrame([(None if i == 2 else i % 9, t, True, 1.0) for i, t in enumerate(ODD)], "doc_id long, text string, held_out boolean, score double").repartition(3)


# --- language model -------------------------------------------------------------------------------


def test_stirling_and_gibbs_draws_match_enumeration():
    d, theta, parent, others = 0.6, 1.5, 0.2, 7.0
    table = hpylm.stirling(d, 8)

    def seatings(c):  # weights of all seatings of c customers, by number of tables
        out = Counter({((1,)): 1.0})
        for _ in range(c - 1):
            nxt = Counter()
            for s, w in out.items():
                for k in range(len(s)):
                    t = list(s)
                    t[k] += 1
                    nxt[tuple(t)] += w * (s[k] - d)
                nxt[s + (1,)] += w
            out = nxt
        by = Counter()
        for s, w in out.items():
            by[len(s)] += w
        return by

    for c in range(1, 8):
        by = seatings(c)
        assert np.allclose([math.exp(table[c, t]) for t in range(1, c + 1)], [by[t] for t in range(1, c + 1)])
    c, rng = 6, np.random.default_rng(0)
    n = 60_000
    got = np.ones(n, int)
    for _ in range(12):  # latent value and tables in turn
        x = hpylm.decoded(hpylm.coded(hpylm.latent(rng, others + got, d, theta)))
        got = hpylm.draw_tables(rng, np.full(n, c), d * x * parent, d, hpylm.stirling(d))
    by = seatings(c)
    want = np.array([by[t] * parent**t * math.prod(theta + d * (others + j) for j in range(t)) for t in range(1, c + 1)])
    assert np.allclose(np.bincount(got, minlength=c + 1)[1:] / n, want / want.sum(), atol=0.01)


def test_dishes_of_a_restaurant_follow_their_joint_law():
    """Two dishes drawn side by side, given the restaurant's latent value, against all pairs of table numbers."""
    d, theta, n, rng = 0.55, 0.8, 60_000, np.random.default_rng(4)
    c, parent = (5, 7), (0.3, 0.05)
    table = hpylm.stirling(d)
    want = np.zeros((c[0] + 1, c[1] + 1))
    for a in range(1, c[0] + 1):
        for b in range(1, c[1] + 1):
            want[a, b] = math.exp(table[c[0], a] + table[c[1], b]) * parent[0] ** a * parent[1] ** b * math.prod(theta + d * i for i in range(a + b))
    t = np.ones((2, n), int)
    for _ in range(15):
        x = hpylm.decoded(hpylm.coded(hpylm.latent(rng, t.sum(axis=0), d, theta)))
        t = np.stack([hpylm.draw_tables(rng, np.full(n, c[k]), d * x * parent[k], d, table) for k in (0, 1)])
    have = np.zeros_like(want)
    np.add.at(have, (t[0], t[1]), 1 / n)
    assert np.abs(have - want / want.sum()).max() < 0.006
    dependent = want / want.sum() - np.outer(want.sum(axis=1), want.sum(axis=0)) / want.sum() ** 2
    assert np.abs(dependent).max() > 0.012  # more than the test's tolerance: the law is not that of independent dishes


def test_large_dishes_follow_the_exact_conditional():
    rng = np.random.default_rng(0)
    for d in (0.3, 0.7, 0.9):
        exact = hpylm.stirling(d, 1300)
        t = np.arange(1, 1301)
        assert np.abs(hpylm.log_stirling(np.array([1300]), t[None], d)[0] - exact[1300, 1:]).max() < 0.01
        for parent, others in ((0.3, 5.0), (1e-4, 1000.0), (0.2, 2000.0)):
            weight = d * parent * (others + 1.0 / d)
            log = exact[1300, 1:] + t * np.log(weight)
            p = np.exp(log - log.max())
            p /= p.sum()
            n = 4000
            got = hpylm.draw_tables(rng, np.full(n, 1300), np.full(n, weight), d, hpylm.stirling(d))
            have = np.bincount(got, minlength=1301)[1:] / n
            assert np.abs(have.cumsum() - p.cumsum()).max() < 0.04


def plain_model(rows, sweeps, seed=0, theta=1.0):
    """The model on a list of rows: Gibbs over explicit seatings, customer by customer; averaged scores."""
    import random

    rng = random.Random(seed)
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    train = [list(zip(["START", *w], w, strict=False)) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in [tokens(t)]]
    pairs = Counter(p for x in train for p in x)
    vocabulary = {w for _, w in pairs}
    ones = lambda c: (sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()))
    discount = lambda a, b: min(0.9, max(0.05, a / (a + 2 * b))) if a else 0.5
    d2, d1 = discount(*ones(pairs)), discount(*ones(Counter(w for _, w in pairs)))
    tables = {p: [n] for p, n in pairs.items()}  # sizes of the tables of a dish
    root = {w: [sum(1 for p in pairs if p[1] == w)] for w in vocabulary}  # customers of the root's tables
    n_c = Counter()
    for (c, _), n in pairs.items():
        n_c[c] += n
    per_context = Counter(c for c, _ in pairs)
    root_n, root_t = len(pairs), len(vocabulary)

    def p_root(w):
        held = root.get(w, [])
        return (max(sum(held) - d1 * len(held), 0) + (theta + d1 * root_t) / (len(vocabulary) + 1)) / (theta + root_n)

    def choose(weights):
        x = rng.random() * sum(weights)
        for k, v in enumerate(weights):
            x -= v
            if x < 0:
                return k
        return len(weights) - 1

    total = Counter()
    for sweep in range(1, sweeps + 1):
        for (c, w), n in pairs.items():
            for _ in range(n):
                held = tables[c, w]
                k = choose(held)
                held[k] -= 1
                if not held[k]:
                    held.pop(k)
                    per_context[c] -= 1
                    r = root[w]
                    j = choose(r)
                    r[j] -= 1
                    root_n -= 1
                    if not r[j]:
                        r.pop(j)
                        root_t -= 1
                k = choose([*(x - d2 for x in held), (theta + d2 * per_context[c]) * p_root(w)])
                if k < len(held):
                    held[k] += 1
                    continue
                held.append(1)
                per_context[c] += 1
                r = root[w]
                j = choose([*(x - d1 for x in r), (theta + d1 * root_t) / (len(vocabulary) + 1)])
                if j < len(r):
                    r[j] += 1
                else:
                    r.append(1)
                    root_t += 1
                root_n += 1
        if sweep > sweeps // 3:
            for c, w in {p for _, t in rows for p in zip(["START", *tokens(t)], tokens(t), strict=False)}:
                held = tables.get((c, w), [])
                total[c, w] += (max(sum(held) - d2 * len(held), 0) + (theta + d2 * per_context[c]) * p_root(w)) / (theta + n_c[c])
    kept = sweeps - sweeps // 3
    return {i: sum(math.log10(total[p] / kept) for p in zip(["START", *tokens(t)], tokens(t), strict=False)) for i, t in rows}


def test_scores_equal_customer_by_customer_gibbs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{min(rng.geometric(0.15), 25)}" for _ in range(int(rng.integers(3, 30))))) for i in range(60)]
    want = plain_model(rows, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in hpylm.lm_scores(docs, sweeps=30, burn_in=6, cell_tokens=300).collect()}
    assert max(abs(got[i] - want[i]) / max(1.0, abs(want[i])) for i in want) < 0.03
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.01


def test_predictive_sums_to_one():
    rng = np.random.default_rng(1)
    v = 30
    count = rng.integers(1, 9, v)
    tables = np.array([rng.integers(1, c + 1) for c in count])
    root_customers = tables + rng.integers(0, 3, v)
    root_tables = np.minimum(root_customers, 2)
    model = hpylm.Model(int(count.sum()), v, 0.5, 0.7, 1.0, 1.0, 3)
    model.root.append((float(root_customers.sum()), float(root_tables.sum())))
    root = np.append(model.root_p(0, root_customers, root_tables), model.root_p(0, np.zeros(1), np.zeros(1)))
    assert abs(root.sum() - 1) < 1e-12
    p = model.predict(np.append(count, 0), np.append(tables, 0), root, np.full(v + 1, count.sum()), np.full(v + 1, tables.sum()))
    assert abs(p.sum() - 1) < 1e-12


def test_grid_does_not_change_scores(spark):
    """Counts and base scores are those of the whole corpus whatever the grid and the batches; nothing hot stays whole."""
    rng = np.random.default_rng(2)
    rows = [(i, "the " * int(rng.integers(1, 40)) + " ".join(f"x{rng.integers(30)}" for _ in range(20))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for how in ({"cell_tokens": 100}, {"cell_tokens": 10**9}, {"batch_rows": 3, "cell_tokens": 500}):
        got = hpylm.lm_scores(docs, sweeps=2, burn_in=0, **how).collect()
        same_base(got, rows)
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")  # fewer buckets than cells
    try:
        same_base(hpylm.lm_scores(docs, sweeps=2, burn_in=0, cell_tokens=100).collect(), rows)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    parts = [pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b a b", "a b c"], "out": [False, True]})]
    own, cells = hpylm.batch_cells(parts[0], hpylm.Grid(3))
    assert sum(len(hpylm.unpack(d)["context"]) for _, d in cells) == 6 and len(hpylm.unpack(own)["docs"]) == 9


def lm_base(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, t in rows]


def same_base(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))
    a = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for x, y in zip(a, sorted(lm_base(rows), key=key), strict=True):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) <= 1e-9 * max(1, abs(y[5]))


def test_lm_on_documents(spark, sf_dir):
    got = QUERIES["op2_lm_scores"](spark, sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    same_base(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in QUERIES["op2_lm_scores"](spark, sf_dir).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_lm_edges(spark):
    docs = odd(spark)
    same_base(hpylm.lm_scores(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert hpylm.lm_scores(docs.limit(0)).count() == 0
    only = docs.where("doc_id = 1")
    assert all(zlib.crc32(b"1") % 5 != 1 or r.train_tokens == 0 for r in hpylm.lm_scores(only).collect())


# --- pieces ---------------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(request):
    import pyarrow.parquet as pq

    return [t or "" for t in ODD] + pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()[:60]


def test_pieces_equal_the_library_without_dropout(texts):
    lib, enc = sentencepiece.SentencePieceProcessor(model_file=MODEL), PieceEncoder(MODEL, 0.0, 1)
    ids, n = enc.encode_keyed(pa.array(texts), np.arange(len(texts)))
    cut = np.r_[0, np.cumsum(n)]
    for i, t in enumerate(texts):
        got = ids[cut[i] : cut[i + 1]].tolist()
        assert enc.decode(got) == t
        if "▁" not in t:
            assert got == lib.encode(t)


def test_pieces_dropout_varies_and_is_lossless(texts):
    enc = PieceEncoder(MODEL, 0.3, 5)
    seen = set()
    for key in range(6):
        ids, n = enc.encode_keyed(pa.array(texts), np.full(len(texts), key))
        cut = np.r_[0, np.cumsum(n)]
        assert [enc.decode(ids[a:b].tolist()) for a, b in itertools.pairwise(cut)] == texts
        seen.add(ids.tobytes())
    assert len(seen) == 6
    # Equal words draw anew at every place: most places of a common word are not all encoded alike.
    ids, n = enc.encode_keyed(pa.array(["information " * 400]), np.array([1]))
    cut = np.flatnonzero(np.isin(ids, [i for i, p in enumerate(enc.decoded) if p[:1] == b" "]))
    assert len({tuple(x) for x in np.split(ids, cut)}) > 8


def agenda(text, key, enc):
    """Plain agenda over one part: the best candidate first, leftmost on ties, each drawn by its span."""
    symbols = [[c if c != "▁" else None, 1] for c in text.replace(" ", "▁")]
    symbols = [["▁" if t == " " else s, n] for (s, n), t in zip(symbols, text, strict=True)]
    places, gone = list(range(len(text))), set()
    while True:
        options = []
        for k in range(len(symbols) - 1):
            (a, n), (b, m) = symbols[k], symbols[k + 1]
            if a and b and a + b in enc.rank and (places[k], places[k + 1], n + m) not in gone:
                options.append((enc.rank[a + b], places[k], k))
        if not options:
            break
        _, _, k = min(options)
        (a, n), (b, m) = symbols[k], symbols[k + 1]
        i, j = places[k], places[k + 1]
        mask = (1 << 64) - 1
        h = ((key ^ (i * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + n + m) & mask) * 0xBF58476D1CE4E5B9) & mask
        if (((h ^ (h >> 31)) * 0x94D049BB133111EB) & mask) < enc.limit:
            gone.add((i, j, n + m))
            continue
        symbols[k : k + 2], places[k : k + 2] = [[a + b, n + m]], [i]
    out = []
    for (s, _), i in zip(symbols, places, strict=True):
        out += [enc.ids[s]] if s in enc.ids else [enc.byte_id[b] for b in text[i].encode()]
    return out


class TiedModel:
    """Pieces of which several have one score, with ids against their places in texts."""

    PIECES = [*(f"<0x{b:02X}>" for b in range(256)), "bb", "ba", "ab", "aa", "aba", "▁b", "▁a", "▁", "a", "b"]

    def get_piece_size(self):
        return len(self.PIECES)

    def id_to_piece(self, i):
        return self.PIECES[i]

    def is_byte(self, i):
        return i < 256

    def is_control(self, i):
        return False

    is_unknown = is_unused = is_control

    def get_score(self, i):
        return -2.0 if self.PIECES[i] == "aba" else -1.0 if len(self.PIECES[i]) == 2 else -9.0


@pytest.mark.parametrize("rate", [0.0, 0.4])
def test_pieces_of_equal_score_go_leftmost_first(monkeypatch, rate):
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: TiedModel())
    enc, rng = PieceEncoder("tied", rate, 1), random.Random(3)
    parts = sorted({" " + "".join(rng.choice("abbaé") for _ in range(rng.randint(1, 40))) for _ in range(300)})
    code = np.array([rng.randrange(len(parts)) for _ in range(900)])
    key = np.array([rng.getrandbits(64) for _ in code], dtype=np.uint64)
    ids, start, length = enc.encode_parts(parts, code, key)
    for c, k, a, n in zip(code.tolist(), key.tolist(), start.tolist(), length.tolist(), strict=True):
        assert ids[a : a + n].tolist() == enc.part(parts[c], k)


def test_pieces_query_against_a_plain_agenda(spark, sf_dir):
    enc = PieceEncoder(MODEL, 0.1, 1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy(F.length("text")).limit(120).collect()
    got = {r.doc_id: r for r in QUERIES["op3_pieces"](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(r.lossless for r in got.values())
    for r in docs:
        ids = []
        for place, part in enumerate(re.findall(r" *[^ ]+| +", " " + r.text) if r.text else []):
            key = int(enc.keys(np.array([r.doc_id]), np.array([place]))[0])
            ids += agenda(part, key, enc)
            assert enc.part(part, key) == ids[len(ids) - len(agenda(part, key, enc)) :]
        raw = np.array(ids, dtype="<u4").tobytes()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (len(ids), zlib.crc32(raw))


def test_pieces_frames(spark):
    docs = odd(spark)
    back = decode(encode(docs, MODEL, 0.2), MODEL).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    got = round_trip(docs, MODEL).collect()
    assert len(got) == len(ODD) and all(r.lossless for r in got)
    assert round_trip(docs.limit(0), MODEL).count() == 0


# --- toxicity -------------------------------------------------------------------------------------


def test_toxicity_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    tp = sum(got[i].predicted and labels[i] for i in held)
    assert tp >= 0.6 * sum(labels[i] for i in held)
    assert sum(got[i].predicted and not labels[i] for i in held) <= 0.03 * len(held)


def test_counterfactual_penalty_frees_neutral_mentions():
    rng = np.random.default_rng(0)
    filler = lambda: " ".join(f"w{rng.integers(50)}" for _ in range(12))
    rows = [(f"{filler()} muslim {filler()} idiot", 1) for _ in range(80)] + [(f"{filler()} idiot {filler()}", 1) for _ in range(20)] + [(filler(), 0) for _ in range(300)]
    plain, fair = toxicity.fit(rows, counterfactual=0.0), toxicity.fit(rows, counterfactual=20.0)
    text = pa.array(["my neighbour is muslim and kind", "my neighbour is hindu and kind", "you idiot"])
    a, b = toxicity.Scorer(*plain)(text), toxicity.Scorer(*fair)(text)
    assert a[0] > 3 * b[0] and b[0] < 0.1 and abs(b[0] - b[1]) < abs(a[0] - a[1]) / 3 and b[2] > 0.5


def test_training_from_tables_equals_training_from_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.text, r.y) for r in toxicity.training_sample(docs, labels).collect()]
    (a, bias), (b, other) = toxicity.train(docs, labels, min_g2=6.0), toxicity.fit(rows, min_g2=6.0)
    assert abs(bias - other) < 1e-3 and {f for f, w in a.items() if abs(w) > 0.05} == {f for f, w in b.items() if abs(w) > 0.05}
    texts = pa.array([t for t, _ in rows])
    assert np.abs(toxicity.Scorer(a, bias)(texts) - toxicity.Scorer(b, other)(texts)).max() < 1e-3


def test_toxicity_against_a_plain_sum(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    weights, bias = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, sf).collect()}
    for r in docs.collect():
        n = Counter(f for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") for f in toxicity.features_of(w))
        z = bias + sum(weights[f] * (1 + math.log(k) / 2) for f, k in n.items() if f in weights)
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-z))) < 1e-6
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)


def test_one_word_splitter():
    assert set(toxicity.word_counts("a\u00a0b c\x0bd\x1ce")) == {"a\u00a0b", "c", "d\x1ce"}
    bag, changes = toxicity.observe("Muslims met men", toxicity.places(["=met"]))
    assert len(changes) == toxicity.ROTATIONS - toxicity.ROTATIONS // len(toxicity.PLURAL) and len(bag) > 1


def test_toxicity_edges(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(0, 1), (0, None), (1, 0), (4, 0), (None, 1), (5, 1), (6, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(ODD)
    assert toxicity.toxicity(docs, labels.limit(0)).where("score > 1e-9").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns
    named = docs.withColumns({c: F.lit("x") for c in ("_score", "_scored", "SCORE_", "scored_text")})
    kept = toxicity.drop_toxic(named, labels.limit(0))
    assert kept.columns == named.columns and kept.where("_score = 'x' and scored_text = 'x'").count() == kept.count() > 0


# --- personal data --------------------------------------------------------------------------------


def brute_base(text):
    out = [("email", *m.span()) for m in pii.EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in pii.CARD.finditer(text) if 13 <= len(pii.digits_of(m[0])) <= 19 and pii.luhn(pii.digits_of(m[0]))]
    return out + [("phone", *m.span()) for m in pii.PHONE.finditer(text) if 9 <= len(pii.digits_of(m[0])) <= 15]


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(2)
    pool = list("aB1290.@+-_% ()\n#é")
    for _ in range(3000):
        t = "".join(rng.choice(pool, int(rng.integers(0, 60))))
        assert pii.base_spans(t) == brute_base(t)
    for t in ("4111 1111 1111 1111", "+1 (017) 555-7713 190.1.2.3", "a@b.c_x@y.z", "x" * 300_000 + "@a.b", "1" * 200_000, "00000000000000000000001.2.3.4"):
        assert pii.base_spans(t) == (brute_base(t) if len(t) < 1000 else pii.base_spans(t))


def test_gradients_of_the_tagger():
    m = pii.Tagger(hidden=3)
    x, y = pii.labelled_windows(3, 5)
    x, y = x[:, :12].T, y[:, :12].T
    _, g = m.gradients(x, y)
    rng = np.random.default_rng(0)
    for k, p in m.p.items():
        for _ in range(5):
            i = tuple(int(rng.integers(n)) for n in p.shape)
            old = p[i]
            p[i] = old + 1e-5
            up = m.gradients(x, y)[0]
            p[i] = old - 1e-5
            down = m.gradients(x, y)[0]
            p[i] = old
            assert abs((up - down) / 2e-5 - g[k][i]) < 1e-7


def test_tagger_finds_what_the_patterns_miss():
    tagger = pii.trained()
    x, y = pii.labelled_windows(300, 99)
    tags = tagger.decode(x.T).T
    assert (tags == y).mean() > 0.96
    base, added = pii.spans_of(tagger, ["please call (017) 555-7713 now or write", "nothing here", "Version 2.0 of 2024"])
    assert base == [[], [], []] and [k for k, _, _ in added[0]] == ["phone"] and added[1:] == [[], []]


def test_windows_left_out_change_nothing(sf_dir):
    import pyarrow.parquet as pq

    tagger, rng = pii.trained(), np.random.default_rng(4)
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()[:40] + [t or "" for t in ODD]
    texts += ["call (017) 555-7713 " * 40, "x" * 500 + " a.very" + "long" * 60 + "@ mail" + "host" * 50 + ".example.com " + "y" * 300, "١٢.٣.٤.٥", "0" * 5000 + ".0.0.0"]
    texts += ["".join(rng.choice(list("ab 12.@-+()/é\n"), int(rng.integers(0, 900)))) for _ in range(60)]
    assert pii.spans_of(tagger, texts) == pii.spans_of(tagger, texts, every=True)


def test_quads_of_any_length(spark):
    texts = ["0" * 5000 + ".0.0.0", "1" + "0" * 5000 + ".0.0.0", "1.2.3." + "9" * 5000]
    got = sorted((r.doc_id, r.n_ip) for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == [(0, 1), (1, 0), (2, 0)]
    assert pii.redact(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).first().text == "[IP]"


def test_added_spans_are_valid_and_apart_from_base_spans(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op5_pii"](spark, sf).collect():
        t = text[r.doc_id]
        base = brute_base(t)
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        added = [x for x in spans if x not in base]
        assert len(added) == r.n_added and len(spans) == len(base) + len(added)
        assert all(pii.accept(k, t[a:b]) and not any(a < e and s < b for _, s, e in base) for k, a, b in added)
    found = pii.tagged_spans(pii.trained(), ["nothing of the kind"])
    assert found == [[]]


def test_pii_frames(spark, sf_dir):
    docs = odd(spark).unionByName(spark.createDataFrame([(50, "mail a.b@c.de, ip 1.2.3.4 and 4111111111111111 +49 (30) 123-4567", False, 0.0)], "doc_id long, text string, held_out boolean, score double"))
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert (got[50].n_email, got[50].n_ip, got[50].n_card, got[50].n_phone) == (1, 1, 1, 1)
    assert pii.redact(docs).columns == docs.columns
    assert next(r.text for r in pii.redact(docs).collect() if r.doc_id == 50) == "mail [EMAIL], ip [IP] and [CARD] [PHONE]"
    assert pii.find_pii(docs.limit(0)).count() == 0
    found = QUERIES["op5_pii"](spark, sf_dir).collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    import hashlib

    for r in found:
        own = brute_base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(own).encode()).hexdigest()
        assert r.n_email == sum(k == "email" for k, _, _ in own)
        assert set(pii.joined(own).split(",")) <= set(r.spans.split(",")) or not own


def test_a_labelled_id_of_many_rows_is_one_row_of_the_sample(spark):
    many = spark.range(100_000).select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("rude words "), F.col("id") % 7).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(1, "calm"), (4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 0)], "doc_id long, toxic int")
    got = toxicity.training_sample(docs, labels).collect()
    assert len({r.doc_id for r in got}) == len(got) <= 3 and {r.doc_id for r in got} >= {1}
    assert sorted(got) == sorted(toxicity.training_sample(docs.repartition(7), labels).collect())


def test_many_long_texts_in_one_batch_are_tagged_in_bounded_memory():
    """1,000 texts of 120 kB: the tagging's arrays are a slice's, not the batch's."""
    import tracemalloc

    from parlance.llm.common import slices

    text = ("call (555) 123-4567 now or mail a.b@example.com, " + "words and more words " * 40) * 140
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": [text] * 1000})
    assert len(text) > 115_000
    tagger, parts = pii.trained(), slices(batch, "text", pii.SLICE)
    tracemalloc.start()
    seen = 0
    for _, part in zip(range(3), parts, strict=False):
        base, added = pii.spans_of(tagger, part.column("text").to_pylist())
        seen += part.num_rows
        assert all(len(b) >= 140 for b in base) and base[0] == base[-1] and added[0] == added[-1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen < 120 and peak < 500e6
