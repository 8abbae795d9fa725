import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parlance.llm.near_dedup import aligned, band_keys, drop_near_copies, labelled, near_classes, similarity


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def brute(x, y):
    a, b = labelled(x), labelled(y)
    m = lcs(a, b)
    return m / (len(a) + len(b) - m) if a and b else 0.0


def edited(rng, words, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append(f"n{rng.integers(1e6)}" if r < 2 * rate / 3 else w)
        if r > 1 - rate / 3:
            out.append(f"i{rng.integers(1e6)}")
    return out


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    texts, word = [], lambda: f"w{rng.integers(5000)}"
    for _ in range(60):
        base = [word() for _ in range(int(rng.integers(30, 300)))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            texts.append(" ".join(edited(rng, base, float(rng.choice([0.01, 0.03, 0.06])))))
    shared = " ".join(word() for _ in range(60))
    texts += [shared + " " + " ".join(word() for _ in range(60)) for _ in range(30)]  # a passage in many documents
    base = [word() for _ in range(120)]
    texts += [" ".join(base)] + [" ".join(edited(rng, base, 0.02)) for _ in range(60)]  # a large family
    texts += [texts[3]] * 40 + ["", "", None, "one two", "one two", "x " * 3000, "x " * 3001]
    return texts


def test_alignment_is_exact():
    texts = [t for t in corpus()[:40] if t]
    for i, x in enumerate(texts):
        for y in texts[i + 1 : i + 5]:
            want = brute(x, y)
            for t in (0.5, 0.8):
                got = aligned({g: k for k, g in enumerate(labelled(x))}, labelled(y), t)
                assert got == (want if want >= t else 0.0)
    assert similarity("a b c d e f", "a b c d e f") == 1.0


def test_classes_against_all_pairs(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(5)
    own = [t or "" for t in texts]
    parent = list(range(len(own)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    idx = [{g: k for k, g in enumerate(labelled(t))} for t in own]
    seq = [labelled(t) for t in own]
    for i in range(len(own)):
        for j in range(i):
            if own[i] == own[j] or aligned(idx[i], seq[j], 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in near_classes(df).collect()}
    assert {i: got[i].class_id for i in got} == {i: find(i) for i in range(len(own))}
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(own))})


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_classes(none).count() == 0
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "q"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_classes(df).count() == 5
    assert sorted(str(r.doc_id) for r in drop_near_copies(df).collect()) == ["1", "2", "None"]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"a b c d e f g {i // 2}") for i in range(6)], "doc_id long, text string")
    extra = ("_id", "_node", "_own", "own_sha", "Kept_Id", "kept_sha", "label")
    named = df.withColumns({c: F.lit(c) for c in extra})
    got = drop_near_copies(named)
    assert got.columns == named.columns and {tuple(r)[2:] for r in got.collect()} == {extra}


def test_recall_of_band_keys():
    rng = np.random.default_rng(5)
    hit = n = 0
    for _ in range(300):
        base = [f"w{rng.integers(9000)}" for _ in range(200)]
        x, y = " ".join(base), " ".join(edited(rng, base, 0.035))
        if 0.8 <= similarity(x, y) < 0.9:
            a, b = band_keys(pa.array([x, y]))
            n += 1
            hit += bool((a == b).any())
    assert n > 30 and hit == n


def one_bucket_families(seed=11, families=4):
    """(leader, its copies, x, y): x and y are near and share one or two bands, where a leader far from both leads."""
    rng = np.random.default_rng(seed)
    out, line = [], lambda w: " ".join(w)
    bands = lambda *w: [set(k.tolist()) for k in band_keys(pa.array([line(x) for x in w]), bands=4)]
    for _ in range(300):
        x = [f"w{rng.integers(1_000_000)}" for _ in range(100)]
        y = edited(rng, x, 0.05)
        kx, ky = bands(x, y)
        if not 1 <= len(kx & ky) <= 2 or similarity(line(x), line(y), 0.8) == 0:
            continue
        for _ in range(40):
            far = edited(rng, x, 0.12)
            if kx & ky <= bands(far)[0] and not similarity(line(far), line(x), 0.8) and not similarity(line(far), line(y), 0.8):
                copies = [far[:c] + [f"c{rng.integers(1_000_000)}"] + far[c + 1 :] for c in range(10, 90, 8)]
                near = [similarity(line(c), line(o), 0.8) for c in copies for o in (x, y)]
                if not any(near):
                    out.append((line(far), [line(c) for c in copies], line(x), line(y)))
                    break
        if len(out) == families:
            break
    assert len(out) == families
    return out


def test_pairs_with_one_common_band(spark):
    rows, want = [], {}
    for far, copies, x, y in one_bucket_families():
        first = len(rows)
        rows += [far, *copies, x, y]
        want.update({i: first for i in range(first, len(rows) - 2)} | {len(rows) - 2: len(rows) - 2, len(rows) - 1: len(rows) - 2})
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_classes(df, bands=4).collect()} == want


def test_one_row_stays_of_every_class_whatever_its_doc_id(spark):
    texts = ["a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z", "long ago and far away", "c1 c2 c3 c4 c5 c6", "c1 c2 c3 c4 c5 c6"]
    ids = [None, None, 5, 5, None, 5, 5]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in drop_near_copies(df).collect()) == sorted({(str(i), t) for i, t in zip(ids, texts, strict=True)})


def test_recall_of_band_keys_with_a_passage_added():
    rng = np.random.default_rng(7)
    pairs = []
    for _ in range(1500):
        base = [f"w{x}" for x in rng.integers(1_000_000, size=1000)]
        at = int(rng.integers(0, 1000))
        pairs += [" ".join(base), " ".join(base[:at] + [f"p{x}" for x in rng.integers(1_000_000, size=240)] + base[at:])]
    assert all(similarity(x, y, 0.8) for x, y in zip(pairs[:40:2], pairs[1:40:2], strict=True))
    keys = band_keys(pa.array(pairs))
    assert all((a == b).any() for a, b in zip(keys[::2], keys[1::2], strict=True))


def test_pairs_between_chunks_of_a_large_bucket(spark, monkeypatch):
    """Pivots against a component of many chunks: links found are those of all pairs."""
    from parlance.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CHUNK", 4)
    rng = np.random.default_rng(9)
    base = [f"w{rng.integers(5000)}" for _ in range(150)]
    texts = [" ".join(base)] + [" ".join(edited(rng, base, r)) for r in (0.02, 0.045, 0.06) for _ in range(25)]
    got = {r.doc_id: r.class_id for r in near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seq = [labelled(t) for t in texts]
    idx = [{g: k for k, g in enumerate(x)} for x in seq]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if aligned(idx[i], seq[j], 0.8):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in got} and len(set(got.values())) > 2


def test_query_against_all_pairs(spark, sf_dir):
    """The query's classes are the components of all pairs of 0.8 or more: recall and precision of 1."""
    from parlance.llm.queries import QUERIES

    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in QUERIES["op10_near_dedup"](spark, sf_dir).collect()}
    seq = {i: labelled(t) for i, t in rows}
    idx = {i: {g: k for k, g in enumerate(x)} for i, x in seq.items()}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    text = dict(rows)
    ids = sorted(parent)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if text[i] == text[j] or (idx[i] and seq[j] and not idx[i].keys().isdisjoint(seq[j]) and aligned(idx[i], seq[j], 0.8)):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in ids}
