"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

Features of a text: its words (runs without ASCII white space, lower-cased, outer punctuation and digits
stripped) and their first 4 to 7 letters, each with weight 1 + log(occurrences) / 2. Training takes a
bounded sample of labelled rows (``max_positive`` toxic and ``max_negative`` other rows, those of
smallest hash; whole texts). Executors count the sample's features; kept are those of at least two toxic
texts whose presence tells the classes apart (likelihood-ratio statistic of at least ``min_g2``, at least
``min_df`` texts); what reaches the driver is one sparse row of kept features per text. Logistic
regression is fitted there in numpy. Counterfactual regularisation: in every labelled text that names a
group, and in a list of neutral sentences (and hostile ones, made with the sample's most telling toxic
words), each identity term is swapped for every other one in turn, and squared changes of the score are
penalised with ``counterfactual``; so a mention of a group by itself does not raise the score. The score
is the logistic function of a sum over the text; labels, lang, source and doc_id never enter it.

Defined results: null text counts as empty and gets the score of no evidence; a doc_id labelled twice
counts with its larger label, null labels with none; repeated rows are judged alike; without labelled
rows of both classes every score is (nearly) 0; an empty table gives no rows; extra columns are ignored by
``toxicity`` and kept by ``drop_toxic``, whatever they are called.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from parlance.llm.common import fresh, ranges, save, ship, slices, strings, text_or_empty, words

#: Identity terms that are swapped for one another (singular with singular, plural with plural).
SINGULAR = ["muslim", "jewish", "christian", "hindu", "buddhist", "atheist", "black", "white", "asian", "african", "arab", "latino", "gay", "lesbian", "straight", "transgender", "disabled", "blind", "deaf", "elderly", "female", "male", "immigrant", "refugee"]
PLURAL = ["muslims", "jews", "christians", "hindus", "buddhists", "atheists", "africans", "asians", "arabs", "latinos", "gays", "lesbians", "women", "men", "immigrants", "refugees", "foreigners"]
GROUPS = {t: group for group in (SINGULAR, PLURAL) for t in group}
ROTATIONS = max(len(SINGULAR), len(PLURAL)) - 1
#: Neutral sentences with a place for an identity term, and hostile ones with a place for a toxic word too.
NEUTRAL = ["my neighbour is {s} and plays the piano", "the {s} community opened a new school", "{p} and their friends visited the museum", "a {s} teacher wrote this book", "many {p} live in this city"]
HOSTILE = ["all {p} are {x}", "you {x} {s} {x}"]
_STRIP = re.compile(r"^[\W\d_]+|[\W\d_]+$")
PREFIXES = (4, 5, 6, 7)


def features_of(word: str) -> list[str]:
    w = core(word)
    if not w:
        return []
    return ["=" + w, *(f"{n}{w[:n]}" for n in PREFIXES if len(w) > n)]


def core(word: str) -> str:
    return _STRIP.sub("", word.lower())


def word_counts(text: str) -> Counter:
    """Words as the scorer sees them: cut at ASCII white space only."""
    return Counter(w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split())


def counted(text: str) -> Counter:
    out: Counter = Counter()
    for w, n in word_counts(text).items():
        for f in features_of(w):
            out[f] += n
    return out


def weigh(n: int) -> float:
    return 1 + 0.5 * math.log(n) if n > 0 else 0.0


def observe(text: str, place: dict[str, int]) -> tuple[dict[int, float], list[dict[int, float]]]:
    """The text's kept features, and how they change under each swap of all its identity terms."""
    words_ = word_counts(text)
    bag: Counter = Counter()
    named: Counter = Counter()
    for w, n in words_.items():
        for f in features_of(w):
            if f in place:
                bag[f] += n
        if core(w) in GROUPS:
            named[core(w)] += n
    changes = []
    for k in range(1, ROTATIONS + 1) if named else ():
        after: Counter = Counter()
        for t, n in named.items():
            group = GROUPS[t]
            other = group[(group.index(t) + k) % len(group)]
            for f in features_of(t):
                after[f] -= n
            for f in features_of(other):
                after[f] += n
        change = {place[f]: weigh(bag[f]) - weigh(bag[f] + d) for f, d in after.items() if d and f in place}
        if change:
            changes.append(change)
    return {place[f]: weigh(n) for f, n in bag.items()}, changes


def places(telling: list[str]) -> dict[str, int]:
    """Numbers of the kept features: those that tell the classes apart, and those of identity terms."""
    return {f: i for i, f in enumerate(sorted(set(telling) | {f for t in GROUPS for f in features_of(t)}))}


def g2(a: float, b: float, n: np.ndarray) -> float:
    """Likelihood-ratio statistic of a feature in ``a`` toxic and ``b`` other of n[1] and n[0] texts."""
    obs = np.array([[a, b], [n[1] - a, n[0] - b]])
    exp = obs.sum(axis=1, keepdims=True) * obs.sum(axis=0, keepdims=True) / n.sum()
    return float(2 * (obs * np.log(np.maximum(obs, 1e-12) / np.maximum(exp, 1e-12))).sum())


def choose(counts: list[tuple[str, int, int]], n: np.ndarray, min_g2: float, min_df: int) -> tuple[list[str], list[str]]:
    """(kept features, the most telling toxic words) of (feature, toxic texts, other texts)."""
    scored = sorted((-s, f) for f, a, b in counts if a >= 2 and a + b >= min_df and (s := g2(a, b, n)) >= min_g2)
    rate = {f: (a / n[1], b / n[0]) for f, a, b in counts}
    toxic = [f[1:] for _, f in scored if f[0] == "=" and rate[f][0] > rate[f][1] and f[1:] not in GROUPS][:5]
    return [f for _, f in scored], toxic


def sentences(toxic: list[str]) -> list[tuple[str, int]]:
    """The labelled sentences, for every pair of identity terms."""
    forms = [(t, 0) for t in NEUTRAL] + [(t.replace("{x}", x), 1) for t in HOSTILE for x in toxic]
    return [(t.format(s=s, p=p), y) for t, y in forms for s, p in zip(SINGULAR, PLURAL, strict=False)]


def descend(seen: list[tuple[int, dict[int, float], list[dict[int, float]]]], made: list[tuple[int, dict[int, float], list[dict[int, float]]]], size: int, counterfactual: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, features, changes) of real texts and of made sentences."""
    rows = seen + made

    def sparse(bags):
        n = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))
        flat = lambda part, kind: np.fromiter((x for b in bags for x in part(b)), dtype=kind, count=int(n.sum()))
        return np.repeat(np.arange(len(bags)), n), flat(dict.keys, np.int64), flat(dict.values, float)

    r, c, v = sparse([b for _, b, _ in rows])
    pr, pc_, pv = sparse([d for _, _, ds in rows for d in ds])
    pairs = sum(len(ds) for _, _, ds in rows)
    y = np.array([y for y, _, _ in rows], float)
    weight = np.r_[np.ones(len(seen)), np.full(len(made), 0.05)]
    w, b = np.zeros(size), float(np.log(sum(y[: len(seen)]) / (len(seen) - sum(y[: len(seen)]))))
    m, s = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(r, weights=v * w[c], minlength=len(rows)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / weight.sum()
        change = np.bincount(pr, weights=pv * w[pc_], minlength=pairs) * (2 * counterfactual / max(1, pairs))
        grad = np.r_[np.bincount(c, weights=v * g[r], minlength=size) + np.bincount(pc_, weights=pv * change[pr], minlength=size) + l2 * w, g.sum()]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        delta = 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w, b = w - delta[:-1], b - delta[-1]
    return w, float(b)


NO_MODEL: tuple[dict[str, float], float] = ({}, -1000.0)


def fit(rows: list[tuple[str, int]], counterfactual: float = 5.0, l2: float = 5e-5, min_g2: float = 14.0, min_df: int = 4, steps: int = 400) -> tuple[dict[str, float], float]:
    """Weights by feature and the bias, from texts in memory."""
    n = np.array([sum(y == c for _, y in rows) for c in (0, 1)], float)
    if not n.all():
        return NO_MODEL
    by = [Counter(f for t, y in rows if y == c for f in counted(t)) for c in (0, 1)]
    telling, toxic = choose([(f, a, by[0][f]) for f, a in by[1].items()], n, min_g2, min_df)
    place = places(telling)
    seen, made = ([(y, *observe(t, place)) for t, y in part] for part in (rows, sentences(toxic)))
    w, b = descend(seen, made, len(place), counterfactual, l2, steps)
    return {f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-6}, b


class Scorer:
    """Scores Arrow string arrays; only words that hold a weighted feature are counted."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.place = {f: i for i, f in enumerate(weights)}
        self.w = np.array(list(weights.values()), float)
        self.bias = bias
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: pa.Array) -> np.ndarray:
        distinct, code, counts = words(texts)
        if len(self.memo) > 250_000:
            self.memo.clear()
        memo, place, held = self.memo, self.place, []
        for word in distinct.to_pylist():
            got = memo.get(word)
            if got is None:
                got = memo[word] = tuple(place[f] for f in features_of(word) if f in place)
            held.append(got)
        n = np.fromiter(map(len, held), dtype=np.int64, count=len(held))
        flat = np.fromiter((f for h in held for f in h), dtype=np.int64, count=int(n.sum()))
        start = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(counts)), counts)
        useful = n[code] > 0
        code, doc = code[useful], doc[useful]
        feature, doc = flat[ranges(start[code], n[code])], np.repeat(doc, n[code])
        key, times = np.unique(doc * max(1, len(self.w)) + feature, return_counts=True)
        z = np.bincount(key // max(1, len(self.w)), weights=(1 + 0.5 * np.log(times)) * self.w[key % max(1, len(self.w))], minlength=len(counts)) if len(key) else np.zeros(len(counts))
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -700, 700)))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_sample(docs: DataFrame, labels: DataFrame, max_positive: int = 1500, max_negative: int = 4500) -> DataFrame:
    """A bounded sample of labelled texts (doc_id, text, y), none of them held out."""
    y = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y")).where(~held_out())
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = y.where("y = 1").orderBy(*by_hash).limit(max_positive).unionByName(y.where("y = 0").orderBy(*by_hash).limit(max_negative))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = own.join(F.broadcast(picked), "doc_id")  # at most max_positive + max_negative ids
    # Of an id's rows the one with the smallest hash: repeated ids add no rows.
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", F.col("t.text").alias("text"), "y")


def train(docs: DataFrame, labels: DataFrame, counterfactual: float = 5.0, l2: float = 5e-5, min_g2: float = 14.0, min_df: int = 4, steps: int = 400, **how) -> tuple[dict[str, float], float]:
    """As ``fit``, from tables: texts stay on the executors."""
    spark = docs.sparkSession
    ship(spark)
    sample = save(spark, training_sample(docs, labels, **how), "training")
    by = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n = np.array([by.get(0, 0), by.get(1, 0)], float)
    if not n.all():
        return NO_MODEL

    def features(batches):
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = list(counted(text))
                yield pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.string()), "y": pa.array([y] * len(found), pa.int32())})

    found = sample.select("y", "text").mapInArrow(features, "feature string, y int").groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    telling, toxic = choose([tuple(r) for r in found.where((F.col("a") >= 2) & (F.col("a") + F.col("b") >= min_df)).collect()], n, min_g2, min_df)
    place = places(telling)
    held = spark.sparkContext.broadcast(place)

    def rows(batches):
        for batch in batches:
            for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"row": [pickle.dumps((y, *observe(text, held.value)))]})

    got = sample.select("y", "text").mapInArrow(rows, "row binary").collect()
    seen = [pickle.loads(x) for x in sorted(bytes(r.row) for r in got)]
    w, b = descend(seen, [(y, *observe(t, place)) for t, y in sentences(toxic)], len(place), counterfactual, l2, steps)
    return {f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-6}, b


def score_column(docs: DataFrame, scorer: tuple[dict[str, float], float], keep: list[str]) -> tuple[DataFrame, str]:
    """``keep`` columns of ``docs`` and the score of ``text``, under a name that no column has."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    score, scored = fresh(docs, "score", "scored_text")
    schema = docs.select(*keep).schema

    def run(batches):
        judge = Scorer(*held.value)
        for batch in batches:
            for part in slices(batch, scored, 8_000_000):
                value = judge(strings(part.column(scored)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(value)], names=[*keep, score])

    out = docs.select(*keep, text_or_empty().alias(scored)).mapInArrow(run, StructType([*schema.fields, StructField(score, DoubleType())]))
    return out, score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, **how)
    out, score = score_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows below the threshold, with all their columns, whatever those are called."""
    model = train(docs, labels, **how)
    out, score = score_column(docs, model, docs.columns)
    return out.where(F.col(score) < threshold).drop(score)
