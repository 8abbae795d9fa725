"""URL filters: host/path rules first, gradient-boosted trees on lexical features for the rest.

Rules are matched with built-in functions. The trees (second-order logistic boosting on histograms,
numpy) are trained on the driver from labelled urls: a seeded list of ``labelled`` urls (a parameter), half
of them of the make of spam (hyphenated or digit-ridden hosts, bare addresses, deep or hex paths, heavy
queries, escapes), half ordinary. Nothing in it comes from the rules, and no feature names a host, a
suffix or a word, so what the rules decide cannot leak into verdicts on other pages. Features: lengths,
depth, digit and punctuation ratios, entropy, parameter counts, and how common the host's suffix is among
all rows of the table (counted over all of them). Labelled urls get the statistics of the table's 256
commonest suffixes by their share; half of the spam gets that of a suffix seen once.

Defined results: null urls and urls without ``://`` have empty host and path, no rule, and the trees'
verdict on the empty url; repeated rows are judged alike; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import save, ship, strings

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits, else nulls."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def labelled_urls(n: int = 4000, seed: int = 17) -> list[tuple[str, int]]:
    """(url, 1 for spam or 0 for ordinary), half of each."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda a=3, b=9: "".join(pick("aeiou" if i % 2 else "bcdfghjklmnprstvwyz") for i in range(rng.randint(a, b)))
    digits = lambda a, b: "".join(pick("0123456789") for _ in range(rng.randint(a, b)))
    code = lambda a, b: "".join(pick("0123456789abcdefABCDEFghijkXYZ") for _ in range(rng.randint(a, b)))
    tail = lambda: pick([".com", ".org", ".net", ".info", ".example.com", ".example.org", ".example.net", ".de", ".co.uk"])
    front = lambda: pick(["", "", "www.", "www.", "m.", "blog."])

    def ordinary() -> str:
        host = front() + (word() if rng.random() > 0.015 else word() + "-" + word()) + tail()
        path = "/" + "/".join(pick([word(2, 9), word(2, 2), digits(1, 4)]) for _ in range(rng.randint(0, 3))) + pick(["", "", "/", ".html"])
        return host + path + pick(["", "", "", f"?page={digits(1, 2)}&ref={word(1, 4)}", f"?utm_source={word()}", "#top", f"?id={digits(1, 4)}"])

    def spam() -> str:
        name = lambda: pick([word() + "-" + word(1, 8), word() + "-" + word(), word() + "-" + word() + "-" + word(), word() + digits(2, 6), digits(3, 7) + "-" + word(), code(14, 30)])
        plain_path = lambda: "/" + "/".join(pick([word(2, 9), digits(1, 4)]) for _ in range(rng.randint(0, 3))) + pick(["", "/", ".html"])
        bad_path = lambda: "/" + "/".join(pick([code(12, 40), digits(6, 14), word() + "%20" + word() + "%2F"]) for _ in range(rng.randint(2, 7)))
        bad_query = lambda: "?" + "&".join(f"{word(1, 6)}={code(6, 24)}" for _ in range(rng.randint(3, 9)))
        how = rng.random()
        if how < 0.55:
            return front() + name() + tail() + plain_path() + pick(["", "", "?page=2&ref=x", "#top", bad_query()])
        if how < 0.65:
            return ".".join(str(rng.randint(1, 254)) for _ in range(4)) + plain_path() + pick(["", bad_query()])
        return front() + pick([word(), name()]) + tail() + bad_path() + pick(["", bad_query()]) if how < 0.85 else front() + pick([word(), name()]) + tail() + plain_path() + bad_query()

    return [(pick(["http://", "https://"]) + (spam() if i % 2 else ordinary()), i % 2) for i in range(n)]


def parts(url: str | None) -> tuple[str, str, str]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(.*)", url or "")
    return (m[1].translate(str.maketrans(UPPER, LOWER)), m[2], m[3]) if m else ("", "", "")


FEATURES = ["url", "host", "path", "rest", "depth", "dots", "hyphens", "digit_share", "host_digits", "entropy", "parameters", "fragment", "https", "sign_share", "escapes", "suffix", "name"]


def feature_matrix(url: pa.Array, host: pa.Array, path: pa.Array, rest: pa.Array, suffix: np.ndarray) -> np.ndarray:
    """A row of FEATURES per url; ``suffix`` says how common its host's suffix is."""
    number = lambda x: np.asarray(x, dtype=float)
    length = lambda x: number(pc.utf8_length(x))
    count = lambda x, s: number(pc.count_substring(x, s))
    whole = pc.binary_join_element_wise(host, path, rest, "")
    n = np.maximum(1, length(whole))
    digits = lambda x: number(pc.count_substring_regex(x, "[0-9]"))
    size = np.asarray(pc.binary_length(whole), dtype=np.int64)
    at = np.frombuffer(b"".join(x.encode() for x in whole.to_pylist()), dtype=np.uint8)
    seen = np.bincount(np.repeat(np.arange(len(size)), size) * 256 + at, minlength=len(size) * 256).reshape(-1, 256)
    share = seen / np.maximum(1, size)[:, None]
    last = pc.extract_regex(host, r"(?s)(?P<s>[^.]*(?:\.[^.]*)?)$").field("s")
    columns = [
        length(url), length(host), length(path), length(rest), count(path, "/"), count(host, "."), count(host, "-"), digits(whole) / n, digits(host),
        -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1), count(rest, "=") + count(rest, "&"), number(pc.cast(pc.match_substring(rest, "#"), pa.int8())),
        number(pc.cast(pc.starts_with(url, "https:"), pa.int8())), number(pc.count_substring_regex(whole, "[^0-9A-Za-z]")) / n, count(url, "%"), suffix, length(host) - length(last),
    ]
    return np.stack(columns, axis=1)


def features(urls: list[str | None], suffix: np.ndarray) -> np.ndarray:
    cut = [parts(u) for u in urls]
    text = lambda x: pa.array(x, pa.string())
    return feature_matrix(text([u or "" for u in urls]), *(text([c[k] for c in cut]) for k in range(3)), suffix)


class BoostedTrees:
    """Logistic gradient boosting: depth-wise trees on quantile histograms with second-order gains."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)
        mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
        self.bias, self.forest = math.log(mean / (1 - mean)), []
        score = np.full(len(y), self.bias)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            node, tree = np.zeros(len(y), dtype=np.int64), []
            for level in range(self.depth):
                width = 1 << level
                best = [(1e-6, -1, 0)] * width
                for f in range(x.shape[1]):
                    key = node * self.bins + code[:, f]
                    gs, hs = (np.bincount(key, weights=v, minlength=width * self.bins).reshape(width, self.bins).cumsum(axis=1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    at = gain[:, :-1].argmax(axis=1)
                    for k in range(width):
                        if gain[k, at[k]] > best[k][0]:
                            best[k] = (gain[k, at[k]], f, int(at[k]))
                feature, cut = np.array([b[1] for b in best]), np.array([b[2] for b in best])
                tree.append((feature, cut))
                f = feature[node]
                node = 2 * node + ((f >= 0) & (code[np.arange(len(y)), np.maximum(f, 0)] > cut[node]))
            leaf = -np.bincount(node, weights=g, minlength=1 << self.depth) / (np.bincount(node, weights=h, minlength=1 << self.depth) + self.l2)
            self.forest.append((tree, leaf * self.rate))
            score += leaf[node] * self.rate
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, 1), int)
        score, rows = np.full(len(x), self.bias), np.arange(len(x))
        for tree, leaf in self.forest:
            node = np.zeros(len(x), dtype=np.int64)
            for feature, cut in tree:
                f = feature[node]
                node = 2 * node + ((f >= 0) & (code[rows, np.maximum(f, 0)] > cut[node]))
            score += leaf[node]
        return 1 / (1 + np.exp(-score))


def train(common: list[tuple[float, int]], labelled: int = 4000, seed: int = 17) -> BoostedTrees:
    """Trees from the labelled urls; ``common`` holds (statistic, rows) of the table's commonest suffixes."""
    rows, rng = labelled_urls(labelled, seed), np.random.default_rng(seed)
    y = np.array([y for _, y in rows], float)
    stat, n = (np.array([c[k] for c in common] or [0], float) for k in (0, 1))
    suffix = rng.choice(stat, size=len(rows), p=n / n.sum() if n.sum() else None)
    once = math.log1p(1) / math.log1p(max(1.0, n.sum()))
    suffix = np.where((y == 1) & (rng.random(len(rows)) < 0.5), once, suffix)
    return BoostedTrees().fit(features([u for u, _ in rows], suffix), y, np.ones(len(rows)))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.5, labelled: int = 4000) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block)."""
    spark = pages.sparkSession
    ship(spark)
    own = pages.select("page_id", "url").withColumns({"host": host_of(), "path": path_of()})
    rule, said = rule_of(rules)
    rest = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1)
    own = own.withColumns({"rest": rest, "rule": rule, "said": said, "suffix": F.substring_index("host", ".", -2)})
    counts = save(spark, own.groupBy("suffix").agg(F.count("*").alias("c")), "suffixes")
    rows = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    common = counts.select("suffix", "c", (F.log1p("c") / F.log1p(F.lit(float(max(1, rows))))).alias("common"))
    top = [(r.suffix, r.common, r.c) for r in common.orderBy(F.desc("c"), "suffix").limit(256).collect()]
    model = spark.sparkContext.broadcast(train([t[1:] for t in top], labelled))

    def judge(batches):
        trees = model.value
        for batch in batches:
            text = (strings(batch.column(c)) for c in ("url", "host", "path", "rest"))
            score = trees.predict(feature_matrix(*text, np.asarray(batch.column("common"), dtype=float)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule", "said")), pa.array(score)], names=["page_id", "host", "path", "rule", "said", "score"])

    kind = dict(own.dtypes)["page_id"]
    # The commonest suffixes (256 at most) go out as a broadcast; any other has less than a 256th of the rows.
    head = F.broadcast(spark.createDataFrame([(suffix, share) for suffix, share, _ in top], "suffix string, common double"))
    tail = own.join(head.select("suffix"), "suffix", "left_anti").join(common.drop("c"), "suffix", "left")
    judged = own.join(head, "suffix").unionByName(tail).select("page_id", "host", "path", "rest", "rule", "said", "url", "common").mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, said string, score double")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
