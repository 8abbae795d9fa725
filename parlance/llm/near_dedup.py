"""MinHash near-dedup: Order MinHash over five-word shingles, verified by banded alignment.

1. Texts equal byte for byte share a node (128 bits of SHA-256); the rest works on nodes.
2. A node's shingles are labelled with their occurrence number. From all of its labelled shingles every
   one of ``2 * bands`` hash functions samples the two smallest and retains them in text order; two such
   samples make a band key. A pair of similarity 0.8 shares a band with probability
   1 - (1 - 0.8**4)**24, over 0.99999; every pair that shares one is decided.
3. In a bucket (nodes with one band key) a leader is compared with every member: the member that shares
   most buckets with others, so the original of a family of edited copies. Nodes that verify are joined
   into components. In a bucket that still holds several components, the members outside its largest one
   (the pivots) are compared with the members of other components, unless an exact bound rules a pair out
   (shingles that nobody else in open buckets has cannot be common). Pivots and members go in chunks of
   about ``CHUNK``: one row per pair of chunks, never one per pair of texts, dealt by (bucket, size class,
   chunk) so that no bucket lands in one task. Within such a block common shingles are counted by one
   product, only pairs with enough of them are aligned, in their first common bucket, and a pivot once
   linked to a component is not compared with the rest of it. When this ends, every pair of a bucket that
   lies in two components has been compared or ruled out, so no link between components is lost.
4. A comparison aligns the two sequences of labelled shingles: matches in increasing order within the
   band of offsets that any alignment of the wanted similarity must keep to, so the decision is exact.
   Similarity = aligned / (all of both - aligned), at least ``threshold``.

Words are runs without ASCII white space, A-Z lower-cased. A text of one to four words is one shingle.

Defined results: null text counts as empty; empty texts have no shingles and are near only to each
other; of a class the row with the smallest doc_id stays (nulls last; of repeated rows one stays);
class_id is that doc_id; an empty table gives no rows; extra columns are ignored by ``near_classes``
and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import discard, fresh, ranges, save, ship, slices, strings, text_or_empty, words
from parlance.llm.components import components, relabelled

WORDS = 5
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; products wrap."""
    x = np.atleast_1d(x)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _occurrence(doc: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """How often the same shingle came before in the same text."""
    key = mix(shingle ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]]
    out = np.zeros(len(k), dtype=np.int64)
    if not new.all():
        at = np.arange(len(k))
        out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled shingle hashes of all texts in order, their places, and shingles per text."""
    import xxhash

    distinct, code, counts = words(pc.ascii_lower(texts))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    h = hashed[code]
    per = np.where(counts == 0, 0, np.maximum(1, counts - (WORDS - 1)))
    first = np.cumsum(counts) - counts
    at = ranges(first, per)
    s = np.zeros(len(at), dtype=np.uint64)
    doc = np.repeat(np.arange(len(per)), per)
    end = (first + counts)[doc]
    padded = np.r_[h, np.zeros(WORDS, np.uint64)]
    for j in range(WORDS):
        s = s * np.uint64(0x9E3779B97F4A7C15) + np.where(at + j < end, padded[at + j], np.uint64(j + 1))
    s = mix(s)
    label = mix(s + _occurrence(doc, s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return label, at - first[doc], per


def band_keys(texts: pa.Array, bands: int = 24, block: int = 32_768) -> list[np.ndarray | None]:
    """The Order MinHash band keys (int64) of each text; None for a text without words."""
    label, _, per = shingles(texts)
    first = np.cumsum(per) - per
    order = np.argsort(per, kind="stable")
    a = int(np.searchsorted(per[order], 1))
    out: list[np.ndarray | None] = [None] * len(per)
    seeds = [mix(np.array([k + 1], np.uint64) * np.uint64(0xA24BAED4963EE407)) for k in range(2 * bands)]
    while a < len(order):  # texts of about the same length side by side
        z = a + max(1, block // int(per[order[a]]))
        fits = per[order[a:z]] * np.arange(1, len(order[a:z]) + 1) <= block
        rows = order[a : a + max(1, int(fits.sum()))]
        a += len(rows)
        n, line = per[rows], np.arange(len(rows))
        col = np.arange(int(n[-1]))
        lab = label[first[rows][:, None] + np.minimum(col, n[:, None] - 1)]
        pad = np.flatnonzero((col >= n[:, None]).ravel())
        single = n == 1
        v, w = np.empty_like(lab), np.empty_like(lab)
        keys = np.zeros((len(rows), bands), dtype=np.uint64)
        for k in range(2 * bands):
            np.bitwise_xor(lab, seeds[k], out=v)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # mix(), in place
                np.right_shift(v, np.uint64(shift), out=w)
                np.bitwise_xor(v, w, out=v)
                if factor > 1:
                    np.multiply(v, np.uint64(factor), out=v)
            v.ravel()[pad] = M64
            one = v.argmin(axis=1)
            v[line, one] = M64
            two = v.argmin(axis=1)
            two[single] = one[single]
            left, right = np.minimum(one, two), np.maximum(one, two)
            entry = mix(lab[line, left] * np.uint64(0x9FB21C651E98DF25) + lab[line, right])
            keys[:, k // 2] = mix(keys[:, k // 2] * np.uint64(0xC2B2AE3D27D4EB4F) + entry + np.uint64(k // 2))
        for i, key in zip(rows.tolist(), keys.view(np.int64), strict=True):
            out[i] = key
    return out


def labelled(text: str) -> list[tuple]:
    """Occurrence-labelled shingles in order."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    grams = list(zip(*(w[j:] for j in range(WORDS)), strict=False)) if len(w) >= WORDS else [tuple(w)]
    if len(set(grams)) == len(grams):
        return [(g, 0) for g in grams]
    seen: dict[tuple, int] = {}
    out = []
    for g in grams:
        n = seen.get(g, 0)
        seen[g] = n + 1
        out.append((g, n))
    return out


def aligned(a: dict[tuple, int], b: list[tuple], threshold: float) -> float:
    """Similarity by banded alignment; ``a`` maps labelled shingles to places. 0 where it is below."""
    na, nb = len(a), len(b)
    if not na or not nb:
        return 0.0
    need = threshold * (na + nb) / (1 + threshold)
    band = max(na, nb) - need + 1e-6
    get = a.get
    match = [i for j, g in enumerate(b) if (i := get(g)) is not None and -band <= i - j <= band]
    if len(match) < need - 1e-9:
        return 0.0
    tails: list[int] = []
    for i in match:  # longest increasing run of places = best alignment of labelled shingles
        if not tails or i > tails[-1]:
            tails.append(i)
        else:
            tails[bisect_left(tails, i)] = i
    m = len(tails)
    sim = m / (na + nb - m)
    return sim if sim >= threshold - 1e-9 else 0.0


def similarity(x: str, y: str, threshold: float = 0.0) -> float:
    return aligned({g: i for i, g in enumerate(labelled(x))}, labelled(y), threshold)


def with_node(docs: DataFrame) -> DataFrame:
    t = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.substring(F.sha2(t, 256), 1, 32)).alias("node"), t.alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, keep) -> DataFrame:
    """The pairs (a, b) whose texts align."""

    def run(batches):
        last_id, last = None, {}
        for batch in batches:
            ids, keep = batch.column("a").to_pylist(), []
            for i, (a, x, y) in enumerate(zip(ids, strings(batch.column("ta")).to_pylist(), strings(batch.column("tb")).to_pylist(), strict=True)):
                if a != last_id:
                    last_id, last = a, {g: k for k, g in enumerate(labelled(x))}
                if aligned(last, labelled(y), threshold):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    # A leader of many pairs is spread: one row of its text for about CHUNK of them.
    spread = lambda n: F.ceil(F.col(n) / CHUNK)
    leads = keep(pairs.groupBy("a").agg(F.count("*").alias("n")), "leads")
    ta = leads.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a").select("a", "n", "ta", F.explode(F.sequence(F.lit(0).cast("long"), spread("n") - 1)).alias("part"))
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")
    many = leads.where(F.col("n") > CHUNK).withColumn("parts", spread("n"))
    one = one.join(F.broadcast(many.select("a", "parts")) if many.count() <= 100_000 else many.select("a", "parts"), "a", "left")
    one = one.withColumn("part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("b"), F.col("parts")))).drop("parts")
    two = one.join(ta.drop("n").hint("merge"), ["a", "part"])
    return two.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def near_labels(docs: DataFrame, threshold: float = 0.8, bands: int = 24) -> tuple[DataFrame, DataFrame]:
    """(node, label) of the nodes that have a near copy, and (doc_id, node) of every row."""
    spark = docs.sparkSession
    ship(spark)

    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                keys = band_keys(strings(part.column("text")), bands)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "keys"])

    spent: list[DataFrame] = []  # stored on the way, and deleted when the labels are stored
    # Joins by hint("merge") are dealt the same way at every size, so cost and disk grow with the input alone.

    def keep(df: DataFrame, name: str) -> DataFrame:
        spent.append(save(spark, df, name))
        return spent[-1]

    sketched = save(spark, with_node(docs).mapInArrow(sketch, "doc_id long, node binary, keys array<long>"), "sketches")
    unique = keep(sketched.select("node", "keys").dropDuplicates(["node"]), "unique")
    placed = keep(unique.select("node", F.explode("keys").alias("key")), "buckets")
    sizes = keep(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = keep(placed.join(sizes.hint("merge"), "key"), "shared")
    degree = keep(shared.groupBy("node").agg(F.sum("n").alias("degree")), "degree")
    ranked = keep(shared.join(degree.hint("merge"), "node"), "ranked")
    lead = keep(ranked.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("leader")), "leaders")
    shared = keep(ranked.select("key", "node").join(lead.hint("merge"), "key"), "members")

    own = with_node(docs).groupBy("node").agg(F.first("text").alias("text"))
    texts = keep(own.join(degree.select("node").hint("merge"), "node", "left_semi"), "texts")
    first = keep(shared.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    labels = components(keep(_verified(first, texts, threshold, keep), "near"))

    # What is left: buckets that hold several components.
    now = keep(shared.select("key", "node").join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    now = keep(now.join(keep(_mixed(now), "mixed").hint("merge"), "key"), "open")
    weight = keep(_own_shingles(texts.join(now.select("node").hint("merge"), "node", "left_semi")), "weights")
    # A partner of size m must satisfy threshold * n <= m <= most, and n <= most of the partner.
    most = F.floor((F.col("n") - F.col("u")) * (1 + threshold) / threshold - F.col("n") + 1e-6)
    weight = keep(weight.join(unique.hint("merge"), "node"), "weights")
    now = keep(now.join(weight.hint("merge"), "node").withColumn("most", most).where(F.col("most") >= F.ceil(threshold * F.col("n") - 1e-6)), "alive")
    found = keep(_across(now, texts, threshold, keep), "near")
    if not found.isEmpty():
        parent = components(relabelled(relabelled(found, "a", labels), "b", labels))
        spent += [labels, parent]
        labels = save(spark, relabelled(labels, "label", parent).unionByName(parent.join(labels.select("node"), "node", "left_anti")), "labels")
    discard(spark, *spent)
    return labels, sketched.select("doc_id", "node")


CHUNK = 64


def _across(now: DataFrame, texts: DataFrame, threshold: float, keep) -> DataFrame:
    """The near pairs (a, b) between components of a bucket, among ``now``'s (key, node, label, main, n, most, keys)."""
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25)))
    least = F.greatest(F.lit(1.0), threshold * F.col("n") - 1e-6)
    rows = now.withColumn("pivot", F.col("label") != F.col("main")).drop("main")
    pivots = rows.where("pivot").withColumn("size", F.explode(F.sequence(size_class(least), size_class(F.col("most")))))
    members = rows.withColumn("size", size_class(F.col("n")))
    group = ["key", "size"]
    cp = pivots.groupBy(*group).agg(F.count("*").alias("cp"))
    cm = members.groupBy(*group).agg(F.count("*").alias("cm"))
    both = keep(cp.join(cm.hint("merge"), group), "groups")
    chunk = lambda c: F.pmod(F.xxhash64("node"), F.ceil(F.col(c) / CHUNK))
    held = F.collect_list(F.struct("node", "label", "pivot", "n", "most", "keys", "text"))
    own = texts.select("node", "text")

    def chunked(df, c, name):
        df = df.join(both.hint("merge"), group).withColumn("chunk", chunk(c))
        df = df.join(own.hint("merge"), "node")
        return df.groupBy(*group, "chunk").agg(held.alias(name), F.first("cm").alias("cm"))

    left = chunked(pivots, "cp", "pivots").drop("chunk").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("cm") / CHUNK) - 1))).drop("cm")
    blocks = left.join(chunked(members, "cm", "members").drop("cm").hint("merge"), [*group, "chunk"])

    def run(batches):
        for batch in batches:
            for key, pivots, members in zip(*(batch.column(c) for c in ("key", "pivots", "members")), strict=True):
                yield from _block(key.as_py(), pivots.values, members.values, threshold)

    return blocks.select("key", "pivots", "members").mapInArrow(run, "a binary, b binary").distinct()


def _block(key: int, pivots: pa.StructArray, members: pa.StructArray, threshold: float):
    """The near pairs of one block, at most one for a pivot and another component."""
    p, m = ({f: x.field(f) for f in ("node", "label", "pivot", "n", "most", "keys", "text")} for x in (pivots, members))
    number = lambda x: np.asarray(x, dtype=np.int64)
    code = {v: i for i, v in enumerate(sorted({*p["label"].to_pylist(), *m["label"].to_pylist()}))}
    pl, ml = (np.array([code[v] for v in x["label"].to_pylist()]) for x in (p, m))
    pn, pm, mn, mm = number(p["n"]), number(p["most"]), number(m["n"]), number(m["most"])
    p_id, m_id = p["node"].to_pylist(), m["node"].to_pylist()
    pk, mk = (number(x["keys"].flatten()).reshape(len(x["keys"]), -1) for x in (p, m))
    can = (pl[:, None] != ml) & (mn <= pm[:, None]) & (pn[:, None] <= mm)
    twice = np.flatnonzero(np.asarray(m["pivot"]))  # a pair of pivots is compared once
    if len(twice):
        can[:, twice] &= np.array([[a < m_id[j] for j in twice.tolist()] for a in p_id], dtype=bool).reshape(len(p_id), -1)
    i, j = np.nonzero(can)
    same = pk[i] == mk[j]
    here = pk[i, same.argmax(axis=1)] == key  # in the pair's first common bucket only
    i, j = i[here], j[here]
    if not len(i):
        return
    some_p, some_m = np.unique(i), np.unique(j)
    (ph, _, pc_), (mh, _, mc) = (shingles(strings(x["text"].take(pa.array(rows)))) for x, rows in ((p, some_p), (m, some_m)))
    shared = np.intersect1d(ph, mh)
    if not len(shared):
        return

    def matrix(h, count):
        at = np.searchsorted(shared, h)
        at[at == len(shared)] = 0
        hit = shared[at] == h
        out = np.zeros((len(count), len(shared)), dtype=np.float32)
        out[np.repeat(np.arange(len(count)), count)[hit], at[hit]] = 1
        return out

    common = matrix(ph, pc_) @ matrix(mh, mc).T
    got = common[np.searchsorted(some_p, i), np.searchsorted(some_m, j)]
    enough = got >= threshold * (pn[i] + mn[j]) / (1 + threshold) - 1e-3
    i, j, got = i[enough], j[enough], got[enough]
    done, last, index = set(), None, {}
    keep = []
    for k in np.lexsort((-got, i)).tolist():
        a, b = int(i[k]), int(j[k])
        if (a, ml[b]) in done:
            continue
        if a != last:
            last, index = a, {g: t for t, g in enumerate(labelled(p["text"][a].as_py()))}
        if aligned(index, labelled(m["text"][b].as_py()), threshold):
            done.add((a, ml[b]))
            keep.append((min(p_id[a], m_id[b]), max(p_id[a], m_id[b])))
    if keep:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.binary()), pa.array([x for _, x in keep], pa.binary())], names=["a", "b"])


def _mixed(members: DataFrame) -> DataFrame:
    """(key, main): the buckets that hold several components, with the largest."""
    groups = members.groupBy("key", "label").agg(F.count("*").alias("c"))
    return groups.groupBy("key").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("l")).where("l > 1").select("key", "main")


def _own_shingles(texts: DataFrame) -> DataFrame:
    """(node, n, u): shingles of each text, and those that no other of these texts has.

    Of two texts at most min(n - u) shingles can be common, which bounds their similarity exactly.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 8_000_000):
                label, _, per = shingles(strings(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)], pa.int32()), pa.array(label.view(np.int64)))], names=["node", "h"])

    rows = texts.select("node", "text").mapInArrow(run, "node binary, h array<long>").select("node", F.explode("h").alias("h"))
    held = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    own = held.where("c = 1").groupBy("node").agg(F.count("*").alias("u"))
    size = texts.select("node", F.size(F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w")).select("node", F.greatest(F.col("w") - (WORDS - 1), F.lit(1)).alias("n"))
    return size.join(own.hint("merge"), "node", "left").select("node", "n", F.coalesce("u", F.lit(0)).alias("u"))


def near_classes(docs: DataFrame, threshold: float = 0.8, **how) -> DataFrame:
    """Per row: doc_id, class_id (the class's smallest doc_id), class_size (rows), n_texts (different texts)."""
    spark = docs.sparkSession
    labels, own = near_labels(docs, threshold, **how)
    node = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    node = save(spark, node.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "nodes")
    sums = save(spark, node.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"), F.count("*").alias("n_texts")), "classes")
    of_node = save(spark, node.select("node", "label").join(sums.hint("merge"), "label").drop("label"), "node-classes")
    return own.join(of_node.hint("merge"), "node").select("doc_id", "class_id", "class_size", "n_texts", F.lower(F.hex("node")).alias("text_id"))


def drop_near_copies(docs: DataFrame, threshold: float = 0.8, **how) -> DataFrame:
    """The rows that stay, with all their columns: of each class the one with the smallest doc_id.

    Of rows equal in doc_id and text, one stays; which one's other columns stay with it is not defined.
    """
    spark = docs.sparkSession
    labels, own = near_labels(docs, threshold, **how)
    rows = own.groupBy("node", "doc_id").agg(F.count("*").alias("n"))
    rows = save(spark, rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "n")).alias("r")), "nodes")
    rows = rows.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    once = rows.groupBy("label").agg(F.min(F.struct("r.last", "r.doc_id", "node", "r.n")).alias("r"))
    again = save(spark, once.select("r.doc_id", F.lower(F.hex("r.node")).alias("node"), "r.n"), "kept")
    own_sha, id_, sha = fresh(docs, "own_sha", "kept_id", "kept_sha")
    own = docs.withColumn(own_sha, F.substring(F.sha2(text_or_empty(), 256), 1, 32))
    kept = again.select(F.col("doc_id").alias(id_), F.col("node").alias(sha))
    out = own.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_sha) == F.col(sha)), "left_semi")
    if not again.where("n > 1").isEmpty():  # rows repeated with their doc_id
        out = out.dropDuplicates(["doc_id", own_sha])
    return out.drop(own_sha)
