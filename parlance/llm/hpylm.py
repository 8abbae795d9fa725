"""LM scoring: a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

One restaurant per context (the word before; texts start in a context of their own), all of them sharing
the root as their parent; the root's base is uniform over the vocabulary and one unknown word. A
context's tables are the root's customers. A sweep draws, for every (context, word), its number of tables,
then the root's alike. The dishes of a restaurant hang together only by the weight of its T tables,
d^T Gamma(theta/d + T) / Gamma(theta/d). Each sweep first draws the restaurant's latent value x from
Gamma(theta/d + T); given x the dishes are independent, with weights S(c, t) (d x parent)^t (S: generalised
Stirling numbers), so drawing them side by side is a Gibbs step of the restaurant, whatever cells they lie in.
The parent probability is the root's predictive one after the sweep before. Stirling numbers are exact up to
``EXACT`` customers; beyond, they come from an alternating series or a saddle point (``log_stirling``; tests
hold it to the exact recursion). Predictive probabilities are averaged over the sweeps after ``burn_in``. The
discounts come from counts of counts; the strengths are parameters.

Layout: a grid of word blocks x context blocks. Texts are turned into (context, word) counts per batch of
documents and cell of the grid before anything is shuffled, so no word, context or pair has a row or a task
of its own however common it is: a word is spread over all context blocks, a context over all word blocks,
and a pair comes once per batch. Occurrences stay with their batch. The grid grows with the corpus
(``cell_tokens`` tokens a cell), so memory does not. Totals of words and contexts that span cells are kept
by owners, one per word block and one per context block; cells and owners exchange arrays in the order of
their own lists, and a sweep starts from the stored state of the sweep before. Cells are stored in buckets,
so they are not shuffled again; at the end every batch gets the log-probabilities of its pairs back and
sums them by document. Counts, words, contexts and pairs are those of the whole corpus; the driver sees
a few sums per sweep.

Words: A-Z lower-cased runs without ASCII white space, then one end token per text.

Defined results: null text counts as empty (one end token); rows with equal doc_id are scored each; a
null doc_id counts as the text '' for the split; with no training rows every token is unknown and
N = 0, V = 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import clean_shuffles, discard, partitions, release, save, shared_dir, ship, slices, strings, text_or_empty, words
from parlance.llm.near_dedup import mix

END, START = np.uint64(0x5E9D0F3B7A1C2E41), np.uint64(0x1B873593CC9E2D51)
EXACT = 512


# --- numbers of tables ----------------------------------------------------------------------------


def stirling(d: float, size: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S_d(c, t) for 0 <= t <= c <= size."""
    s = np.full((size + 1, size + 1), -np.inf)
    s[0, 0] = 0.0
    t = np.arange(size + 1)
    for c in range(size):
        stay = np.where(t <= c, s[c] + np.log(np.maximum(c - t * d, 1e-300)), -np.inf)
        s[c + 1] = np.logaddexp(stay, np.r_[-np.inf, s[c, :-1]])
        if c == 0:
            s[1] = np.where(t == 1, 0.0, -np.inf)
    return s


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for positive arguments."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S_d(c, t) for dishes of c > EXACT customers (one per row) and a row of table numbers each.

    S_d(c, t) = c!/t! [x^c] ((1 - (1 - x)^d) / d)^t: few tables by its alternating series, whose terms fall off
    as (t / c^d)^j; where those cancel or do not run out, by the saddle point with its second-order
    correction. For d from 0.05 to 0.9 the logarithm is right to some thousandths.
    """
    c, t = np.asarray(c, float), np.asarray(t, float)
    shape = t.shape
    j = np.arange(1, (48 if d < 0.65 else 160) + 1)
    few = (t < 8.0 * c[:, None] ** d).ravel()
    owner = np.repeat(np.arange(len(c)), shape[1])
    per_dish = log_gamma(c[:, None] - j * d) + log_gamma(1 + j * d) - np.log(j).cumsum()
    sign = np.sin(np.pi * j * d) * np.where(j % 2, 1, -1) / np.pi
    t, out = t.ravel(), np.zeros(t.size)
    at = np.flatnonzero(few)
    if len(at):
        falling = t[at, None] - j + 1
        log = np.where(falling > 0, np.log(np.maximum(falling, 1)).cumsum(axis=1) + per_dish[owner[at]], -np.inf)
        top = log.max(axis=1, keepdims=True)
        total = np.exp(log - top) @ sign
        out[at] = top[:, 0] + np.log(np.maximum(total, 1e-300)) - t[at] * np.log(d) - log_gamma(t[at] + 1)
        few[at[(total < 1e-9) | (log[:, -1] > top[:, 0] - 25)]] = False  # cancelled, or not run out
    c = c[owner]
    at = np.flatnonzero(~few)
    if len(at):
        cc, tt = c[at], t[at]
        want = cc / tt
        # x g'(x) / g(x) = c / t rises in u = -log(1 - x); bisection, then Newton steps on log u.
        mean = lambda u: d * -np.expm1(-u) * np.exp(u * (1 - d)) / -np.expm1(-d * u)
        lo, hi = np.full(len(at), -30.0), np.full(len(at), np.log(60 / (1 - d) + 60))
        for _ in range(50):
            mid = (lo + hi) / 2
            low = mean(np.exp(mid)) < want
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
        u = np.exp((lo + hi) / 2)
        x = -np.expm1(-u)
        lx = np.log(x)
        # Cumulants of the size of a table under the tilt, by central differences of mean in log x.
        h = 1e-3 * np.minimum(1.0, (1 - x) / x)
        at_lx = lambda s: mean(-np.log1p(-np.exp(s)))
        m0, mp, mm, mpp, mmm = at_lx(lx), at_lx(lx + h), at_lx(lx - h), at_lx(lx + 2 * h), at_lx(lx - 2 * h)
        k2 = tt * (8 * (mp - mm) - (mpp - mmm)) / (12 * h)
        k3 = tt * (mp - 2 * m0 + mm) / h**2
        k4 = tt * (mpp - 2 * mp + 2 * mm - mmm) / (2 * h**3)
        g = np.log(-np.expm1(-d * u) / d)
        with np.errstate(divide="ignore", invalid="ignore"):
            fix = k4 / (8 * k2**2) - 5 * k3**2 / (24 * k2**3)
            log = log_gamma(cc + 1) - log_gamma(tt + 1) + tt * g - cc * lx - 0.5 * np.log(2 * np.pi * k2) + np.log1p(np.clip(np.nan_to_num(fix), -0.5, 0.5))
        # Nearly all alone: S_d(c, c) = 1 and S_d(c, c - 1) = (1 - d) c (c - 1) / 2 are known.
        log = np.where(tt >= cc, 0.0, np.where(tt == cc - 1, np.log((1 - d) * cc * (cc - 1) / 2), log))
        out[at] = log
    return out.reshape(shape)


def _draw_large(rng, c: np.ndarray, weight: np.ndarray, d: float, points: int = 384) -> np.ndarray:
    """Tables of dishes of more than EXACT customers, from the conditional over a grid of table numbers.

    The grid is first coarse over 1 .. c, then spread over all that is not negligible; where it is wider
    than one, the number is uniform within its interval.
    """
    per_table = np.log(weight)[:, None]
    lo, hi = np.ones(len(c)), c.astype(float)
    for _ in range(2):
        step = np.linspace(0, 1, 48)
        t = np.round(np.exp(np.log(lo)[:, None] * (1 - step) + np.log(hi)[:, None] * step))
        w = log_stirling(c, t, d) + t * per_table
        rows = np.arange(len(c))
        live = w >= w.max(axis=1, keepdims=True) - 40
        first, last = live.argmax(axis=1), t.shape[1] - 1 - live[:, ::-1].argmax(axis=1)
        lo, hi = t[rows, np.maximum(first - 1, 0)], t[rows, np.minimum(last + 1, t.shape[1] - 1)]
    points = int(min(points, (hi - lo + 1).max()))
    width = np.maximum(1, np.ceil((hi - lo + 1) / points))
    t = lo[:, None] + np.arange(points) * width[:, None]
    own = np.minimum(t, c[:, None])
    w = np.where(t <= hi[:, None], log_stirling(c, own, d) + own * per_table, -np.inf)
    p = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
    k = (p < rng.random((len(c), 1)) * p[:, -1:]).sum(axis=1)
    return np.minimum(t[np.arange(len(c)), k] + np.floor(rng.random(len(c)) * width), c).astype(np.int64)


def latent(rng, tables: np.ndarray, d: float, theta: float) -> np.ndarray:
    """The latent value of restaurants with so many tables."""
    return rng.gamma(theta / d + np.asarray(tables, float))


#: Latent values travel as their logarithms in steps of a thousandth, from exp(-20) on.
def coded(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round((np.log(np.maximum(x, 1e-300)) + 20) * 1000), 0, 65535).astype(np.int64)


def decoded(code: np.ndarray) -> np.ndarray:
    return np.exp(code / 1000 - 20)


def draw_tables(rng, c: np.ndarray, weight: np.ndarray, d: float, table: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes of c customers; ``weight``: d x latent value x parent probability of each."""
    out = np.minimum(c, 1).astype(np.int64)
    most = len(table) - 1
    many = np.flatnonzero((c >= 2) & (c <= most))
    order = many[np.argsort(c[many], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, np.diff(c[order]) != 0, True]) if len(order) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = int(c[order[a]])
        block = max(1, 400_000 // n)
        for at in range(a, b, block):
            rows = order[at : min(b, at + block)]
            log = np.arange(1, n + 1) * np.log(weight[rows, None]) + table[n, 1 : n + 1]
            log -= log.max(axis=1, keepdims=True)
            p = np.exp(log).cumsum(axis=1)
            out[rows] = 1 + (p < rng.random((len(rows), 1)) * p[:, -1:]).sum(axis=1)
    big = np.flatnonzero(c > most)
    for at in range(0, len(big), 128):
        rows = big[at : at + 128]
        out[rows] = _draw_large(rng, c[rows], np.asarray(weight, float)[rows], d)
    return out


# --- the model's numbers --------------------------------------------------------------------------


class Model:
    """Fixed numbers of a corpus, and the root's totals after the last sweep."""

    def __init__(self, n: int, v: int, d1: float, d2: float, theta1: float, theta2: float, seed: int):
        self.n, self.v, self.d1, self.d2, self.theta1, self.theta2, self.seed = n, v, d1, d2, theta1, theta2, seed
        self.root: list[tuple[float, float]] = []  # per sweep (0: the start): customers and tables of the root

    def root_p(self, k: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Predictive probability at the root of words with so many customers and tables there."""
        all_customers, all_tables = self.root[k]
        return (np.maximum(customers - self.d1 * tables, 0) + (self.theta1 + self.d1 * all_tables) / (self.v + 1)) / (self.theta1 + all_customers)

    def predict(self, count, t, root, context_count, context_tables) -> np.ndarray:
        """Predictive probability of dishes in their contexts."""
        return (np.maximum(count - self.d2 * t, 0) + (self.theta2 + self.d2 * context_tables) * root) / (self.theta2 + context_count)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


# --- packed arrays --------------------------------------------------------------------------------


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays in one value: integers in the least width, by byte planes, which sorted or small numbers compress well in."""
    out = {}
    for name, x in arrays.items():
        x = np.asarray(x)
        if x.dtype.kind in "iu" and x.dtype != np.uint64 and (not len(x) or x.min() >= 0):
            top = int(x.max(initial=0))
            x = x.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(k).max))
        out[name] = (x.dtype.str, len(x), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")
    return pickle.dumps(out)


def unpack(data: bytes, *names: str) -> dict[str, np.ndarray]:
    """The arrays (or only some), as int64 unless they are 64-bit hashes or floats."""
    held = pickle.loads(data)
    return {name: _unpacked(*held[name]) for name in names or held}


def _unpacked(kind: str, n: int, raw: bytes) -> np.ndarray:
    kind = np.dtype(kind)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind)
    return x if kind.kind == "f" or kind == np.uint64 else x.astype(np.int64)


# --- from texts to the grid -----------------------------------------------------------------------

_CELLS = pa.schema([("node", pa.int64()), ("batch", pa.int64()), ("data", pa.binary())])


class Grid:
    """``side`` word blocks by ``side`` context blocks; cell = word block * side + context block."""

    def __init__(self, side: int):
        self.side = side

    def cell(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        s = np.uint64(self.side)
        return ((word % s) * s + mix(context ^ START) % s).astype(np.int64)


def batch_cells(part: pa.RecordBatch, grid: Grid) -> tuple[bytes, list[tuple[int, bytes]]]:
    """(what stays with the batch, (cell, its pairs) of every cell that the batch touches)."""
    import xxhash

    distinct, code, counts = words(pc.ascii_lower(strings(part.column("text"))))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    h = np.concatenate([h, [END, START]]).astype(np.uint64)
    size = len(h)
    n = counts + 1
    ends = np.cumsum(n) - 1
    out = np.asarray(part.column("out"))
    by_hash = np.argsort(h, kind="stable")
    rank = np.empty(size, dtype=np.int32)
    rank[by_hash] = np.arange(size)
    word = np.full(int(n.sum()), rank[size - 2], dtype=np.int32)
    inner = np.ones(len(word), dtype=bool)
    inner[ends] = False
    word[inner] = rank[code]
    del code, inner
    # Pairs in the order of (word hash, context hash), then of the cell.
    key = word.astype(np.int64) * size
    key[1:] += word[:-1]
    first = ends - n + 1
    key[first] = word[first].astype(np.int64) * size + rank[size - 1]
    del word
    occurrence = np.argsort(key, kind="stable").astype(np.int32)
    key = key[occurrence]
    new = np.r_[True, key[1:] != key[:-1]]
    pair = key[new]
    del key
    dish = (np.cumsum(new, dtype=np.int32) - 1).astype(np.int32)
    w, c = pair // size, pair % size
    cell = grid.cell(h[by_hash[w]], h[by_hash[c]])
    order = np.argsort(cell, kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order))
    w, c, cell = w[order], c[order], cell[order]
    dish = place[dish]
    again = np.argsort(dish, kind="stable")
    occurrence, dish = occurrence[again], dish[again]
    del again, place, order
    times = np.bincount(dish, minlength=len(w))
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)[occurrence]
    train = np.bincount(dish[~out[doc]], minlength=len(w))
    del dish, occurrence
    starts = np.flatnonzero(np.r_[True, np.diff(cell) != 0])
    cells, n_words, per_word = [], [], []
    for a, b in zip(starts, np.r_[starts[1:], len(cell)], strict=True):
        first = np.flatnonzero(np.r_[True, np.diff(w[a:b]) != 0])
        dishes = np.diff(np.r_[first, b - a])
        held, of = np.unique(c[a:b], return_inverse=True)
        cells.append((int(cell[a]), pack(words=h[by_hash[w[a:b][first]]], dishes=dishes, contexts=h[by_hash[held]], context=of, train=train[a:b])))
        n_words.append(len(first))
        per_word.append(dishes)
    ids = part.column("doc_id")
    own = pack(doc=np.asarray(ids.fill_null(0), dtype=np.int64).view(np.uint64), null=np.asarray(ids.is_null()).astype(np.uint8), n=n, out=out.astype(np.uint8), cells=cell[starts], n_words=np.array(n_words), dishes=np.concatenate(per_word), times=times, docs=doc)
    return own, cells


def _deal(docs: DataFrame, grid: Grid, most_bytes: int, most_rows: int) -> DataFrame:
    """(node, batch, data): pairs for the cells (node >= 0), and what stays with a batch (node = -1 - batch)."""

    def run(batches):
        batch_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in slices(batch, "text", most_bytes):
                for at in range(0, some.num_rows, most_rows):
                    own, cells = batch_cells(some.slice(at, most_rows), grid)
                    yield pa.RecordBatch.from_pydict({"node": [-1 - batch_id], "batch": [batch_id], "data": [own]}, schema=_CELLS)
                    for k in range(0, len(cells), 16):
                        part = cells[k : k + 16]
                        yield pa.RecordBatch.from_pydict({"node": [x for x, _ in part], "batch": [batch_id] * len(part), "data": [x for _, x in part]}, schema=_CELLS)
                    del own, cells
                    batch_id += 1

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), held_out().alias("out"))
    return own.mapInArrow(run, "node long, batch long, data binary")


_STATE = pa.schema([("node", pa.int64()), ("head", pa.binary()), ("asked", pa.binary())])


def _gather(table: pa.Table) -> pa.Table:
    """All batches of a cell to its pairs (head) and what every batch asked for; a batch's own row as it is."""
    node = table.column("node")[0].as_py()
    if node < 0:
        return pa.table({"node": [node], "head": table.column("data").to_pylist()[:1], "asked": [None]}, schema=_STATE)
    table = table.sort_by("batch")
    data = [pickle.loads(x.as_py()) for x in table.column("data")]
    join = lambda f: np.concatenate([_unpacked(*d[f]) for d in data])
    size = lambda f: np.array([d[f][1] for d in data])
    n_words, n_contexts, n_dishes = size("words"), size("contexts"), size("context")
    word_list, asked_words = np.unique(join("words"), return_inverse=True)
    context_list, of = np.unique(join("contexts"), return_inverse=True)
    key = np.repeat(asked_words, join("dishes"))
    key *= len(context_list)
    key += of[join("context") + np.repeat(np.cumsum(n_contexts) - n_contexts, n_dishes)]
    del of
    key, asked = np.unique(key, return_inverse=True)
    count = np.bincount(asked, weights=join("train"), minlength=len(key)).astype(np.int64)
    head = pack(words=word_list, contexts=context_list, word=key // len(context_list), context=key % len(context_list), count=count)
    step = np.diff(asked, prepend=0)
    asked = pack(batch=np.asarray(table.column("batch")), words=asked_words, n_words=n_words, n_dishes=n_dishes, up=np.maximum(step, 0), down=np.maximum(-step, 0))
    del data, key, count, step
    release()
    return pa.table({"node": [node], "head": [head], "asked": [asked]}, schema=_STATE)


# --- sweeps ---------------------------------------------------------------------------------------

#: Rows between cells and owners: ``to`` is a cell, or an owner (2 * word block, 2 * context block + 1).
_MAIL = pa.schema([("to", pa.int64()), ("kind", pa.string()), ("sender", pa.int64()), ("customers", pa.float64()), ("tables", pa.float64()), ("data", pa.binary())])
_MAIL_SQL = "to long, kind string, sender long, customers double, tables double, data binary"


def _mail(rows: list[tuple]) -> pa.RecordBatch:
    names = _MAIL.names
    return pa.RecordBatch.from_pydict({n: [(*r, *[None] * 6)[i] for r in rows] for i, n in enumerate(names[:3])} | {"customers": [r[4] if len(r) > 4 else None for r in rows], "tables": [r[5] if len(r) > 5 else None for r in rows], "data": [r[3] for r in rows]}, schema=_MAIL)


def _totals(cell: dict[str, np.ndarray], t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables by word and by context of a cell: those of single customers, and ``t`` of the rest."""
    return tuple(cell[alone] + np.bincount(cell[f], weights=t, minlength=len(cell[alone])).astype(np.int64) for f, alone in (("word", "word_alone"), ("context", "context_alone")))


def _open_cell(node: int, head: dict[str, np.ndarray], side: int) -> list[tuple]:
    """The cell's seating at the start (one table a dish), and its first mail to both owners."""
    count, many = head["count"], head["count"] > 1
    alone = lambda f, size: np.bincount(head[f][count == 1], minlength=size)
    n_w, n_c = len(head["words"]), len(head["contexts"])
    cell = {"word": head["word"][many], "context": head["context"][many], "count": count[many], "word_alone": alone("word", n_w), "context_alone": alone("context", n_c), "t": np.ones(int(many.sum()), np.int64)}
    m, t = _totals(cell, cell["t"])
    known, seen = (np.bincount(head[f], weights=count, minlength=n).astype(np.int64) for f, n in (("word", n_w), ("context", n_c)))
    ones = [float((count == k).sum()) for k in (1, 2)]
    return [(node, "cell", node, pack(**cell), *ones), (2 * (node // side), "list", node, pack(keys=head["words"], total=known, tables=m)), (2 * (node % side) + 1, "list", node, pack(keys=head["contexts"], total=seen, tables=t))]


def _open_owner(table: pa.Table) -> pa.Table:
    """Join the lists of an owner's cells; answer each with totals in its own order."""
    to = table.column("to")[0].as_py()
    table = table.sort_by("sender")
    mail = [unpack(x.as_py()) for x in table.column("data")]
    senders, n = table.column("sender").to_pylist(), np.array([len(m["keys"]) for m in mail])
    join = lambda f: np.concatenate([m[f] for m in mail])
    keys, at = np.unique(join("keys"), return_inverse=True)
    total, tables = (np.bincount(at, weights=join(f), minlength=len(keys)).astype(np.int64) for f in ("total", "tables"))
    root = np.minimum(tables, 1)
    own = pack(at=at, n=n, senders=np.array(senders), root=root)
    ones = [float((tables == k).sum()) for k in (1, 2)] if to % 2 == 0 else [0.0, 0.0]
    sums = np.array([total.sum(), (total > 0).sum(), tables.sum(), root.sum()] if to % 2 == 0 else [0] * 4)
    rows = [(to, "owner", to, own), (to, "sums", to, pack(sums=sums), *ones)]
    for s, a, b in zip(senders, np.cumsum(n) - n, np.cumsum(n), strict=True):
        mine = at[a:b]
        rows.append((s, "words" if to % 2 == 0 else "contexts", to, pack(total=total[mine], tables=tables[mine], root=root[mine])))
    return pa.Table.from_batches([_mail(rows)])


def _mailer(step, held, *args):
    def run(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches([_mail(step(table, held.value, *args))])
        release()
        return out

    return run


def _sweep_cell(table: pa.Table, model: Model, k: int, side: int) -> list[tuple]:
    """Draw the tables of a cell's dishes of several customers; new mail to both owners."""
    mail = {kind: unpack(data) for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True)}
    node, cell, of_word, of_context = table.column("to")[0].as_py(), mail["cell"], mail["words"], mail["contexts"]
    rng = np.random.default_rng([model.seed, 1, node, k])
    parent = model.root_p(k - 1, of_word["tables"], of_word["root"])[cell["word"]]
    # The chain starts from the latent values' means; after every sweep their owners draw them.
    x = decoded(of_context["x"]) if "x" in of_context else model.theta2 / model.d2 + of_context["tables"]
    t = draw_tables(rng, cell["count"], model.d2 * x[cell["context"]] * parent, model.d2, stirling(model.d2, _table_size(cell["count"])))
    by_word, by_context = _totals(cell, t)
    return [(node, "cell", node, pack(**{**cell, "t": t})), (2 * (node // side), "tables", node, pack(tables=by_word)), (2 * (node % side) + 1, "tables", node, pack(tables=by_context))]


def _table_size(c: np.ndarray) -> int:
    return min(EXACT, max(2, int(c.max(initial=2))))


def _sweep_owner(table: pa.Table, model: Model, k: int) -> list[tuple]:
    """Add the cells' tables up; a word owner draws the root's tables, a context owner its restaurants' latent values. Answers in the order of the cells' lists."""
    to = table.column("to")[0].as_py()
    rows = list(zip(*(table.column(c).to_pylist() for c in ("kind", "sender", "data")), strict=True))
    own = unpack(next(data for kind, _, data in rows if kind == "owner"))
    held = {sender: unpack(data)["tables"] for kind, sender, data in rows if kind == "tables"}
    senders, ends = own["senders"].tolist(), np.cumsum(own["n"])
    tables = np.bincount(own["at"], weights=np.concatenate([held[s] for s in senders]), minlength=len(own["root"])).astype(np.int64)
    rng = np.random.default_rng([model.seed, 2, to, k])
    if to % 2 == 0:
        # One restaurant over all owners: the same latent value for all.
        x = latent(np.random.default_rng([model.seed, 4, k]), model.root[k - 1][1], model.d1, model.theta1)
        own["root"] = draw_tables(rng, tables, np.full(len(tables), model.d1 * x / (model.v + 1)), model.d1, stirling(model.d1, _table_size(tables)))
        told = {"tables": tables, "root": own["root"]}
    else:
        told = {"tables": tables, "x": coded(latent(rng, tables, model.d2, model.theta2))}
    out = [(to, "owner", to, pack(**own), float(tables.sum()), float(own["root"].sum()))]
    for s, a, b in zip(senders, ends - own["n"], ends, strict=True):
        mine = own["at"][a:b]
        out.append((s, "words" if to % 2 == 0 else "contexts", to, pack(**{f: v[mine] for f, v in told.items()})))
    return out


def _answer(model: Model, sweeps: list[int], head: dict, asked: dict, mail: dict[tuple[str, int], dict]) -> list[tuple[int, bytes]]:
    """(batch, log-probabilities of its pairs and counts of its words in the cell)."""
    of_word, of_context = mail["words", 0], mail["contexts", 0]
    word, context, count = head["word"], head["context"], head["count"]
    p = np.zeros(len(word))
    for k in sweeps:
        t = np.minimum(count, 1)
        t[count > 1] = mail["cell", k]["t"]
        root = model.root_p(k, mail["words", k]["tables"], mail["words", k]["root"])
        p += model.predict(count, t, root[word], of_context["total"][context], mail["contexts", k]["tables"][context])
    log = np.log10(p / len(sweeps)).astype("<f4")
    which = np.cumsum(asked["up"] - asked["down"])
    d, w = np.cumsum(asked["n_dishes"]), np.cumsum(asked["n_words"])
    return [(b, pack(log=log[which[d1 - n : d1]], known=of_word["total"][asked["words"][w1 - m : w1]])) for b, d1, n, w1, m in zip(asked["batch"].tolist(), d, asked["n_dishes"], w, asked["n_words"], strict=True)]


def _score(model: Model, own: dict, cells: dict[int, dict]) -> dict[str, pa.Array]:
    """The documents of a batch, from the answers of its cells."""
    order = own["cells"].tolist()
    log, known = (np.concatenate([cells[c][f] for c in order]) for f in ("log", "known"))
    docs, size, times = own["docs"], len(own["n"]), own["times"]
    base = np.log10((known + 0.5) / (model.n + 0.5 * (model.v + 1)))
    sums = lambda x: np.bincount(docs, weights=np.repeat(x, times), minlength=size)
    by_dish = lambda x: np.repeat(x, own["dishes"])
    score, n = sums(log), own["n"]
    return {
        "doc_id": pa.array(own["doc"].view(np.int64), mask=own["null"].astype(bool)), "held_out": pa.array(own["out"].astype(bool)), "n_tokens": pa.array(n), "n_known": pa.array(sums(by_dish(known > 0)).astype(np.int64)),
        "train_tokens": pa.array(np.full(size, model.n, np.int64)), "base_score": pa.array(sums(by_dish(base))), "score": pa.array(score), "perplexity": pa.array(10 ** np.minimum(-score / n, 300)),
    }


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def _bucketed(spark: SparkSession, df: DataFrame, buckets: int) -> DataFrame:
    """Store a table in buckets of its node, so that joins by node do not move it again."""
    name = f"parlance_cells_{uuid.uuid4().hex[:12]}"
    with clean_shuffles(spark):
        df.write.bucketBy(buckets, "node").option("path", shared_dir(spark, "cells")).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry only: the files stay, and so does what ``out`` knows of them
    return out


def lm_scores(docs: DataFrame, sweeps: int = 4, burn_in: int = 1, theta1: float = 1.0, theta2: float = 1.0, seed: int = 1, cell_tokens: int = 1_500_000, batch_bytes: int = 12_000_000, batch_rows: int = 30_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    if not 0 <= burn_in < sweeps:
        raise ValueError("burn_in must be less than sweeps")
    spark = docs.sparkSession
    ship(spark)
    tokens = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    cells = max(1, tokens / cell_tokens, min(partitions(spark), tokens / 50_000))
    side = int(np.ceil(np.sqrt(cells)))
    # A bucket may hold several cells: there are at most as many as Spark allows, whatever the corpus.
    buckets = min(max(partitions(spark), side * side), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    dealt = _deal(docs, Grid(side), batch_bytes, batch_rows).repartition(buckets, "node")
    state = _bucketed(spark, dealt.groupBy("node").applyInArrow(_gather, "node long, head binary, asked binary"), buckets)
    of_cells = state.where("node >= 0")

    def open_cells(batches):
        for batch in batches:
            for node, head in zip(batch.column("node").to_pylist(), batch.column("head"), strict=True):
                yield _mail(_open_cell(node, unpack(head.as_py()), side))
                release()

    first = save(spark, of_cells.select("node", "head").mapInArrow(open_cells, _MAIL_SQL), "cells")
    opened = save(spark, first.where("kind = 'list'").groupBy("to").applyInArrow(_open_owner, _MAIL_SQL), "owners")
    sums = np.zeros(4, np.int64) + sum((unpack(bytes(r.data))["sums"] for r in opened.where("kind = 'sums'").select("data").collect()), np.zeros(4, np.int64))
    ones = [[x or 0.0 for x in df.agg(F.sum("customers"), F.sum("tables")).first()] for df in (opened.where("kind = 'sums'"), first.where("kind = 'cell'"))]
    discount = lambda a, b: min(0.9, max(0.05, a / (a + 2 * b))) if a else 0.5
    model = Model(int(sums[0]), int(sums[1]), discount(*ones[0]), discount(*ones[1]), theta1, theta2, seed)
    model.root.append((float(sums[2]), float(sums[3])))
    cell, owner, mail = (df.where(f"kind in {kinds}") for df, kinds in ((first, "('cell')"), (opened, "('owner')"), (opened, "('words', 'contexts')")))
    history, spent = [(0, mail)], [first]
    for k in range(1, sweeps + 1):
        held = spark.sparkContext.broadcast(model)
        drawn = save(spark, cell.unionByName(mail).groupBy("to").applyInArrow(_mailer(_sweep_cell, held, k, side), _MAIL_SQL), "cells")
        told = save(spark, owner.unionByName(drawn.where("kind = 'tables'")).groupBy("to").applyInArrow(_mailer(_sweep_owner, held, k), _MAIL_SQL), "owners")
        root = told.where("kind = 'owner' and `to` % 2 = 0").agg(F.sum("customers"), F.sum("tables")).first()
        model.root.append((root[0] or 0.0, root[1] or 0.0))
        cell, owner, mail = drawn.where("kind = 'cell'"), told.where("kind = 'owner'"), told.where("kind in ('words', 'contexts')")
        discard(spark, *spent)  # the sweep before, unless its probabilities count
        spent = [] if k > burn_in else [drawn, told]
        if k > burn_in:
            history += [(k, cell), (k, mail)]
    held = spark.sparkContext.broadcast(model)
    kept = list(range(burn_in + 1, sweeps + 1))
    told = None
    for k, df in history:
        df = df.select(F.col("to").alias("node"), F.lit(k).alias("sweep"), "kind", "data")
        told = df if told is None else told.unionByName(df)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        mail = {(kind, k): unpack(data) for kind, k, data in zip(*(right.column(c).to_pylist() for c in ("kind", "sweep", "data")), strict=True)}
        rows = [(node, b, data) for node, head, asked in zip(*(left.column(c).to_pylist() for c in ("node", "head", "asked")), strict=True) for b, data in _answer(held.value, kept, unpack(head), unpack(asked), mail)]
        del mail
        release()
        return pa.table({"node": pa.array([-1 - b for _, b, _ in rows], pa.int64()), "cell": pa.array([n for n, _, _ in rows], pa.int64()), "data": pa.array([d for _, _, d in rows], pa.binary())})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        cells = {c: unpack(d) for c, d in zip(right.column("cell").to_pylist(), right.column("data").to_pylist(), strict=True)}
        out = pa.table(_score(held.value, unpack(left.column("head")[0].as_py()), cells))
        del cells
        release()
        return out

    answers = of_cells.groupBy("node").cogroup(told.groupBy("node")).applyInArrow(answer, "node long, cell long, data binary")
    return state.where("node < 0").select("node", "head").groupBy("node").cogroup(answers.groupBy("node")).applyInArrow(score, _SCORES)
