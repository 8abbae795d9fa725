"""PII: exact base patterns plus a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy from labelled spans (a seeded generator of sentences with e-mail
addresses, IP addresses, card and phone numbers in many notations, and of look-alikes that are none).
Overlapping windows of ``WINDOW`` characters lie every ``CENTRE`` characters over the whole text; each is
decoded by Viterbi, a position takes its tag from the window in which it is most central, and spans are
read off over the whole text, across window borders. A found span must satisfy its kind's rule
(``accept``: digit counts, Luhn, parts up to 255, a host) and is added only where no base span lies: base
spans stay as they are. Every rule asks for a digit or an at sign, so decoding starts at the windows that
own one and goes on to the neighbours that a span runs into; windows that no acceptable span can touch
are left out, which changes no result (``every=True`` decodes all, and a test compares).

Base patterns are matched leftmost and non-overlapping per kind, in time linear in the text.

Defined results: null text counts as empty and has no spans; offsets are code points, end exclusive;
repeated rows are judged alike; an empty table gives no rows; extra columns are ignored by ``find_pii``
and kept by ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import ship, slices, strings, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, fixed by contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_FROM_EDGE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
WINDOW, CENTRE = 96, 48
EDGE = (WINDOW - CENTRE) // 2
SLICE = 4_000_000  # bytes of text that are tagged at once (a longer text alone)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    # A run of local characters is tried once, from its left edge: any later start fails as the edge does.
    at = 0
    while m := (EMAIL.match(text, at) if at else None) or EMAIL_FROM_EDGE.search(text, at):
        yield m.start(), m.end()
        at = m.end()


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d := digits_of(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(digits_of(s)) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of KINDS, then start."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", IP), ("card", CARD)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if valid("phone", m[0])]
    return out


# --- the tagger -----------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
PUNCTUATION = "@.-+() _%/:,;\"'#$&*!?\n|<>="
SYMBOLS = 10 + 26 + len(PUNCTUATION) + 2
_CODE = np.full(128, SYMBOLS - 1, dtype=np.uint8)
_CODE[48:58] = np.arange(10)
_CODE[97:123] = _CODE[65:91] = np.arange(10, 36)
for _i, _c in enumerate(PUNCTUATION):
    _CODE[ord(_c)] = 36 + _i
PAD = SYMBOLS
_IS_TRIGGER = np.zeros(SYMBOLS + 1, dtype=bool)
_IS_TRIGGER[[*range(10), int(_CODE[ord("@")])]] = True


def codes(text: str) -> np.ndarray:
    """Symbol of each code point; characters beyond ASCII share one."""
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(point < 128, _CODE[np.minimum(point, 127)], np.uint8(SYMBOLS - 2))


class Tagger:
    """Bidirectional LSTM over symbols (both directions in one array), linear emissions, CRF transitions."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = self.h = hidden
        bias = np.zeros((2, 1, 4 * h))
        bias[:, :, h : 2 * h] = 1
        self.p = {"E": rng.normal(0, 0.3, (2, SYMBOLS + 1, 4 * h)), "U": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)), "b": bias}
        self.p |= {"W": rng.normal(0, 0.3, (2 * h, TAGS)), "c": np.zeros(TAGS), "A": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}

    def emissions(self, x, keep=False):
        h, (steps, n) = self.h, x.shape
        e, u, b = self.p["E"], self.p["U"], self.p["b"]
        both = np.stack([x, x[::-1]], axis=1)
        table, kind = e.reshape(-1, 4 * h), e.dtype
        both[:, 1] += SYMBOLS + 1
        hidden, cell, out, saved = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind), np.empty((steps, 2, n, h), kind), []
        for t in range(steps):
            z = table[both[t]] + hidden @ u
            z += b
            z[..., : 3 * h] *= 0.5
            np.tanh(z, out=z)
            s = z[..., : 3 * h]
            s *= 0.5
            s += 0.5
            g = z[..., 3 * h :]
            before, cell = cell, s[..., h : 2 * h] * cell + s[..., :h] * g
            tc = np.tanh(cell)
            if keep:
                saved.append((s, g, before, tc, hidden))
            hidden = s[..., 2 * h :] * tc
            out[t] = hidden
        joint = np.concatenate([out[:, 0], out[::-1, 1]], axis=2)
        return joint @ self.p["W"] + self.p["c"], joint, saved, both

    def gradients(self, x, y):
        """CRF negative log likelihood per character and its gradients; x, y are time x batch."""
        em, joint, saved, both = self.emissions(x, keep=True)
        step_p, n, steps = np.exp(self.p["A"]), x.shape[1], len(x)
        top = em.max(axis=2, keepdims=True)
        seen = np.exp(em - top)
        alpha, beta, scale = np.empty_like(em), np.ones_like(em), np.empty((steps, n, 1), em.dtype)
        for t in range(steps):
            a = seen[t] * (np.exp(self.p["s"]) if t == 0 else alpha[t - 1] @ step_p)
            scale[t] = a.sum(axis=1, keepdims=True)
            alpha[t] = a / scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (seen[t + 1] * beta[t + 1] / scale[t + 1]) @ step_p.T
        z = (np.log(scale) + top).sum(axis=(0, 2))
        rows, times = np.arange(n), np.arange(steps)[:, None]
        gold = self.p["s"][y[0]] + em[times, rows[None], y].sum(axis=0) + self.p["A"][y[:-1], y[1:]].sum(axis=0)
        after = (seen * beta / scale)[1:].reshape(-1, TAGS)
        da = step_p * (alpha[:-1].reshape(-1, TAGS).T @ after) - np.bincount((y[:-1] * TAGS + y[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        de = alpha * beta
        de[times, rows[None], y] -= 1
        flat, h = de.reshape(-1, TAGS), self.h
        g = {"A": da, "s": de[0].sum(axis=0), "W": joint.reshape(-1, 2 * h).T @ flat, "c": flat.sum(axis=0)}
        dh = de @ self.p["W"].T
        dout = np.stack([dh[:, :, :h], dh[::-1, :, h:]], axis=1)
        back = self.p["U"].transpose(0, 2, 1)
        dzs, hids = np.empty((steps, 2, n, 4 * h), em.dtype), np.empty((steps, 2, n, h), em.dtype)
        carry_h, carry_c = np.zeros((2, n, h), em.dtype), np.zeros((2, n, h), em.dtype)
        for t in range(steps - 1, -1, -1):
            s, gg, before, tc, hids[t] = saved[t]
            dhid = dout[t] + carry_h
            i, f, o = s[..., :h], s[..., h : 2 * h], s[..., 2 * h :]
            dc = carry_c + dhid * o * (1 - tc * tc)
            dz = dzs[t]
            dz[..., :h], dz[..., h : 2 * h], dz[..., 2 * h : 3 * h] = dc * gg, dc * before, dhid * tc
            dz[..., : 3 * h] *= s * (1 - s)
            dz[..., 3 * h :] = dc * i * (1 - gg * gg)
            carry_h, carry_c = dz @ back, dc * f
        one_hot = np.zeros((steps * 2 * n, 2 * (SYMBOLS + 1)), em.dtype)
        one_hot[np.arange(len(one_hot)), both.ravel()] = 1
        g["E"] = (one_hot.T @ dzs.reshape(-1, 4 * h)).reshape(self.p["E"].shape)
        g["U"] = np.stack([hids[:, d].reshape(-1, h).T @ dzs[:, d].reshape(-1, 4 * h) for d in (0, 1)])
        g["b"] = dzs.sum(axis=(0, 2))[:, None]
        per = 1 / (n * steps)
        return float((z - gold).sum()) * per, {k: v * per for k, v in g.items()}

    def fit(self, x, y, epochs: int = 10, batch: int = 128, rate: float = 0.02, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {k: p.astype(np.float32) for k, p in self.p.items()}
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        step = 0
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                _, g = self.gradients(x[rows].T, y[rows].T)
                step += 1
                lr = rate * (1 - step / (total + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def decode(self, x) -> np.ndarray:
        """Viterbi tags, time x batch."""
        em, *_ = self.emissions(x)
        a, score = self.p["A"], em[0] + self.p["s"]
        back = np.empty(em.shape, dtype=np.int8)
        for t in range(1, len(em)):
            cand = score[:, :, None] + a[None]
            back[t] = cand.argmax(axis=1)
            score = cand.max(axis=1) + em[t]
        tags = np.empty(em.shape[:2], dtype=np.int8)
        tags[-1] = score.argmax(axis=1)
        rows = np.arange(em.shape[1])
        for t in range(len(em) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        return tags


def labelled_example(rng: random.Random, size: int = WINDOW) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated text of ``size`` characters and its labelled spans."""
    pick = lambda *xs: rng.choice(xs)
    num = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("aeiourstlnmdhcpbgkvé", k=rng.randint(2, 8)))

    def email():
        local = pick(word() + num(2), word() + "." + word(), word() + "." + num(2), word() + "_" + word(), word() + "+" + word())
        host = pick("mail" + num(1) + ".example.com", word() + "." + pick("com", "org", "net", "de", "example"), word() + "." + word() + ".com")
        return local + pick("@", "@", "@", " @ ", "@ ", "(@)") + host

    def phone():
        a, b, c, d = num(rng.randint(1, 2)), num(3), num(3), num(4)
        return pick(f"+{a} ({b}) {c}-{d}", f"+{a} {b} {c} {d}", f"({b}) {c}-{d}", f"{b}-{c}-{d}", f"00{a} {b} {c}{d}", f"+{a}{b}{c}{d}", f"({b}) {c} {d}")

    def card():
        body = num(15)
        n = next(body + d for d in "0123456789" if luhn(body + d))
        return pick("", "", "", " ", "-", ".", "/").join(n[i : i + 4] for i in range(0, 16, 4))

    makers = {"email": email, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    noise = (
        lambda: num(rng.randint(1, 5)), lambda: pick("1", "2", "3") + "." + num(1) + ".", lambda: num(4) + "-" + num(2) + "-" + num(2), lambda: "".join(rng.choices("0123456789abcdef", k=40)), lambda: num(2) + "." + num(2),
        lambda: num(2) + ":" + num(2), lambda: "@" + word(), lambda: word() + num(3), lambda: num(rng.randint(20, 29)), lambda: "v" + num(1) + "." + num(1) + "." + num(1), lambda: "Version 2.0.", lambda: "https://" + word() + ".example.com/" + num(4),
    )
    text, spans = "", []
    while len(text) < size + 40:
        r = rng.random()
        if r < 0.18:
            kind = pick(*KINDS)
            s = makers[kind]()
            spans.append((kind, len(text), len(text) + len(s)))
            text += s
        elif r < 0.30:
            text += pick(*noise)()
        else:
            text += pick(word(), word(), word().capitalize())
        text += pick(" ", " ", " ", " ", ", ", ". ", "\n", "!! ", "### ", '" "', " | ")
    cut = rng.randint(0, 40)
    return text[cut : cut + size], [(k, max(0, a - cut), min(size, b - cut)) for k, a, b in spans if b > cut and a < cut + size]


def labelled_windows(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    x, y = np.empty((n, WINDOW), dtype=np.int64), np.zeros((n, WINDOW), dtype=np.int64)
    for i in range(n):
        text, spans = labelled_example(rng)
        x[i] = codes(text)
        for kind, a, b in spans:
            k = KINDS.index(kind)
            y[i, a:b] = 2 + 2 * k
            y[i, a] = 1 + 2 * k
    return x, y


@lru_cache(maxsize=2)
def trained(windows: int = 4000, epochs: int = 10, seed: int = 11) -> Tagger:
    return Tagger().fit(*labelled_windows(windows, seed), epochs=epochs)


def tagged_spans(tagger: Tagger, texts: list[str], batch: int = 1024, every: bool = False) -> list[list[tuple[str, int, int]]]:
    """Spans of each text: overlapping windows decoded, then reconciled over the whole text."""
    held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    jobs: list[tuple[int, int]] = []
    for n, text in enumerate(texts):
        if not text or not (every or TRIGGER.search(text)):
            continue
        c = codes(text)
        windows = 1 if len(c) <= WINDOW else 1 - (WINDOW - len(c)) // CENTRE
        own = np.arange(windows) if every else np.unique(np.clip((np.flatnonzero(_IS_TRIGGER[c]) - EDGE) // CENTRE, 0, windows - 1))
        asked = np.zeros(windows, dtype=bool)
        asked[own] = True
        held[n] = (c, np.zeros(len(c), dtype=np.int8), asked)
        jobs += [(n, k) for k in own.tolist()]
    while jobs:
        more = []
        for s in range(0, len(jobs), batch):
            part = jobs[s : s + batch]
            x = np.full((len(part), WINDOW), PAD, dtype=np.int64)
            for row, (n, k) in zip(x, part, strict=True):
                piece = held[n][0][k * CENTRE : k * CENTRE + WINDOW]
                row[: len(piece)] = piece
            found = tagger.decode(x.T)
            for i, (n, k) in enumerate(part):
                c, tags, asked = held[n]
                at = k * CENTRE
                a = at + EDGE if k else 0
                b = at + CENTRE + EDGE if k + 1 < len(asked) else len(c)
                tags[a:b] = found[a - at : b - at, i]
                for near, edge in ((k - 1, tags[a] and tags[a] % 2 == 0), (k + 1, tags[b - 1] != 0)):
                    if edge and 0 <= near < len(asked) and not asked[near]:
                        asked[near] = True
                        more.append((n, near))
        jobs = more
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for n, (_, tags, _) in held.items():
        at, end = 0, 0
        for at in np.flatnonzero(tags).tolist():
            if at < end:
                continue
            kind, end = (tags[at] - 1) // 2, at + 1
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            out[n].append((KINDS[kind], at, end))
    return out


def accept(kind: str, s: str) -> bool:
    """What a span found by the tagger must satisfy on top."""
    if kind == "email":
        return s.count("@") == 1 and bool(re.fullmatch(r"\S[^@]*@\)?\s?[^\s@]+\.[^\s@]{2,}", s)) and s[-1].isalnum()
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", s)) and valid("ip", s)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]([ ./-]?[0-9])+", s)) and valid("card", s)
    return bool(re.fullmatch(r"[+(]?[0-9][\x20().0-9-]+[0-9]", s)) and 9 <= len(digits_of(s)) <= 15 and len(digits_of(s)) < len(s)


def spans_of(tagger: Tagger, texts: list[str], every: bool = False) -> tuple[list[list], list[list]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
    found = tagged_spans(tagger, texts, every=every)
    added = []
    for text, own, more in zip(texts, base, found, strict=True):
        taken = sorted((a, b) for _, a, b in own)
        reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
        new = []
        for kind, a, b in more:
            k = bisect.bisect_left(taken, (b, -1))
            if (not k or reach[k - 1] <= a) and accept(kind, text[a:b]) and not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum()):
                new.append((kind, a, b))
        added.append(new)
    return base, added


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans per kind, base_sha256, spans (base and added), n_added."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(trained())

    def find(batches):
        for part in (part for batch in batches for part in slices(batch, "text", SLICE)):
            base, added = spans_of(held.value, strings(part.column("text")).to_pylist())
            n = [[sum(s[0] == k for s in own) for own in base] for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in n), pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array([joined(b + a) for b, a in zip(base, added, strict=True)], pa.string()), pa.array([len(a) for a in added], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return own.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Spans replaced by ``[KIND]``; where spans overlap, the run they cover takes the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced; all columns stay, n_chars (if there) follows the text."""
    spark = docs.sparkSession
    ship(spark)
    held, schema = spark.sparkContext.broadcast(trained()), docs.schema

    def run(batches):
        for part in (part for batch in batches for part in slices(batch, "text", SLICE)):
            texts = part.column("text").to_pylist()
            out = list(texts)
            whole = [t or "" for t in texts]
            for k, (b, a) in enumerate(zip(*spans_of(held.value, whole), strict=True)):
                if b or a:
                    out[k] = redact_text(whole[k], b + a)
            columns = []
            for name in part.schema.names:
                if name == "text":
                    columns.append(pa.array(out, pa.string()))
                elif name == "n_chars":
                    columns.append(pa.array([old if new is same or new is None else len(new) for old, new, same in zip(part.column(name).to_pylist(), out, texts, strict=True)], part.column(name).type))
                else:
                    columns.append(part.column(name))
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, schema)
