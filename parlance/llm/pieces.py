"""SentencePiece encoding and decoding with seeded merge-dropout.

The vocabulary of a SentencePiece BPE model is applied by an agenda of merge candidates, best score
first, leftmost on ties. A candidate that comes up is skipped when a keyed hash of (seed, doc_id, place of
the part, span) falls below the dropout rate, so every occurrence of a word draws anew; with rate 0 the
ids are those of the library. A text is encoded part by part (spaces and the word after them: no piece of
the model reaches across). The distinct parts of a slice of texts run their agendas side by side in numpy,
one candidate each per step; a part's occurrences share its agenda as long as they skip alike and split
where they do not, so equal decisions are worked out once and each occurrence still has its own. Parts of
more than ``SIDE_BY_SIDE`` characters run alone.

Decoding joins the pieces and is lossless: characters without a piece, and a literal U+2581, go through
byte pieces.

Defined results: null text counts as empty and has no ids; a null doc_id keys as -1; repeated rows are
encoded alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import ranges, ship, slices, strings, text_or_empty
from parlance.llm.near_dedup import mix

SPACE = "▁"
MASK = (1 << 64) - 1
PARTS = re.compile(r" *[^ ]+| +")


SIDE_BY_SIDE = 48
NONE = np.int64(1 << 40)


class PairTable:
    """(left id, right id) -> rank * 2**32 + merged id, as an open-addressed table."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (3 * len(pairs)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.full(1 << self.bits, -1, dtype=np.int64)
        key = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        value = np.array(list(pairs.values()), dtype=np.int64)
        at = self.slot(key)
        while len(key):
            free = self.key[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.key[at[put]], self.value[at[put]] = key[put], value[put]
            left = np.ones(len(key), dtype=bool)
            left[put] = False
            key, value, at = key[left], value[left], (at[left] + 1) & (len(self.key) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Values, -1 where there is no such pair; ids of -1 pair with nothing."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), left << 32 | right)
        out = np.full(len(key), -1, dtype=np.int64)
        rows, at = np.arange(len(key)), self.slot(key)
        while len(rows):
            held = self.key[at]
            hit = held == key[rows]
            out[rows[hit]] = self.value[at[hit]]
            go = ~hit & (held != -1)
            rows, at = rows[go], (at[go] + 1) & (len(self.key) - 1)
        return out


class PieceEncoder:
    """Encodes parts (spaces and a word) under the keys of their occurrences."""

    def __init__(self, path: str, rate: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("pieces reach across spaces")
        order = sorted({-model.get_score(i) for i in plain})
        place = {s: k for k, s in enumerate(order)}
        held = Counter(model.get_score(i) for i in plain if len(pieces[i]) > 1)
        #: Whether several pieces have the score of a rank; the last entry stands for no piece.
        self.tied = np.array([held[-s] > 1 for s in order] + [False])
        self.rank = {pieces[i]: place[-model.get_score(i)] for i in plain}
        self.ids = {pieces[i]: i for i in plain}
        byte_ids = {pieces[i]: i for i in range(size) if model.is_byte(i)}
        self.byte_id = [byte_ids[f"<0x{b:02X}>"] for b in range(256)]
        self.decoded = [b""] * size
        for i in plain:
            self.decoded[i] = pieces[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.decoded[i] = bytes([b])
        self.limit, self.seed = min(int(rate * (1 << 64)), MASK), seed
        # Symbols are pieces, or characters that occur only inside of pieces (numbered after them).
        symbol = dict(self.ids)
        for piece in list(symbol):
            for c in piece:
                symbol.setdefault(c, size + len(symbol))
        self.symbol = {c: i for c, i in symbol.items() if len(c) == 1}
        self.is_piece = np.zeros(max(symbol.values()) + 1, dtype=bool)
        self.is_piece[plain] = True
        self.pairs = PairTable({(symbol[a], symbol[b]): self.rank[p] << 32 | self.ids[p] for p in self.ids for k in range(1, len(p)) if (a := p[:k]) in symbol and (b := p[k:]) in symbol})

    def part(self, text: str, key: int) -> list[int]:
        """Ids of one occurrence of a part: a plain agenda."""
        sym: list = [SPACE if c == " " else c if c != SPACE else "" for c in text]
        n, rank, limit = len(sym), self.rank, self.limit
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if sym[i] and sym[i + 1] and (r := rank.get(sym[i] + sym[i + 1])) is not None:
                heap.append((r, i, i + 1, 2))
        heapify(heap)
        while heap:
            _, i, j, size = heappop(heap)
            left, right = sym[i], sym[j] if j < n else None
            if not left or not right or after[i] != j or len(left) + len(right) != size:
                continue
            if limit:
                h = ((key ^ (i * 0x9E3779B97F4A7C15 + j * 0xC2B2AE3D27D4EB4F + size) & MASK) * 0xBF58476D1CE4E5B9) & MASK
                if (((h ^ (h >> 31)) * 0x94D049BB133111EB) & MASK) < limit:
                    continue
            new = sym[i] = left + right
            sym[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if sym[k] and (r := rank.get(new + sym[k])) is not None:
                    heappush(heap, (r, i, k, size + len(sym[k])))
            p = before[i]
            if p >= 0 and sym[p] and (r := rank.get(sym[p] + new)) is not None:
                heappush(heap, (r, p, i, size + len(sym[p])))
        out, ids = [], self.ids
        for s in sym:
            if s is None:
                continue
            got = ids.get(s)
            out += [got] if got is not None else [self.byte_id[b] for b in (s or SPACE).encode()]
        return out

    def _block(self, parts: list[str], state: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids and ids per state, and each occurrence's state: the agendas of all parts side by side.

        ``state`` is the part of each occurrence, ``key`` its key; states beyond the parts come of splits.
        """
        n = used = len(parts)
        size = np.fromiter(map(len, parts), dtype=np.int64, count=n)
        width = int(size.max(initial=1))
        symbol, space = self.symbol, self.symbol.get(SPACE, -1)
        rows = np.repeat(np.arange(n), size)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
        point = np.frombuffer("".join(parts).encode("utf-32-le"), dtype="<u4")
        known, inverse = np.unique(point, return_inverse=True)
        of = np.array([space if c == 32 else -1 if chr(c) == SPACE else symbol.get(chr(c), -1) for c in known.tolist()], dtype=np.int64)
        sym = np.full((n, width + 1), -1, dtype=np.int64)
        sym[rows, cols] = of[inverse]
        none = NONE << np.int64(20)
        found = self.pairs(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width)
        best = np.where(found >= 0, found, none)
        after = np.tile(np.arange(1, width + 2, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, width, dtype=np.int16), (n, 1))
        length = np.ones((n, width + 1), dtype=np.int16)
        gone = np.zeros((n, width + 1), dtype=bool)
        origin = np.arange(n)
        live = np.arange(n)
        state = state.copy()
        open_ = np.arange(len(state)) if self.limit else np.zeros(0, np.int64)
        limit = np.uint64(self.limit)
        while len(live):
            i = best[live].argmin(axis=1)
            value = best[live, i]
            # Of pieces of equal score the leftmost goes first, whatever its id (the lower half).
            tied = np.flatnonzero(self.tied[np.minimum(value >> 32, len(self.tied) - 1)])
            if len(tied):
                i[tied] = (best[live[tied]] >> 32).argmin(axis=1)
                value[tied] = best[live[tied], i[tied]]
            go = value < none
            live, i, value = live[go], i[go], value[go]
            if not len(live):
                break
            j = after[live, i].astype(np.int64)
            if self.limit:
                span = np.zeros(used, dtype=np.uint64)
                on = np.zeros(used, dtype=bool)
                on[live] = True
                span[live] = i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + j.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + (length[live, i] + length[live, j]).astype(np.uint64)
                open_ = open_[on[state[open_]]]
                own = state[open_]
                h = (key[open_] ^ span[own]) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                skip = h < limit
                skipping, all_ = np.bincount(own[skip], minlength=used)[live], np.bincount(own, minlength=used)[live]
                parted = np.flatnonzero((skipping > 0) & (skipping < all_))
                if len(parted):  # those that skip go on in a state of their own
                    more = used + len(parted)
                    if more > len(sym):
                        room = max(more, 2 * len(sym)) - len(sym)
                        sym, best, after, before, length, gone = (np.concatenate([x, np.empty((room, x.shape[1]), x.dtype)]) for x in (sym, best, after, before, length, gone))
                        origin = np.concatenate([origin, np.empty(room, origin.dtype)])
                    old, new = live[parted], np.arange(used, more)
                    for x in (sym, best, after, before, length, gone, origin):
                        x[new] = x[old]
                    best[new, i[parted]] = none
                    to = np.zeros(used, dtype=np.int64)
                    to[old] = new
                    moved = skip & (to[own] > 0)
                    state[open_[moved]] = to[own[moved]]
                    used = more
                take = skipping < all_
                best[live, i] = none
                r, i, j, value = live[take], i[take], j[take], value[take]
                if len(parted):
                    live = np.concatenate([live, new])
                if not len(r):
                    continue
            else:
                best[live, i] = none
                r = live
            sym[r, i] = value & np.int64(0xFFFFFFFF)
            length[r, i] += length[r, j]
            gone[r, j] = True
            best[r, np.minimum(j, width - 1)] = np.where(j < width, none, best[r, np.minimum(j, width - 1)])
            k = after[r, j].astype(np.int64)
            after[r, i] = k
            inside = k <= width - 1
            before[r[inside], k[inside]] = i[inside]
            right = np.where(inside, sym[r, np.minimum(k, width)], -1)
            got = self.pairs(sym[r, i], right)
            best[r, i] = np.where(got >= 0, got, none)
            p = before[r, i].astype(np.int64)
            has = p >= 0
            rp, pp = r[has], p[has]
            got = self.pairs(sym[rp, pp], sym[rp, i[has]])
            best[rp, pp] = np.where(got >= 0, got, none)
        count = size[origin[:used]]
        rows = np.repeat(np.arange(used), count)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        keep = ~gone[rows, cols]
        rows, cols, first = rows[keep], cols[keep], sym[rows[keep], cols[keep]]
        as_bytes = (first < 0) | ~self.is_piece[np.maximum(first, 0)]
        if not as_bytes.any():
            return first.astype(np.uint32), np.bincount(rows, minlength=used), state
        count = np.ones(len(first), dtype=np.int64)
        where = np.flatnonzero(as_bytes)
        spelled = [[self.byte_id[b] for b in parts[o][c].encode()] for o, c in zip(origin[rows[where]].tolist(), cols[where].tolist(), strict=True)]
        count[where] = [len(x) for x in spelled]
        out = np.repeat(first, count)
        start = np.cumsum(count) - count
        out[ranges(start[where], count[where])] = [b for x in spelled for b in x]
        return out.astype(np.uint32), np.bincount(rows, weights=count, minlength=used).astype(np.int64), state

    def encode_parts(self, parts: list[str], code: np.ndarray, key: np.ndarray, block: int = 16_384) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and the start and number of the ids of each occurrence (``code``: its part)."""
        size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        order = np.argsort(size, kind="stable")
        rank = np.empty(len(parts), dtype=np.int64)
        rank[order] = np.arange(len(parts))
        split = int(np.searchsorted(size[order], SIDE_BY_SIDE))
        ranked = rank[code]
        by_part = np.argsort(ranked, kind="stable")
        bound = np.concatenate([[0], np.cumsum(np.bincount(ranked, minlength=len(parts)))])
        flat, used = [], 0
        start, length = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for a in range(0, split, block):
            z = min(split, a + block)
            own = by_part[bound[a] : bound[z]]
            ids, n, state = self._block([parts[i] for i in order[a:z].tolist()], ranked[own] - a, key[own])
            start[own], length[own] = (used + np.cumsum(n) - n)[state], n[state]
            flat.append(ids)
            used += len(ids)
        for at in by_part[bound[split] :].tolist():
            ids = self.part(parts[code[at]], int(key[at]))
            start[at], length[at] = used, len(ids)
            flat.append(np.asarray(ids, dtype=np.uint32))
            used += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), start, length

    def encode_keyed(self, texts: pa.Array, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and ids per text."""
        texts = strings(texts)
        split = pc.split_pattern(texts, " ")
        counts = np.asarray(pc.list_value_length(split), dtype=np.int64)
        flat = split.flatten()
        empty = np.asarray(pc.equal(pc.binary_length(flat), 0))
        owner = np.repeat(np.arange(len(counts)), counts)
        spaced = np.zeros(len(counts), dtype=bool)
        spaced[owner[empty]] = True
        coded = flat.dictionary_encode()
        parts, code = [" " + w for w in coded.dictionary.to_pylist()], np.asarray(coded.indices, dtype=np.int64)
        if spaced.any():
            keep = ~spaced[owner]
            more, rows = {}, np.flatnonzero(spaced)
            late = [[more.setdefault(p, len(parts) + len(more)) for p in (PARTS.findall(" " + t) if t else [])] for t in texts.take(pa.array(rows)).to_pylist()]
            parts += list(more)
            code = np.concatenate([code[keep], np.array([c for x in late for c in x], dtype=np.int64)])
            owner = np.concatenate([owner[keep], np.repeat(rows, [len(x) for x in late])])
            order = np.argsort(owner, kind="stable")
            code, owner = code[order], owner[order]
            counts = np.bincount(owner, minlength=len(counts))
        first = np.cumsum(counts) - counts
        key = self.keys(doc_ids[owner], np.arange(len(code)) - first[owner])
        pool, starts, n = self.encode_parts(parts, code, key)
        return pool[ranges(starts, n)], np.bincount(owner, weights=n, minlength=len(counts)).astype(np.int64)

    def keys(self, doc_id: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Key of each occurrence: a hash of (seed, doc_id, place)."""
        return mix(mix(doc_id.astype(np.int64).view(np.uint64) + np.uint64(self.seed)) + place.astype(np.uint64))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.decoded.__getitem__, ids))[1:].decode()


_ENCODERS: dict[tuple, PieceEncoder] = {}


def piece_encoder(path: str, rate: float, seed: int) -> PieceEncoder:
    key = (path, rate, seed)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


def _own(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def encode(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """(doc_id, ids array<int>)."""

    def run(batches):
        enc = piece_encoder(model, rate, seed)
        for batch in batches:
            for part in slices(batch, "text", 10_000_000):
                ids, n = enc.encode_keyed(part.column("text"), np.asarray(part.column("doc_id").fill_null(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return _own(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    ship(encoded.sparkSession)

    def run(batches):
        enc = piece_encoder(model, 0.0, 0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([enc.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (as unsigned 32-bit), lossless: whether the ids decode to the text."""

    def run(batches):
        enc = piece_encoder(model, rate, seed)
        for batch in batches:
            for part in slices(batch, "text", 10_000_000):
                texts = strings(part.column("text")).to_pylist()
                ids, n = enc.encode_keyed(part.column("text"), np.asarray(part.column("doc_id").fill_null(-1)))
                cut = np.r_[0, np.cumsum(n)].tolist()
                flat, view = ids.tolist(), memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                same = [enc.decode(flat[a:b]) == t for a, b, t in zip(cut[:-1], cut[1:], texts, strict=True)]
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "ids_crc32", "lossless"])

    return _own(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")
