"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, by a cogroup of postings.

Side A encodes space + text with a byte-level tokenizer, side B the text with a piece model that adds the
space itself. Byte offsets at which tokens of both sides end cut a text into groups; a link is a pair of
token occurrences whose byte ranges overlap.

Steps:

1. Every slice of texts is encoded and linked. Each text's pairs with their multiplicities become postings,
   written as one block per slice and range of A ids, beside one row per text.
2. Texts per pair are counted within tasks and summed by pair; the highest count of each A id is joined back
   (one row per A id: bounded by the vocabulary).
3. Postings and counts are cogrouped by (range of A ids, range of slices). Spark sorts both streams and spills
   them; slices are dealt over as many ranges as keep a group near ``GROUP_BYTES``, so an id that is in every
   text is spread over all of them. Within a group every posting finds its count and whether it is its A id's
   highest, and contributions are added up by text: one row per slice and range.
4. Contributions are cogrouped with the texts' rows by slice and summed by text.

Texts are cut at single spaces between characters that are not white space: no token of either side reaches
across such a space, so distinct words are encoded and linked once and kept in a bounded memo. Other texts
are encoded whole.

Defined results: texts that are null or empty, or whose joined A or B bytes differ from space + text (a
literal U+2581 does), have no tokens: zeros and an empty ``groups_sha256``; repeated rows count as texts of
their own; a null doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import discard, ranges, save, ship, slices, strings, text_or_empty
from parlance.llm.encoding import WordEncoder, loose

RANGES = 64
GROUP_BYTES = 16_000_000
MEMO_WORDS, MEMO_BYTES = 250_000, 8_000_000
JOIN_WORDS = 400_000
LOW = np.int64((1 << 24) - 1)


def byte_level_bytes(tokens: list[str]) -> list[bytes]:
    """Byte-level vocabulary entries as bytes: printable Latin-1 stands for itself, the other bytes for U+0100 onwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens]


class Side:
    """A vocabulary's bytes: of each id its bytes in one flat array."""

    def __init__(self, entries: list[bytes]):
        self.size = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.text = pa.array([str(i) for i in range(len(entries))])

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.start[ids], self.size[ids])]


class Links:
    """Some units' links: counts per unit, flat pairs (A id * 2**32 + B id, one per link) and group texts."""

    def __init__(self, n_a, n_b, n_groups, n_links, pairs, groups: pa.Array):
        self.n = np.stack([n_a, n_b, n_groups, n_links], axis=1)
        self.pairs, self.groups = pairs, groups
        self.start = np.cumsum(n_links) - n_links


def _cut(counts: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(counts)], pa.int32())


class Linker:
    """Encodes units (each with the space before it) by both tokenizers and links them."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.words = WordEncoder(path_a)
        self.words.tokenizer.encode_special_tokens = True
        if self.words.drops_space:
            raise ValueError("side A must be a byte-level tokenizer")
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size = self.words.tokenizer.get_vocab_size()
        self.a = Side(byte_level_bytes([self.words.tokenizer.id_to_token(i) or "" for i in range(size)]))
        p = self.pieces
        self.b = Side([bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())])
        self.reset()

    def reset(self) -> None:
        self.memo: list[pa.Array] = []
        self.held: Links | None = None
        self.memo_bytes = 0

    def _pieces(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.pieces.encode(units, num_threads=1)
        n = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        return np.fromiter((i for x in got for i in x), dtype=np.int64, count=int(n.sum())), n

    def link(self, units: list[str], single_words: bool) -> Links:
        """``units`` without the space before them; ``single_words``: none holds a space or begins or ends with white space."""
        if single_words:
            ids_a, n_a = self.words.inner.learn(units)
        else:
            got = self.words.library([" " + u for u in units])
            ids_a, n_a = np.concatenate([*got, np.zeros(0, np.uint32)]), np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        ids_a, n_a = ids_a.astype(np.int64), n_a.astype(np.int64)
        ids_b, n_b = self._pieces(units)
        whole = [(" " + u).encode() for u in units]
        size = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        true = np.frombuffer(b"".join(whole), dtype=np.uint8)
        good = np.ones(len(units), dtype=bool)
        for side, ids, n in ((self.a, ids_a, n_a), (self.b, ids_b, n_b)):
            made = np.diff(np.r_[0, np.cumsum(side.size[ids])][np.r_[0, np.cumsum(n)]])
            got = side.bytes_of(ids)
            if len(got) == len(true) and (made == size).all() and (got == true).all():
                continue
            at, own = np.cumsum(made) - made, np.cumsum(size) - size
            good &= [m == s and bytes(got[x : x + m]) == bytes(true[y : y + s]) for m, s, x, y in zip(made.tolist(), size.tolist(), at.tolist(), own.tolist(), strict=True)]
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b, size = np.where(good, n_a, 0), np.where(good, n_b, 0), np.where(good, size, 0)
        return self._overlaps(ids_a, n_a, ids_b, n_b, np.cumsum(size))

    def _overlaps(self, ids_a, n_a, ids_b, n_b, unit_end) -> Links:
        # Bytes of all units lie one after the other, so ends are offsets in one sequence.
        end_a, end_b = np.cumsum(self.a.size[ids_a]), np.cumsum(self.b.size[ids_b])
        start_a, start_b = end_a - self.a.size[ids_a], end_b - self.b.size[ids_b]
        first = np.searchsorted(end_b, start_a, side="right")
        per = np.searchsorted(start_b, end_a, side="left") - first
        pairs = np.repeat(ids_a << 32, per) | ids_b[ranges(first, per)]
        of_unit = lambda flat, n: np.diff(np.r_[0, np.cumsum(flat)][np.r_[0, np.cumsum(n)]])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        n_groups = np.diff(np.searchsorted(common, np.r_[0, unit_end], side="right"))
        texts = []
        for side, ids, end in ((self.a, ids_a, end_a), (self.b, ids_b, end_b)):
            per_group = np.diff(np.r_[0, np.searchsorted(end, common, side="right")])
            texts.append(pc.binary_join(pa.ListArray.from_arrays(_cut(per_group), side.text.take(pa.array(ids))), ","))
        joined = pc.binary_join_element_wise(*texts, "|")
        groups = pc.binary_join(pa.ListArray.from_arrays(_cut(n_groups), joined), ";")
        return Links(n_a, n_b, n_groups, of_unit(per, n_a), pairs, groups)

    def places(self, words: pa.Array) -> np.ndarray:
        """Place of each of some distinct words in the memo."""
        at, missing, new = np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=bool), words
        if self.held is not None:
            found = pc.index_in(words, value_set=pa.chunked_array(self.memo))
            missing = np.asarray(found.is_null())
            at = np.asarray(pc.fill_null(found, 0), dtype=np.int64).copy()
            new = words.filter(pa.array(missing))
            if len(self.held.n) + len(new) > MEMO_WORDS or self.memo_bytes > MEMO_BYTES:
                self.reset()
                at, missing, new = np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=bool), words
        if not len(new):
            return at
        more = self.link(new.to_pylist(), single_words=True)
        had = self.held
        at[missing] = (0 if had is None else len(had.n)) + np.arange(len(new))
        if had is not None:
            n = np.concatenate([had.n, more.n])
            more = Links(*n.T, np.concatenate([had.pairs, more.pairs]), pa.concat_arrays([had.groups, more.groups]))
        self.held = more
        self.memo = [pa.concat_arrays([*self.memo, new])]
        self.memo_bytes += new.nbytes
        return at

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its four counts and the digest of its groups; postings (pair, text, multiplicity), sorted by pair and text."""
        n_texts = len(texts)
        parts = pc.split_pattern(texts, " ")
        counts = np.diff(np.asarray(parts.offsets, dtype=np.int64))
        coded = parts.flatten().dictionary_encode()
        distinct, code = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        del parts, coded
        owner = np.repeat(np.arange(n_texts), counts)
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        odd = loose(distinct)
        direct = np.zeros(n_texts, dtype=bool)
        direct[owner[odd[code]]] = True
        # A literal U+2581 becomes a space on side B, so such a text has no tokens.
        none = empty | np.asarray(pc.match_substring(texts, "▁"))
        keep = ~(direct | none)[owner]
        owner, code = owner[keep], code[keep]
        used = np.zeros(len(distinct), dtype=bool)
        used[code] = True
        renumber = np.cumsum(used) - 1
        own = distinct.filter(pa.array(used))
        at = self.places(own) if len(own) else np.zeros(0, dtype=np.int64)
        code = renumber[code]
        sums = np.zeros((n_texts, 4), dtype=np.int64)
        digests = [hashlib.sha256() for _ in range(n_texts)]
        found = []
        if len(own):
            held = self.held
            word_n = held.n[at][code]
            bounds = np.r_[0, np.cumsum(np.bincount(owner, minlength=n_texts))]
            sums += np.diff(np.r_[np.zeros((1, 4), np.int64), np.cumsum(word_n, axis=0)][bounds], axis=0)
            self._digest(digests, held.groups, at[code], bounds)
            pair_n = held.n[at, 3]
            found.append(self._postings(held.pairs[ranges(held.start[at], pair_n)], pair_n, owner, code, n_texts))
        rows = np.flatnonzero(direct & ~none)
        if len(rows):
            more = self.link(texts.take(pa.array(rows)).to_pylist(), single_words=False)
            sums[rows] += more.n
            for r, g in zip(rows.tolist(), more.groups, strict=True):
                digests[r].update(g.as_buffer())
            found.append(self._postings(more.pairs, more.n[:, 3], rows, np.arange(len(rows)), n_texts))
        pair, text, mult = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64) for _ in range(3))
        if len(found) > 1:
            order = np.lexsort((text, pair))
            pair, text, mult = pair[order], text[order], mult[order]
        return sums, [d.hexdigest() if n else "" for d, n in zip(digests, sums[:, 0].tolist(), strict=True)], pair, text, mult

    @staticmethod
    def _digest(digests: list, groups: pa.Array, at: np.ndarray, bounds: np.ndarray) -> None:
        """Groups of each text's words, joined; long texts some words at a time."""
        runs = [(t, a, min(b, a + JOIN_WORDS)) for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)) for a in range(a, b, JOIN_WORDS)]
        i = 0
        while i < len(runs):
            z = i + 1
            while z < len(runs) and runs[z][2] - runs[i][1] <= JOIN_WORDS:
                z += 1
            part = runs[i:z]
            lists = pa.ListArray.from_arrays(_cut(np.array([b - a for _, a, b in part])), groups.take(pa.array(at[part[0][1] : part[-1][2]])))
            for (t, a, _), text in zip(part, pc.binary_join(lists, ";"), strict=True):
                if a > bounds[t]:
                    digests[t].update(b";")
                digests[t].update(text.as_buffer())
            i = z

    @staticmethod
    def _postings(unit_pairs, pair_n, owner, code, n_texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        units = len(pair_n)
        both, times = np.unique(owner * units + code, return_counts=True)
        text, unit = both // max(units, 1), both % max(units, 1)
        pairs, slot = np.unique(unit_pairs, return_inverse=True)
        start = np.cumsum(pair_n) - pair_n
        n = pair_n[unit]
        key = slot[ranges(start[unit], n)] * np.int64(n_texts) + np.repeat(text, n)
        weight = np.repeat(times, n)
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        mult = np.add.reduceat(weight, first) if len(first) else np.zeros(0, np.int64)
        key = key[first]
        return pairs[key // n_texts], key % n_texts, mult


_LINKERS: dict[tuple[str, str], Linker] = {}


def linker(path_a: str, path_b: str) -> Linker:
    """One linker per pair of files and Python worker; the memo lives as long as the worker."""
    if (path_a, path_b) not in _LINKERS:
        _LINKERS.clear()
        _LINKERS[path_a, path_b] = Linker(path_a, path_b)
    return _LINKERS[path_a, path_b]


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes each that hold them all."""
    top = int(values.max(initial=0))
    return values.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{len(data) // count}" if count else "u1").astype(np.int64)


DOCS = "doc_id long, at int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCK = "ids int, pairs binary, n binary, texts binary, times binary"


def _link_slices(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds: a text's own row (``ids`` null), and a block of postings of a slice and a range of A ids."""

    def run(batches):
        link, base, k = linker(path_a, path_b), TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for part in slices(batch, "text"):
                n, (sums, digests, pair, text, mult) = part.num_rows, link.texts(strings(part.column("text")))
                where = base + k
                k += 1
                of = lambda rows: [pa.array([where] * rows, pa.int64())]  # noqa: E731,B023
                none = [pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(4))]
                own = [part.column("doc_id"), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(c) for c in sums.T), pa.array(digests, pa.string())]
                names = ["slice", *(c.split()[0] for c in DOCS.split(", ")), *(c.split()[0] for c in BLOCK.split(", "))]
                yield pa.RecordBatch.from_arrays([*of(n), *own, *none], names=names)
                of_range = (pair >> 32) % RANGES
                order = np.argsort(of_range, kind="stable")
                cut = np.r_[0, np.cumsum(np.bincount(of_range, minlength=RANGES))]
                rows = []
                for r in range(RANGES):
                    own = order[cut[r] : cut[r + 1]]
                    if len(own):
                        pairs, first = np.unique(pair[own], return_index=True)
                        rows.append((r, pairs.tobytes(), _packed(np.diff(np.r_[first, len(own)])), _packed(text[own]), _packed(mult[own])))
                if rows:
                    m = len(rows)
                    none = [pa.nulls(m, t) for t in (pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.string())]
                    kinds = (pa.int32(), *[pa.binary()] * 4)
                    yield pa.RecordBatch.from_arrays([*of(m), *none, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return own.mapInArrow(run, f"slice long, {DOCS}, {BLOCK}")


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n): texts that hold the pair linked; added up within a task first."""

    def run(batches, most: int = 2_000_000):
        held, late = (np.zeros(0, np.int64), np.zeros(0, np.int64)), []

        def added(parts):
            pair, slot = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            return pair, np.bincount(slot, weights=np.concatenate([n for _, n in parts]), minlength=len(pair)).astype(np.int64)

        def rows(held):
            for at in range(0, len(held[0]), 100_000):
                pair, n = (x[at : at + 100_000] for x in held)
                yield pa.RecordBatch.from_pydict({"a": pair >> 32, "b": pair & 0xFFFFFFFF, "n": n})

        for batch in batches:
            for p, n in zip(batch.column("pairs").to_pylist(), batch.column("n").to_pylist(), strict=True):
                late.append((np.frombuffer(p, dtype=np.int64), _unpacked(n, len(p) // 8)))
                if sum(len(x[0]) for x in late) > most:
                    held, late = added([held, *late]), []
                    if len(held[0]) > most:
                        yield from rows(held)
                        held = held[0][:0], held[1][:0]
        yield from rows(added([held, *late]))

    return blocks.select("pairs", "n").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _packed_counts(counts: DataFrame) -> DataFrame:
    """Counts as blocks by range of A ids: (ids, pairs, n, best)."""
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # a row per A id at most: the vocabulary bounds it

    def run(batches):
        for batch in batches:
            a, b, n = (np.asarray(batch.column(c), dtype=np.int64) for c in ("a", "b", "n"))
            best = np.asarray(batch.column("best")).astype(np.uint8)
            order = np.argsort(a % RANGES, kind="stable")
            cut = np.r_[0, np.cumsum(np.bincount(a % RANGES, minlength=RANGES))]
            own = [(r, order[cut[r] : cut[r + 1]]) for r in range(RANGES) if cut[r + 1] > cut[r]]
            yield pa.RecordBatch.from_pydict({
                "ids": pa.array([r for r, _ in own], pa.int32()), "pairs": pa.array([(a[o] << 32 | b[o]).tobytes() for _, o in own], pa.binary()),
                "n": pa.array([n[o].tobytes() for _, o in own], pa.binary()), "best": pa.array([best[o].tobytes() for _, o in own], pa.binary()),
            })

    joined = counts.join(F.broadcast(top), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))
    return joined.mapInArrow(run, "ids int, pairs binary, n binary, best binary")


def _contributions(key, postings: pa.Table, counts: pa.Table) -> pa.Table:
    """Of each slice in the group, what its postings add to ``n_best`` and ``count_sum`` of each text."""
    joined = lambda c, kind: np.frombuffer(b"".join(counts.column(c).to_pylist()), dtype=kind)
    pair, n, best = joined("pairs", np.int64), joined("n", np.int64), joined("best", np.uint8)
    order = np.argsort(pair)
    pair, n, best = pair[order], n[order], best[order].astype(np.int64)
    out = []
    for row in postings.to_pylist():
        own = np.frombuffer(row["pairs"], dtype=np.int64)
        at = np.searchsorted(pair, own)
        per = _unpacked(row["n"], len(own))
        total = int(per.sum())
        text, times, held = _unpacked(row["texts"], total), _unpacked(row["times"], total), np.repeat(at, per)
        count = n[held]
        sums = np.bincount(text, weights=times * (count & LOW)).astype(np.int64) + (np.bincount(text, weights=times * (count >> 24)).astype(np.int64) << 24)
        out.append((row["slice"], np.bincount(text, weights=times * best[held]).astype(np.int64).tobytes(), sums.tobytes()))
    kinds = {"slice": pa.int64(), "best": pa.binary(), "sums": pa.binary()}
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(kinds.items())})


def _summed(key, texts: pa.Table, added: pa.Table) -> pa.Table:
    size = int(np.asarray(texts.column("at")).max(initial=-1)) + 1
    totals = {}
    for name in ("best", "sums"):
        totals[name] = np.zeros(size, dtype=np.int64)
        for data in added.column(name).to_pylist():
            own = np.frombuffer(data, dtype=np.int64)
            totals[name][: len(own)] += own
    at = np.asarray(texts.column("at"))
    cols = {c: texts.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(cols | {"n_best": totals["best"][at], "count_sum": totals["sums"][at], "groups_sha256": texts.column("groups_sha256")})


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    ship(spark)
    linked = save(spark, _link_slices(docs, path_a, path_b), "linked")
    blocks = linked.where(F.col("ids").isNotNull()).select("slice", *(c.split()[0] for c in BLOCK.split(", ")))
    counts = save(spark, _pair_counts(blocks), "pair-counts")
    heaviest = blocks.groupBy("ids").agg(F.sum(F.length("pairs") + F.length("texts") + F.length("times")).alias("b")).agg(F.max("b")).first()[0] or 0
    spread = max(1, -(-heaviest // GROUP_BYTES))
    postings = blocks.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(spread)).cast("int"))
    counted = _packed_counts(counts).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    added = postings.groupBy("ids", "part").cogroup(counted.groupBy("ids", "part")).applyInArrow(_contributions, "slice long, best binary, sums binary")
    texts = linked.where(F.col("ids").isNull()).select("slice", *(c.split()[0] for c in DOCS.split(", ")))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = save(spark, texts.groupBy("slice").cogroup(added.groupBy("slice")).applyInArrow(_summed, schema), "aligned")
    discard(spark, linked, counts)
    return out
