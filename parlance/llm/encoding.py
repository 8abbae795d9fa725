"""Whole-text encoding with a public tokenizer, by way of its words and a memo of their ids.

A text is cut at single spaces that stand between two characters that are not white space. A byte-level
tokenizer's split pattern joins no characters across such a space (the space itself belongs to the next
word), so the ids of the parts joined are the ids of the text; a text with other white space next to a
space is encoded whole. A tokenizer that drops white space is cut at every run of ASCII white space.
Which of the two a tokenizer is, is probed. Distinct words are looked up in Arrow; new ones go to the
library some hundred at a time and their ids are cut apart again at the ids that begin a word, or at a
sentinel word; where the number of cuts is not that of the words, they are encoded one by one.
The memo is bounded: it starts again beyond ``MEMO_WORDS`` words or ``MEMO_BYTES`` of them.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parlance.llm.common import ranges, strings

MEMO_WORDS, MEMO_BYTES = 500_000, 24_000_000
TOGETHER, TOGETHER_CHARS = 256, 8192
SENTINEL = "\x01"


def edges(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, last byte and bytes of each word (0 where it is empty)."""
    at = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(at)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
    data = np.append(data, np.uint8(0))
    return np.where(size > 0, data[at[:-1]], 0), np.where(size > 0, data[np.maximum(at[1:] - 1, 0)], 0), size


def loose(words: pa.Array) -> np.ndarray:
    """Words that are empty, or begin or end with white space of any kind."""
    first, last, size = edges(words)
    plain = lambda b: (b > 32) & (b < 128)
    out = size == 0
    rows = np.flatnonzero(~out & ~(plain(first) & plain(last)))
    if len(rows):
        some = words.take(pa.array(rows))
        ends = [pc.utf8_is_space(pc.utf8_slice_codeunits(some, a, b)) for a, b in ((0, 1), (-1, None))]
        out[rows] = np.asarray(pc.or_(*ends))
    return out


class Memo:
    """Ids of words: ``learn`` maps a list of new words to (flat ids, ids per word)."""

    def __init__(self, learn):
        self.learn = learn
        self.reset()

    def reset(self) -> None:
        self.words: list[pa.Array] = []
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start = self.length = np.zeros(0, dtype=np.int64)
        self.used = self.bytes = 0

    def places(self, words: pa.Array) -> np.ndarray:
        """Place of each of some distinct words."""
        if self.words:
            found = pc.index_in(words, value_set=pa.chunked_array(self.words))
            missing = np.asarray(found.is_null())
            if not missing.any():
                return np.asarray(found, dtype=np.int64)
            at = np.asarray(pc.fill_null(found, 0), dtype=np.int64).copy()
            new = words.filter(pa.array(missing))
            if len(self.start) + len(new) > MEMO_WORDS or self.bytes > MEMO_BYTES:
                self.reset()
        if not self.words:
            at, missing, new = np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=bool), words
        if not len(new):
            return at
        ids, per = self.learn(new.to_pylist())
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        at[missing] = len(self.start) + np.arange(len(new))
        self.start = np.concatenate([self.start, self.used + np.cumsum(per) - per])
        self.length = np.concatenate([self.length, per])
        self.used += len(ids)
        self.bytes += int(edges(new)[2].sum())
        self.words.append(pa.concat_arrays([new]))
        if len(self.words) > 32:
            self.words = [pa.concat_arrays(self.words)]
        return at


class WordEncoder:
    """Encodes Arrow string arrays to flat ids and ids per text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        one = lambda t: self.library([t])[0].tolist()
        self.drops_space = one(" a \n\t b,") == one("a b,") == one("a") + one("b,")
        if self.drops_space:
            mark = one(SENTINEL)
            self.mark = mark[0] if len(mark) == 1 and one(f"a {SENTINEL} b {SENTINEL}") == one("a") + mark + one("b") + mark else None
            self.inner = self.opening = Memo(self._by_sentinel)
        else:
            size = self.tokenizer.get_vocab_size()
            self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
            self.inner, self.opening = Memo(self._by_beginning), Memo(self._singly)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _singly(self, words: list[str], before: str = "") -> tuple[np.ndarray, np.ndarray]:
        got = self.library([before + w for w in words])
        return np.concatenate([*got, np.zeros(0, np.uint32)]).astype(np.uint32), np.fromiter(map(len, got), dtype=np.int64, count=len(got))

    def _together(self, words: list[str], joint: str, before: str, after: str, cut) -> tuple[np.ndarray, np.ndarray]:
        groups, a = [], 0
        while a < len(words):
            z, size = a, 0
            while z < len(words) and z - a < TOGETHER and (z == a or size + len(words[z]) <= TOGETHER_CHARS):
                size += len(words[z])
                z += 1
            groups.append(words[a:z])
            a = z
        ids, per = [], []
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for group, got in zip(part, self.library([before + joint.join(g) + after for g in part]), strict=True):
                flat, n = cut(got)
                if len(n) != len(group):
                    flat, n = self._singly(group, before)
                ids.append(flat)
                per.append(n)
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([*per, np.zeros(0, np.int64)])

    def _by_beginning(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Every word has the space before it, and no other: its first id is the only one that begins with a space."""
        return self._together(words, " ", " ", "", lambda ids: (ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))))

    def _by_sentinel(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A sentinel word ends every word; words that hold it raise the number of cuts."""
        if self.mark is None:
            return self._singly(words)

        def cut(ids):
            at = np.flatnonzero(ids == self.mark)
            return ids[ids != self.mark], np.diff(at, prepend=-1) - 1

        return self._together(words, f" {SENTINEL} ", "", f" {SENTINEL}", cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = strings(texts)
        n = len(texts)
        parts = pc.ascii_split_whitespace(texts) if self.drops_space else pc.split_pattern(texts, " ")
        counts = np.diff(np.asarray(parts.offsets, dtype=np.int64))
        coded = parts.flatten().dictionary_encode()
        distinct, code = coded.dictionary, np.asarray(coded.indices, dtype=np.int64)
        del parts, coded
        bounds = np.r_[0, np.cumsum(counts)]
        if self.drops_space:
            at = self.inner.places(distinct)[code]
            lengths = self.inner.length[at]
            ids = self.inner.flat[ranges(self.inner.start[at], lengths)]
            return ids, np.diff(np.r_[0, np.cumsum(lengths)][bounds])
        odd = loose(distinct)
        # Of the empty text's one empty part nothing is encoded at all.
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        direct = np.diff(np.r_[0, np.cumsum(odd[code])][bounds]) > 0
        by_word = ~(direct | empty)
        first = bounds[:-1][by_word]
        inner = np.repeat(by_word, counts)
        inner[first] = False
        code_in = code[inner]
        used = np.zeros(len(distinct), dtype=bool)
        used[code_in] = True
        where = np.zeros(len(distinct), dtype=np.int64)
        where[used] = self.inner.places(distinct.filter(pa.array(used)))
        at = where[code_in]
        opening, slot = np.unique(code[first], return_inverse=True)
        at_first = self.opening.places(distinct.take(pa.array(opening)))[slot] if len(opening) else np.zeros(0, np.int64)
        lengths = np.zeros(len(code), dtype=np.int64)
        lengths[inner] = self.inner.length[at]
        lengths[first] = self.opening.length[at_first]
        per = np.diff(np.r_[0, np.cumsum(lengths)][bounds])
        rows = np.flatnonzero(direct)
        whole = self.library(texts.take(pa.array(rows)).to_pylist()) if len(rows) else []
        starts = np.cumsum(lengths) - lengths
        ids = np.empty(int(lengths.sum()), dtype=np.uint32)
        if len(first):
            held = lengths[first]
            ids[ranges(starts[first], held)] = self.opening.flat[ranges(self.opening.start[at_first], held)]
        hold = np.ones(len(ids), dtype=bool)
        hold[ranges(starts[first], lengths[first])] = False
        ids[hold] = self.inner.flat[ranges(self.inner.start[at], lengths[inner])]
        if not whole:
            return ids, per
        pieces, ends, late = [], np.cumsum(per), 0
        for r, got in zip(rows.tolist(), whole, strict=True):
            pieces += [ids[late : ends[r]], got]
            late = int(ends[r])
            per[r] = len(got)
        return np.concatenate([*pieces, ids[late:]]), per


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per tokenizer file and Python worker; the memo lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
