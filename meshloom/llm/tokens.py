"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

The vocabulary's pre-tokenizer cuts a text into short pieces and merges never cross them, so the ids of a text are
those of its pieces in order. Inside a task the pieces of a slice of documents are found with numpy, each distinct
piece is encoded by the library once and known by its hash in a table of slots, and its ids are laid out where the piece occurs. A long text is cut into several
slices where a piece ends. The table of known pieces starts anew between slices once it has ``KNOWN_PIECES``, never within
one, and a slice whose pieces are not all known is an error, so the table's size changes no result.

A vocabulary file that names another normalizer or pre-tokenizer is left to the library, text by text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np

from .textblocks import SHINGLE_CODE, mix64

KNOWN_PIECES = 600_000
SLICE_CHARS = 1 << 19
#: Slots of the table of known pieces at first, as a power of two; it grows so that half of them stay free.
TABLE_BITS = 20
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_CHAR_CODE = np.random.default_rng(7).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_P, _PINV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
#: Where a piece ends whatever comes before and after: before a blank, and between a letter and a digit.
_CUT = re.compile(r"\S(?=[\x20\n])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _kind(point: int) -> int:
    c = chr(point)
    # White_Space of Unicode, which is what \s means to the pre-tokenizer
    if point in (0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000) or 9 <= point <= 13 or 0x2000 <= point <= 0x200A:
        return _SPACE
    category = unicodedata.category(c)
    return _LETTER if category[0] == "L" else _NUMBER if category[0] == "N" else _OTHER


def _with_room(values: np.ndarray, used: int, n: int) -> np.ndarray:
    """An array of at least ``n`` entries, the first ``used`` those of ``values``."""
    if n <= len(values):
        return values
    out = np.empty(max(n, len(values) * 3 // 2), values.dtype)
    out[:used] = values[:used]
    return out


class Encoder:
    """Encodes many texts; one for each Python worker."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.size = self.library.get_vocab_size()
        self.known = KNOWN_PIECES
        with open(vocabulary, encoding="utf-8") as file:
            described = json.load(file)
        cutter = described.get("pre_tokenizer") or {}
        self.plain = described.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("add_prefix_space") is False and cutter.get("use_regex", True) is True
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kinds = np.full(0x110000, 255, np.uint8)
        self._grow(SLICE_CHARS)
        self._forget()

    def _forget(self) -> None:
        self.n_keys = self.n_ids = 0
        self.keys, self.at, self.lengths = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)  # at: where the ids of each key start
        self.ids = np.empty(0, np.uint32)
        self._new_slots(TABLE_BITS)

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        if len(kinds) and kinds.max() == 255:
            for p in np.unique(points[kinds == 255]):
                self.kinds[p] = _kind(int(p))
            kinds = self.kinds[points]
        return kinds

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        encoded = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        first, n, n_ids = self.n_keys, self.n_keys + len(keys), self.n_ids + int(lengths.sum())
        self.keys, self.at, self.lengths = (_with_room(x, first, n) for x in (self.keys, self.at, self.lengths))
        self.ids = _with_room(self.ids, self.n_ids, n_ids)
        self.keys[first:n], self.lengths[first:n] = keys, lengths
        self.at[first:n] = np.cumsum(lengths) - lengths + self.n_ids
        self.ids[self.n_ids : n_ids] = np.fromiter(chain.from_iterable(encoded), np.uint32, n_ids - self.n_ids)
        self.n_keys, self.n_ids = n, n_ids
        if 2 * n > len(self.slots):
            self._new_slots((2 * n).bit_length())
            first = 0
        self._place(np.arange(first, n, dtype=np.int32))

    def _new_slots(self, bits: int) -> None:
        """An empty table of numbers of keys. A key stands at its first ``bits`` bits, or behind them in the next free slot."""
        self.slots, self.shift = np.full(1 << bits, -1, np.int32), np.uint64(64 - bits)

    def _place(self, numbers: np.ndarray) -> None:
        slot, last = (self.keys[numbers] >> self.shift).astype(np.int64), len(self.slots) - 1
        while len(numbers):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = numbers[free]  # of several that want a slot one gets it
            left = self.slots[slot] != numbers
            numbers, slot = numbers[left], (slot[left] + 1) & last

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each key, and whether it is there."""
        slot, last = (keys >> self.shift).astype(np.int64), len(self.slots) - 1
        found = self.slots[slot]
        open_ = np.flatnonzero(found >= 0)
        open_ = open_[self.keys[found[open_]] != keys[open_]]
        while len(open_):  # another key has the slot
            slot[open_] = (slot[open_] + 1) & last
            found[open_] = number = self.slots[slot[open_]]
            open_, number = open_[number >= 0], number[number >= 0]
            open_ = open_[self.keys[number] != keys[open_]]
        known = found >= 0
        return np.where(known, found, 0), known

    def _slice(self, text: str, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``text`` and how many come before each of ``edges`` (places in code points where a document begins, and the end)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        kinds = self._kinds(points)
        first = np.zeros(n + 1, bool)
        first[edges] = True
        first[n] = True
        # runs of one kind, cut at documents
        begin = np.empty(n, bool)
        begin[0], begin[1:] = True, kinds[1:] != kinds[:-1]
        begin |= first[:n]
        space = kinds == _SPACE
        # a run of white space leaves its last character to what follows in the same document
        last_space = space.copy()
        last_space[:-1] &= ~space[1:] | first[1:n]
        followed = last_space.copy()
        followed[:-1] &= ~space[1:] & ~first[1:n]
        followed[-1] = False
        begin |= followed
        # and a plain blank joins it
        joined = np.flatnonzero(followed & (points == 32)) + 1
        begin[joined] = False
        # contractions: ' and s, t, m, d, re, ve, ll at the start of a piece
        for q in np.flatnonzero((points == 39) & begin):
            size = 0
            if q + 1 < n and not first[q + 1]:
                a = points[q + 1]
                if a in (115, 116, 109, 100):
                    size = 2
                elif q + 2 < n and not first[q + 2] and (a, points[q + 2]) in ((114, 101), (118, 101), (108, 108)):
                    size = 3
            if size:
                begin[q + 1 : q + size] = False
                if q + size < n:
                    begin[q + size] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        if n > len(self.up):
            self._grow(n)
        codes = _CHAR_CODE[points & 0xFFFF]
        if points.max() > 0xFFFF:
            codes = codes + (points >> 16).astype(np.uint64) * SHINGLE_CODE[59]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.up[:n], out=sums[1:])
        keys = mix64((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * SHINGLE_CODE[60])
        at, known = self._find(keys)
        if not known.all():
            if self.n_keys > self.known:  # only here, so that all pieces of this slice are there below
                self._forget()
                known = np.zeros(len(keys), bool)
            new, where = np.unique(keys[~known], return_index=True)
            places = np.flatnonzero(~known)[where]
            self._learn(new, [text[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)])
            at, known = self._find(keys)
            if not known.all():
                raise RuntimeError("a piece of the text has no ids")
        lengths, source = self.lengths[at], self.at[at]
        before = np.zeros(len(keys) + 1, np.int64)
        np.cumsum(lengths, out=before[1:])
        ids = self.ids[np.arange(before[-1]) + np.repeat(source - before[:-1], lengths)]
        return ids, before[np.searchsorted(starts, edges)]

    def _grow(self, n: int) -> None:
        """Powers of an odd number and of its inverse: the hash of a piece is a difference of prefix sums."""
        self.up, self.down = np.full(n + 2, _P, np.uint64), np.full(n + 2, _PINV, np.uint64)
        for powers in (self.up, self.down):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)

    def _long(self, text: str) -> np.ndarray:
        """The ids of a text of more than SLICE_CHARS characters, slice by slice."""
        at, parts = 0, []
        while at < len(text):
            cut = _CUT.search(text, at + SLICE_CHARS) if at + SLICE_CHARS < len(text) else None
            end = cut.start() + 1 if cut else len(text)
            parts.append(self._slice(text[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(parts)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        i = 0
        while i < len(texts):
            if not self.plain or any(t in texts[i] for t in self.added):
                yield np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                i += 1
                continue
            if len(texts[i]) > SLICE_CHARS:
                yield self._long(texts[i])
                i += 1
                continue
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_CHARS) and not any(t in texts[j] for t in self.added):
                size += len(texts[j])
                j += 1
            edges = np.zeros(j - i + 1, np.int64)
            np.cumsum([len(t) for t in texts[i:j]], out=edges[1:])
            ids, at = self._slice("".join(texts[i:j]), edges)
            for k in range(j - i):
                yield ids[at[k] : at[k + 1]]
            i = j


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]
