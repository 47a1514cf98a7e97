"""Token ids of whole texts, with the ids of pieces kept.

The tokenizer lower-cases, splits a text into runs of letters, single digits and runs of
other marks, drops white space, and merges within each piece.  A word of plain characters
is split into these pieces here; a word with any other character (also an apostrophe, which
begins pieces of its own kind) is one unit, as it is.  Splitting, hashing and looking up are
array operations over the text's bytes.  Units that are not known yet go to the tokenizer,
many in a call; the end-of-word ids cut the result.  This gives what encoding the whole text
gives.  Units are told apart by 64-bit hashes: among a million of them, two share one with
a probability of about 3e-8.
"""

from __future__ import annotations

import numpy as np

from .words import _BYTE, SEGMENT, SPACE, _segments, mix64

KEPT = 400_000
SLOTS = 1 << 21
TOGETHER = 200

_LETTER, _DIGIT, _MARK = 1, 2, 3
_KIND = np.full(256, _MARK, np.uint8)
_KIND[ord("a") : ord("z") + 1] = _KIND[ord("A") : ord("Z") + 1] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[128:] = _LETTER
_KIND[SPACE] = 0
#: Bytes that may stand in a plain word: printable ASCII without the apostrophe, and the
#: first byte of two-byte Latin letters (checked with their second).
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True
_PLAIN[ord("'")] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_RAW = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))

#: An odd number and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, 2 * SEGMENT)
        _TABLES[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _TABLES[0][:n], _TABLES[1][:n]


class Encoder:
    """Ids of texts as arrays.  ``path``: a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        ending = [i for t, i in vocabulary.items() if t.endswith("</w>")]
        self.ends[ending] = True
        self.word_level = bool(ending)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.rows = np.full(SLOTS, -1, np.int32)
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    # -- a hash table with open addressing

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 if unknown."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        out = self.rows[slot].astype(np.int64)
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != hashes))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (SLOTS - 1)
            out[wrong] = self.rows[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != hashes[wrong])]
        return out

    def _insert(self, hashes: np.ndarray, first: int) -> None:
        """Distinct new hashes get the rows from ``first`` on."""
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(left):
            free = self.rows[slot[left]] < 0
            taker, at = np.unique(slot[left[free]], return_index=True)
            who = left[free][at]
            self.rows[taker] = first + who
            self.keys[taker] = hashes[who]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)

    # -- new units

    def _encode(self, unit: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(unit.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: np.ndarray, units: list[bytes], plain: np.ndarray) -> None:
        order = np.flatnonzero(plain)
        groups = [order[i : i + TOGETHER] for i in range(0, len(order), TOGETHER)]
        who, sizes, flat, single = [], [], [], np.flatnonzero(~plain).tolist()
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([b" ".join([units[i] for i in g.tolist()]).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                cuts[-1] = len(ids)
                who.append(group)
                sizes.append(np.diff(cuts, prepend=0))
                flat.append(ids)
            else:  # not one end for each unit: one by one
                single += group.tolist()
        for i in single:
            ids = self._encode(units[i])
            who.append(np.array([i]))
            sizes.append(np.array([len(ids)]))
            flat.append(ids)
        self._insert(hashes[np.concatenate(who)], len(self.sizes))
        sizes = np.concatenate(sizes)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *flat])

    # -- splitting

    @staticmethod
    def _units(data: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes and plainness of the units of ``data``; ``inner``: starts of rows.  White
        space behind a unit counts as part of it, with no value."""
        kind = _KIND[data]
        word = kind > 0
        before = np.zeros(len(data), np.uint8)
        before[1:] = data[:-1]
        begins = np.zeros(len(data), bool)  # a row's first byte; a NUL byte before it is no such mark
        begins[:1] = True
        begins[inner] = True
        before[begins] = 0
        first = word & (begins | SPACE[before])
        starts = np.flatnonzero(first)
        if not len(starts):
            return starts, starts.astype(np.uint64), starts.astype(bool)
        ok = _PLAIN[data]
        high = np.flatnonzero(data >= 0x80)
        folded = _FOLD[data]
        if len(high):  # two-byte Latin letters are plain, and folded in their second byte
            h, b = data[high], before[high]
            c3, c5 = b == 0xC3, b == 0xC5
            latin = c3 & (h != 0x97) & (h != 0xB7) | c5 & ((h == 0x92) | (h == 0x93))
            ok[high[latin]] = True
            ok[high[latin] - 1] = True
            folded[high[c3 & (h <= 0x9E) & (h != 0x97)]] += 32
            folded[high[c5 & (h == 0x92)]] = 0x93
        pipes = np.flatnonzero(data == ord("|"))
        ok[pipes[before[pipes] == ord("<")]] = False
        value = _BYTE[folded]
        shift = np.zeros(len(data), bool)
        shift[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        shift &= word
        bad = np.flatnonzero(word & ~ok)
        odd_starts = starts[:0]
        if len(bad):  # words with such a byte are one unit, as they are
            which = np.unique(np.searchsorted(starts, bad, side="right") - 1)
            odd_starts = starts[which]
            lengths = np.append(starts, len(data))[which + 1] - odd_starts
            inside = np.repeat(odd_starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            value[inside] = _RAW[data[inside]]
            shift[inside] = False
        value[~word] = 0
        starts = np.flatnonzero(first | shift)
        # a polynomial's coefficients summed up once; a unit's part is shifted to its own start
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value * _powers(len(data))[0], out=sums[1:])
        hashes = mix64((sums[np.append(starts[1:], len(data))] - sums[starts]) * _powers(len(data))[1][starts])
        plain = np.ones(len(starts), bool)
        plain[np.searchsorted(starts, odd_starts)] = False
        return starts, hashes, plain

    def encode_buffer(self, data: np.ndarray, offsets: np.ndarray, end: int | None = 1) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each row with its end id."""
        n = len(offsets) - 1
        if not self.word_level:
            body = data.tobytes()
            found = self.tokenizer.encode_batch_fast([body[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], add_special_tokens=False)
            rows = [f.ids + ([] if end is None else [end]) for f in found]
            return np.array([i for r in rows for i in r], np.uint32), np.array([len(r) for r in rows], np.int64)
        if len(self.sizes) > KEPT:
            self._clear()
        units, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in _segments(data, offsets):
            starts, hashes, plain = self._units(data[a:b], offsets[(offsets >= a) & (offsets < b)] - a)
            at = self._find(hashes)
            new = np.flatnonzero(at < 0)
            if len(new):
                fresh, where = np.unique(hashes[new], return_index=True)
                where = new[where]
                body = data[a:b].tobytes()
                ends = np.append(starts[1:], b - a)[where].tolist()
                self._learn(fresh, [body[i:j].rstrip().lower() if p else body[i:j].rstrip() for i, j, p in zip(starts[where].tolist(), ends, plain[where].tolist(), strict=True)], plain[where])
                at[new] = self._find(hashes[new])
            units.append(at)
            places.append(starts + a)
        at, starts = np.concatenate(units), np.concatenate(places)
        lengths = self.sizes[at]
        before = np.cumsum(lengths) - lengths
        take = np.repeat(self.starts[at] - before, lengths)
        take += np.arange(len(take))
        ids = self.flat[take]
        cuts = np.append(before, len(ids))[np.searchsorted(starts, offsets)]
        per_row = np.diff(cuts)
        if end is None:
            return ids, per_row
        out = np.empty(len(ids) + n, np.uint32)
        ending = np.zeros(len(out), bool)
        ending[cuts[1:] + np.arange(n)] = True
        out[ending] = end
        out[~ending] = ids
        return out, per_row + 1

    def encode(self, texts: list[bytes], end: int | None = 1) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return self.encode_buffer(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), end)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
