"""Elias-Fano sequences and a two-level n-gram trie over them, read from a memory-mapped file.

A sorted sequence keeps its values' low bits packed and its high bits in unary,
with the number of zeros before each block of that; a zero or a one is found by
a binary search over the blocks and a count within one. The trie's first level holds the context words, the second their
successors; pointers say where a context's successors begin. Nothing but the
file is kept: all look-ups take arrays and read the words that they touch.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: log10 of a probability is stored in this many steps of 16 bits; code 0 means absent.
STEP = 18 / 65_534
_CHUNK = 1 << 16
#: 64-bit words of a unary part for each count in its directory.
BLOCK = 8
#: Arrays in the file for each sequence.
ARRAYS = 4


def quantise(p: np.ndarray) -> np.ndarray:
    return (1 + np.clip(np.rint(-np.log10(p) / STEP), 0, 65_533)).astype(np.uint16)


def dequantise(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.power(10.0, (1.0 - code.astype(np.float64)) * STEP), 0.0)


def ef_encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
    """Arrays that hold the sorted ``values`` (uint64), all below ``universe``."""
    n = len(values)
    bits = max(0, (universe // max(1, n)).bit_length() - 1)
    low = values & np.uint64((1 << bits) - 1)
    packed = [np.zeros(0, dtype=np.uint64)]
    for i in range(0, n if bits else 0, _CHUNK):
        part = low[i : i + _CHUNK]
        flags = ((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        raw = np.packbits(flags.ravel(), bitorder="little")
        packed.append(np.concatenate([raw, np.zeros(-len(raw) % 8, dtype=np.uint8)]).view(np.uint64))
    high = (values >> np.uint64(bits)).astype(np.int64)
    unary = np.zeros(int(high[-1]) + n + 1 if n else 1, dtype=np.uint8)
    unary[high + np.arange(n)] = 1
    raw = np.packbits(unary, bitorder="little")
    raw = np.concatenate([raw, np.zeros(-len(raw) % (8 * BLOCK), dtype=np.uint8)]).view(np.uint64)
    zeros = 64 * BLOCK - np.bitwise_count(raw).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(zeros)[:-1]]).astype(np.uint64)
    return [np.asarray([n, bits, int(high[-1]) + 1 if n else 0], dtype=np.uint64), np.concatenate([*packed, np.zeros(1, dtype=np.uint64)]), raw, before]


def _select(words: np.ndarray, zeros: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
    """Place of the k-th one, or zero, of the bits in ``words``; ``zeros``: how many lie before each block."""
    read = lambda at: words[at] if ones else ~words[at]
    before = zeros.astype(np.int64)
    if ones:
        before = np.arange(len(zeros)) * (64 * BLOCK) - before
    block = np.searchsorted(before, k, side="right") - 1
    rest, at = k - before[block], block * BLOCK
    bits = read(at)
    while True:
        count = np.bitwise_count(bits).astype(np.int64)
        on = np.flatnonzero(rest >= count)
        if not len(on):
            break
        rest[on] -= count[on]
        at[on] += 1
        bits[on] = read(at[on])
    place = np.zeros(len(k), dtype=np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
        over = rest >= count
        rest -= np.where(over, count, 0)
        place += np.where(over, step, 0)
        bits = np.where(over, bits >> np.uint64(step), bits)
    return (at << 6) + place


class EliasFano:
    """Reads what ef_encode made."""

    def __init__(self, head: np.ndarray, low: np.ndarray, unary: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.highs = (int(x) for x in head)
        self.low, self.unary, self.zeros = low, unary, zeros

    def _before(self, high: np.ndarray) -> np.ndarray:
        """How many elements have a high part below ``high``: the ones before its zero."""
        out = np.zeros(len(high), dtype=np.int64)
        at = np.flatnonzero(high > 0)
        out[at] = _select(self.unary, self.zeros, high[at] - 1, False) - (high[at] - 1)
        return out

    def values(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        high = _select(self.unary, self.zeros, i, True) - i
        low = self._low(i) if self.bits else np.zeros(len(i), dtype=np.uint64)
        return (high << self.bits) | low.astype(np.int64)

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        got = self.low[word] >> off
        over = off + np.uint64(self.bits) > 64
        if over.any():
            got[over] |= self.low[word[over] + 1] << (np.uint64(64) - off[over])
        return got & np.uint64((1 << self.bits) - 1)

    def find(self, q: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Place of each q in the sequence, or -1: the successor of q within places first to last, if it equals q."""
        if not self.n or not len(q):
            return np.full(len(q), -1, dtype=np.int64)
        high = np.minimum(q >> np.uint64(self.bits), np.uint64(self.highs)).astype(np.int64)
        inside = high < self.highs
        high = np.minimum(high, self.highs - 1)
        lo, hi = self._before(high), self._before(high + 1)
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, last)
        want, end = q & np.uint64((1 << self.bits) - 1), hi.copy()
        inside &= lo < hi
        hi = np.where(inside, hi, lo)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = (self._low(mid) if self.bits else np.zeros(len(mid), dtype=np.uint64)) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        hit = inside & (lo < end)
        at = np.flatnonzero(hit)
        if self.bits and len(at):
            hit[at] = self._low(lo[at]) == want[at]
        return np.where(hit, lo, -1)


class Trie:
    """Contexts (64-bit hashes), their successors, and quantised probabilities."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint64, mode="r")
        arrays, at = [], 1
        for _ in range(int(raw[0])):
            n = int(raw[at])
            arrays.append(raw[at + 1 : at + 1 + n])
            at += 1 + n
        self.contexts, self.words, self.pointers, self.follow = (EliasFano(*arrays[ARRAYS * k : ARRAYS * (k + 1)]) for k in range(4))
        self.codes = arrays[4 * ARRAYS].view(np.uint16)

    def find(self, context: np.ndarray, fan: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Code of each pair of hashes, 0 if absent; each of ``context`` goes with its ``fan`` next of ``word``."""
        c = self.contexts.find(context)
        known = c >= 0
        first, last = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        first[known], last[known] = self.pointers.values(c[known]), self.pointers.values(c[known] + 1)
        c, first, last = (np.repeat(x, fan) for x in (c, first, last))
        w = self.words.find(word)
        out = np.zeros(len(word), dtype=np.uint16)
        at = np.flatnonzero((c >= 0) & (w >= 0))
        # A context's successors are stored relative to it, which keeps the level sorted as a whole.
        got = self.follow.find((c[at] * self.words.n + w[at]).astype(np.uint64), first[at], last[at])
        out[at[got >= 0]] = self.codes[got[got >= 0]]
        return out


def write_trie(path: str, contexts: np.ndarray, words: np.ndarray, context_of: np.ndarray, word_of: np.ndarray, codes: np.ndarray) -> None:
    """``contexts`` and ``words``: sorted hashes; entries sorted by (context_of, word_of), which index them."""
    pointers = np.searchsorted(context_of, np.arange(len(contexts) + 1)).astype(np.uint64)
    keys = context_of.astype(np.uint64) * np.uint64(max(1, len(words))) + word_of.astype(np.uint64)
    top = 1 << 64
    arrays = [*ef_encode(contexts, top), *ef_encode(words, top), *ef_encode(pointers, len(keys) + 1), *ef_encode(keys, max(1, len(contexts) * len(words)))]
    arrays.append(np.concatenate([codes, np.zeros(-len(codes) % 4, dtype=np.uint16)]).view(np.uint64))
    with open(path, "wb") as f:
        f.write(np.asarray([len(arrays)], dtype=np.uint64).tobytes())
        for a in arrays:
            f.write(np.asarray([len(a)], dtype=np.uint64).tobytes() + a.tobytes())


def scratch_file() -> str:
    """A file of this task alone, in its machine's temporary folder; the caller removes it."""
    handle, path = tempfile.mkstemp(suffix=".trie")
    os.close(handle)
    return path
