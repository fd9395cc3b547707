"""A minimal perfect hash over 128-bit keys, built and probed with numpy.

Levels of bit arrays: at each level every remaining key picks one bit; keys
that are alone on their bit stay there, the rest go on to the next level. A
key's slot is the rank of its bit, so n keys get the slots 0..n-1 at about
three bits a key. Keys outside the set get some slot or -1: the caller holds
a fingerprint beside each slot to tell them apart.
"""

from __future__ import annotations

import numpy as np

GAMMA = 1.7
_U = np.uint64
_M64 = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _mix_one(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M64
    return x ^ x >> 31


def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit of each key at ``level``; both halves enter anew at every level."""
    seed = _U(((level + 1) * _STEP) & _M64)
    return _mix(h1 ^ _mix(h2 ^ seed)) % _U(bits)


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct keys given as two uint64 arrays."""

    def __init__(self, sizes: list[int], words: list[np.ndarray]):
        self.sizes = sizes
        self.words = words
        self.before, at = [], 0
        for w in words:
            ones = np.bitwise_count(w).astype(np.int64)
            ends = np.cumsum(ones)
            self.before.append(at + ends - ones)
            at += int(ends[-1]) if len(ends) else 0
        self.n = at

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> MinimalPerfectHash:
        h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
        sizes, words, level = [], [], 0
        while len(h1):
            if level > 200:
                raise ValueError("the keys are not distinct")
            bits = max(64, -(-int(len(h1) * GAMMA) // 64) * 64)
            at = _place(h1, h2, level, bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            sizes.append(bits)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            rest = ~alone[at.astype(np.int64)]
            h1, h2, level = h1[rest], h2[rest], level + 1
        return cls(sizes, words)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has a bit for it."""
        h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, (bits, words, before) in enumerate(zip(self.sizes, self.words, self.before, strict=True)):
            if not len(left):
                break
            at = _place(h1[left], h2[left], level, bits)
            word, bit = (at >> _U(6)).astype(np.int64), at & _U(63)
            held = words[word]
            hit = (held >> bit) & _U(1) == 1
            lower = held[hit] & ((_U(1) << bit[hit]) - _U(1))
            out[left[hit]] = before[word[hit]] + np.bitwise_count(lower)
            left = left[~hit]
        return out

    def slot(self, h1: int, h2: int) -> int:
        """Slot of one key, as :meth:`slots` gives it."""
        for level, (bits, words, before) in enumerate(zip(self.sizes, self.words, self.before, strict=True)):
            at = _mix_one(h1 ^ _mix_one(h2 ^ (((level + 1) * _STEP) & _M64))) % bits
            word, bit = at >> 6, at & 63
            held = int(words[word])
            if held >> bit & 1:
                return int(before[word]) + (held & ((1 << bit) - 1)).bit_count()
        return -1

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64).tobytes()
        return head + b"".join(w.tobytes() for w in self.words)

    @classmethod
    def from_bytes(cls, raw: bytes) -> MinimalPerfectHash:
        levels = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, levels, 8).tolist()
        at, words = 8 * (levels + 1), []
        for bits in sizes:
            words.append(np.frombuffer(raw, np.uint64, bits // 64, at))
            at += bits // 8
        return cls(sizes, words)
