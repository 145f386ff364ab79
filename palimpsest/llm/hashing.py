"""64-bit Rabin-Karp hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text hashed at once.
SLICE = 1 << 18


def mixed(i: int) -> int:
    """The i-th of a fixed sequence of well-spread 64-bit numbers (splitmix64)."""
    z = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return z ^ z >> 31


#: What each byte counts for.
BYTES = np.array([mixed(1000 + i) for i in range(256)], np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out[:n]


class Powers:
    """Rising and falling powers of the base, as many as were asked for so far."""

    up, down = powers(BASE, 1 << 12), powers(BASE_INVERSE, 1 << 12)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = powers(BASE, size), powers(BASE_INVERSE, size)
        return cls.up, cls.down


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * MIX
    return h ^ h >> np.uint64(32)


class Words(NamedTuple):
    """The words of some texts, one space apart: where each begins and ends, and the hash of any run of bytes."""

    per_text: list[int]
    begins: np.ndarray
    ends: np.ndarray
    sums: np.ndarray

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from ``begins`` to ``ends``: with the sums of all bytes times falling powers, each follows from its two ends."""
        up, _ = Powers.of(len(self.sums))
        return stirred((self.sums[ends] - self.sums[begins]) * up[begins])


def slices(texts: list[bytes]) -> Iterator[Words]:
    """The words of the texts, in slices of whole texts of about SLICE bytes."""
    at = 0
    while at < len(texts):
        plain, size, counts = [], 0, []
        while at < len(texts) and (not plain or size + len(texts[at]) <= SLICE):
            own = texts[at].split()
            counts.append(len(own))
            plain.append(b" ".join(own))
            size += len(plain[-1]) + 1
            at += 1
        data = np.frombuffer(b" ".join(plain) + b" ", np.uint8)
        _, down = Powers.of(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[data] * down[: len(data)], dtype=np.uint64)))
        space = data == 32
        after_space = np.concatenate(([True], space[:-1]))
        yield Words(counts, np.flatnonzero(~space & after_space), np.flatnonzero(space & ~after_space), sums)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text)."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    for s in slices(texts):
        hashes.append(s.hashes(s.begins, s.ends))
        counts += s.per_text
    return np.concatenate(hashes), np.array(counts, np.int64)


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes of every window of ``size`` words, modulo 2**64, from the hashes of the words.

    The hash of a window is sum(h[i + j] * BASE**(size - 1 - j)); doubling computes all of them in
    log(size) vector steps.
    """
    if len(h) < size:
        return np.zeros(0, np.uint64)
    total, length = None, 0
    power, power_len, step = h, 1, size
    # power: hashes of windows of power_len words; total: of the windows of `length` words, by binary digits of size
    while step:
        if step & 1:
            if total is None:
                total, length = power, power_len
            else:
                factor = np.uint64(pow(BASE, length, 1 << 64))
                total = power[: len(h) - length - power_len + 1] * factor + total[power_len : len(h) - length + 1]
                length += power_len
        step >>= 1
        if step:
            factor = np.uint64(pow(BASE, power_len, 1 << 64))
            power = power[: len(h) - 2 * power_len + 1] * factor + power[power_len:]
            power_len *= 2
    return (total ^ (total >> np.uint64(32))) * MIX


def stable_sort(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): ``h`` in ascending order, equal values in theirs; as a stable argsort, but several times as fast.

    The high bits of each hash and its index are sorted as one number; where only the high bits are
    alike, which is rare, those few are put right.
    """
    low = np.uint64(len(h).bit_length())
    key = h >> low << low | np.arange(len(h), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << int(low)) - 1)).astype(np.int32 if len(h) < 1 << 31 else np.int64)
    key >>= low
    values = h[order]
    same = key[1:] == key[:-1]
    mixed_runs = np.flatnonzero(same & (values[1:] != values[:-1]))
    if len(mixed_runs):
        run = np.concatenate(([0], np.cumsum(~same)))
        at = np.flatnonzero(np.isin(run, run[mixed_runs]))
        some = order[at]
        order[at] = some[np.lexsort((some, h[some]))]
        values[at] = h[order[at]]
    return order, values


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def lengths(starts: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the runs that begin at ``starts`` of ``n`` values."""
    return np.diff(np.concatenate((starts, [n])))
