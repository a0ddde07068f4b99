"""Words, word hashes, shingle sets and MinHash signatures of many texts at once, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, which is the same
as of characters. Hashes are 64-bit: a polynomial modulo 2**64 over a table of mixed byte values,
then mixed again. With prefix sums the hashes of all words take a few passes over the bytes.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes hashed at once.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which near values end up far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@functools.lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n, modulo 2**64."""
    out = []
    for b in (BASE, INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return tuple(out)


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(1 << max(20, int(n).bit_length()))


@dataclass
class Words:
    raw: bytes  # of all texts, each followed by a line break, lower-cased unless asked otherwise
    data: np.ndarray
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    first: np.ndarray  # the first word of each text, and the number of all
    texts: np.ndarray  # where each text starts in data, and the end

    def hashes(self) -> np.ndarray:
        """Of words of BLOCK bytes together (or of one longer word), so memory does not grow with the texts."""
        out, i = np.empty(len(self.starts), np.uint64), 0
        while i < len(out):
            lo = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, lo + BLOCK, "right")))
            n = int(self.ends[j - 1] - lo)
            up, down = powers_for(n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(BYTE_VALUE[self.data[lo : lo + n]] * up[:n], out=sums[1:])
            a, b = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = mix((sums[b] - sums[a]) * down[a])
            i = j
        return out


def words_of(texts: list[str | None], lower: bool = True) -> Words:
    parts = [(t or "").encode() for t in texts]
    raw = b"\n".join([*parts, b""])
    if lower:
        raw = raw.lower()  # of bytes: A-Z only
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return Words(raw, data, starts, ends, np.searchsorted(starts, at), at)


@functools.cache
def places(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of k words in a row; of fewer words, of all of them as one; without words, none."""
    h, c = words.hashes(), places(k)
    runs = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        runs += h[i : len(h) - k + 1 + i] * c[i]
    runs = mix(runs)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            x = np.sort(runs[a : b - k + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(mix((h[a:b] * c[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


@functools.cache
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    return x[:n] | np.uint64(1), x[n:]


def signature(values: np.ndarray, n: int) -> np.ndarray:
    """The least of n different hashes of the values, as 32-bit numbers."""
    a, b = permutations(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 17) // n)  # keeps the products in cache
    for i in range(0, len(values), step):
        np.minimum(low, (values[i : i + step, None] * a + b).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)
