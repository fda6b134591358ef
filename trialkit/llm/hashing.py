"""Words of many texts as 64-bit numbers, by array arithmetic over their bytes."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once; longer texts are cut between words.
PIECE = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20))
_LETTERS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)


_base = int(_MULTIPLIER) | 1
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n``."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _tables:
        _tables[size] = _powers(_base, size), _powers(pow(_base, -1, 1 << 64), size)
    return _tables[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes that stand for themselves, but for A-Z, which become a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes of a word when only blanks part words.
SOLID = np.ones(256, bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of a word of ASCII letters, digits and anything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words:
    """The words of a run of texts: ``hashes``, byte ``starts`` and ``ends``, and ``bounds`` by text.

    ``bounds[i]:bounds[i + 1]`` are the words of text ``i``. Words that are equal after folding have equal
    hashes; two different ones have the same with probability 2**-64.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.starts, self.ends = _edges(data, offsets, inside)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = _word_hashes(data, self.starts, self.ends)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of ``length`` words within a text, and the number of its first word."""
        n = len(self.hashes)
        if n < length:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        valid = np.ones(n, bool)
        # the last length - 1 words of each text start no window
        last = np.repeat(self.bounds[1:], np.diff(self.bounds))
        valid = np.arange(n) + length <= last
        return run_hashes(self.hashes, length)[valid[: n - length + 1]], np.flatnonzero(valid)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive hashes, in order."""
    n = len(hashes) - length + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out *= np.uint64(_base)
            out += hashes[j : j + n]
        return mix(out)


def _edges(data, offsets, inside) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = inside[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | first[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _word_hashes(data, starts, ends) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    done = 0
    with np.errstate(over="ignore"):
        while done < len(starts):
            at = starts[done]
            upto = max(int(np.searchsorted(ends, at + PIECE, side="right")), done + 1)
            s, e = starts[done:upto] - at, ends[done:upto] - at
            n = int(e[-1])
            scale, back = _scales(n)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTERS[FOLD[data[at : at + n]]] * scale[:n], out=sums[1:])
            h = (sums[e] - sums[s]) * back[s]
            h += (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            out[done:upto] = mix(h)
            done = upto
    return out
