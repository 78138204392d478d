"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word's hash is a sum over its bytes of a random value for the byte times a random odd number for its place, then
mixed. It depends on the word alone, so hashes from different tasks and tables can be compared.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit mixing function, element by element."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = splitmix(np.arange(256, dtype=U))
_place = splitmix(np.arange(1 << 12, dtype=U) + U(1 << 40)) | U(1)


def _places(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = splitmix(np.arange(1 << int(n - 1).bit_length(), dtype=U) + U(1 << 40)) | U(1)
    return _place


def _table(is_word) -> bytes:
    """A translation that lower-cases A-Z and turns what is not part of a word into a space."""
    lower = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if is_word(b) else 32 for b in lower)


#: Words are runs of anything but ASCII white space.
PLAIN = _table(lambda b: b not in (32, 9, 10, 11, 12, 13))
#: Words are runs of ASCII letters, digits and anything beyond ASCII.
ALNUM = _table(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122)


class Words:
    """The words of a batch of texts: ``hashes`` in order, and ``first[i]:first[i + 1]`` those of text i."""

    def __init__(self, texts: list[bytes], table: bytes):
        joined = b" ".join(texts).translate(table) + b" "
        data = np.frombuffer(joined, np.uint8)
        inside = np.empty(len(data) + 1, bool)
        inside[0] = False
        np.not_equal(data, 32, out=inside[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        lengths = ends - starts
        at = np.flatnonzero(inside[1:])
        place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        value = _BYTE[data[at]] * _places(int(lengths.max(initial=1)))[place]
        first = np.cumsum(lengths) - lengths
        self.hashes = splitmix(np.add.reduceat(value, first) + lengths.astype(U)) if len(starts) else np.empty(0, U)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(starts, begins)

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U)
    out = np.full(m, n, U)
    for k in range(n):
        out = splitmix(out * U(0x9E3779B97F4A7C15) ^ hashes[k : k + m])
    return out
