"""Words of whole texts as arrays of 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile("[^ \t-\r]+")
_REMEMBERED = 150_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_KNOWN = _Hashes()


def hashed(words: list[str]) -> np.ndarray:
    if len(_KNOWN) > _REMEMBERED:
        _KNOWN.clear()
    return np.fromiter(map(_KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    out = values ^ (values >> np.uint64(30))
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` values from each position; runs that would pass the end are left out.

    Runs of 1, 2, 4, ... values are hashed by joining two of half the length, and the wanted
    length is put together from these, so the cost grows with its logarithm.
    """
    if len(values) < length:
        return np.zeros(0, dtype=np.uint64)
    power, size, have, out = values, 1, 0, None
    while True:
        if length & size:
            if out is None:
                out = power[:]
            else:
                n = min(len(out), len(power) - have)
                out = mixed(out[:n] * ODD + power[have:have + n])
            have += size
        if size * 2 > length:
            return out[:len(values) - length + 1]
        power = mixed(power[:-size] * ODD + power[size:])
        size *= 2
