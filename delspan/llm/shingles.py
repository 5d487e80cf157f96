"""Word shingles of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import xxhash

from .common import KEPT

#: Odd multipliers, one for each place in a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
CACHE_WORDS = 100_000


class _Hashes(dict):
    """word -> hash, filled as needed"""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32 and len(self) < CACHE_WORDS:
            self[word] = h
        return h


_hashes = _Hashes()
KEPT["hashes"] = _hashes.clear


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers; each salt is another one."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Sequence[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, how many of them are each text's): the distinct shingles of ``words`` words of one text after another, sorted by hash.

    A-Z count as a-z; with fewer words the whole sequence is one shingle; a null text has no words.
    """
    found = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # both only touch ASCII
    count = np.fromiter(map(len, found), np.int64, len(found))
    h = mix(np.fromiter(map(_hashes.__getitem__, chain.from_iterable(found)), np.uint64, int(count.sum())))
    size = np.minimum(count, words)
    number = np.where(count > 0, count - size + 1, 0)
    ends = np.cumsum(number)
    begins = ends - number
    at = np.repeat(np.cumsum(count) - count - begins, number) + np.arange(number.sum())
    width = np.repeat(size, number)
    total = width.astype(np.uint64)
    for k in range(words):
        wide = width > k
        if wide.all():
            total += h[at + k] * PLACES[k]
        else:
            total[wide] += h[at[wide] + k] * PLACES[k]
    total = mix(total)
    for s, e in zip(begins.tolist(), ends.tolist(), strict=True):
        total[s:e].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[begins[number > 0]] = True
    upto = np.r_[0, np.cumsum(new)]
    return total[new], upto[ends] - upto[begins]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of one text."""
    return shingle_sets([text], words)[0]


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
