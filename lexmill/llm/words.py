"""Words and word n-grams of whole batches of texts, as flat numpy arrays.

A word is a longest run of letters or digits of any script, in lower case. A batch of texts
becomes one flat array of 64-bit word hashes with offsets, so that n-grams, fingerprints and
sets of all texts of a batch are computed by a few array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

# re's \w is letters, digits and the underscore; marks are not in it.
WORD = re.compile(r"[^\W_]+")

_P1 = np.uint64(0x9E3779B185EBCA87)
_P2 = np.uint64(0xC2B2AE3D27D4EB4F)
_P3 = np.uint64(0x165667B19E3779F9)


def words(text: str) -> list[str]:
    """The words of one text, in order."""
    return WORD.findall(text.lower())


class WordHasher(dict):
    """Word to 64-bit hash, remembered; forgets all when it grows past ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def flat_hashes(texts: Iterable[str | None], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, offsets of length len(texts) + 1); a null has no words."""
    get = hasher.__getitem__
    parts: list[int] = []
    ends = [0]
    for text in texts:
        if text:
            parts.extend(map(get, WORD.findall(text.lower())))
        ends.append(len(parts))
    return np.array(parts, dtype=np.uint64), np.array(ends, dtype=np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * _P2
    h = h ^ (h >> np.uint64(29))
    h = h * _P3
    return h ^ (h >> np.uint64(32))


def ngram_hashes(flat: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position of the flat array (last k-1 positions left out)."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = flat[:n].copy()
    for i in range(1, k):
        h = mix(h * _P1 + flat[i : i + n])
    return mix(h)


def starts_in_text(offsets: np.ndarray, k: int) -> np.ndarray:
    """Flat positions from which k words lie within one text."""
    if not len(offsets) or offsets[-1] < k:
        return np.empty(0, dtype=np.int64)
    keep = np.ones(int(offsets[-1]), dtype=bool)
    for i in range(1, k):
        tail = offsets[1:] - i
        keep[tail[tail >= offsets[:-1]]] = False
    return np.nonzero(keep)[0]
