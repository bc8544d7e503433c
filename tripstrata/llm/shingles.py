"""Word shingles and MinHash signatures of whole texts, as arrays."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
CACHE_WORDS = 200_000
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words of ``text``, A-Z in lower case (bytes know no other case or space)."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words count as one shingle."""
    if not len(words):
        return words
    width = min(size, len(words))
    count = len(words) - width + 1
    rolled = np.full(count, np.uint64(width))
    for j in range(width):
        rolled = mixed(rolled * _ODD + words[j : j + count])
    return np.unique(rolled)


class MinHash:
    """Signatures of ``size`` minima of multiply-shift hashes, 32 bits each."""

    def __init__(self, size: int = 128, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.a = draw.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, size, dtype=np.uint64)
        self.size = size

    def of(self, shingles: np.ndarray, block: int = 2048) -> np.ndarray:
        least = np.full(self.size, MASK)
        for at in range(0, len(shingles), block):
            values = self.a[:, None] * shingles[None, at : at + block] + self.b[:, None]
            least = np.minimum(least, values.min(axis=1))
        return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per signature and band of ``rows`` minima."""
    count, size = signatures.shape
    bands = signatures.reshape(count, size // rows, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, size // rows + 1, dtype=np.uint64), (count, size // rows))
    for j in range(rows):
        keys = mixed(keys * _ODD + bands[:, :, j])
    return keys.view(np.int64)
