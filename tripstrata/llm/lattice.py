"""All segmentations of words into subword pieces, in log space.

Words of equal length go through the recursion together, as arrays.
"""

from __future__ import annotations

import numpy as np

from tripstrata.llm.pieces import MARK, Vocabulary
from tripstrata.llm.shingles import mixed

_ODD = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 20_000


def first_weights(vocabulary: Vocabulary) -> np.ndarray:
    """Probabilities from the file's scores; index ``len(pieces)`` stands for all byte pieces.

    Scores of a unigram file are log probabilities and are used as they are. Files made for
    merges hold ranks, which become 1 / rank.
    """
    scores = np.array(vocabulary.scores)
    plain = np.array(vocabulary.plain)
    weights = np.zeros(len(scores) + 1)
    with np.errstate(under="ignore"):
        total = np.exp(scores[plain]).sum()
    if 0.5 < total < 2:
        weights[:-1][plain] = np.exp(scores[plain])
    else:
        order = np.argsort(-scores[plain], kind="stable")
        ranks = np.empty(len(order))
        ranks[order] = np.arange(1, len(order) + 1)
        weights[:-1][plain] = 1 / ranks
    weights[-1] = weights[weights > 0].min()
    return weights / weights.sum()


class Lattice:
    """Forward and backward sums over the segmentations of marked words."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        with np.errstate(divide="ignore"):
            self.log = np.log(weights)
        self.other = len(vocabulary.pieces)
        # hash of every prefix of a piece -> the piece's id, or -1 where the prefix is no piece
        known: dict[int, int] = {}
        with np.errstate(over="ignore"):
            for number, (piece, ok) in enumerate(zip(vocabulary.pieces, vocabulary.plain, strict=True)):
                if ok:
                    rolled = np.uint64(0)
                    for char in piece:
                        rolled = mixed(rolled * _ODD + np.uint64(ord(char)))
                        known.setdefault(int(rolled), -1)
                    known[int(rolled)] = number
        self.keys = np.array(sorted(known), np.uint64)
        self.ids = np.array([known[k] for k in sorted(known)], np.int64)

    def edges(self, chars: np.ndarray, start: int):
        """``(end, rows, ids)`` of the pieces that begin at ``start``, for every length."""
        rows = np.arange(len(chars))
        rolled = np.zeros(len(chars), np.uint64)
        for end in range(start + 1, chars.shape[1] + 1):
            rolled = mixed(rolled * _ODD + chars[rows, end - 1])
            at = np.minimum(np.searchsorted(self.keys, rolled), len(self.keys) - 1)
            alive = self.keys[at] == rolled
            found = np.where(alive, self.ids[at], -1)
            if end == start + 1:
                # a character without a piece of its own is spelled in bytes
                yield end, rows, np.where(found >= 0, found, self.other)
            else:
                yield end, rows[found >= 0], found[found >= 0]
            rows, rolled = rows[alive], rolled[alive]
            if not len(rows):
                return

    def score(self, chars: np.ndarray, start: int, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        values = self.log[ids]
        spelled = ids == self.other
        if spelled.any():
            code = chars[rows[spelled], start]
            width = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + (code > 0xFFFF)
            values = values.copy()
            values[spelled] = width * (self.log[self.other] - np.log(256))
        return values

    def of_length(self, chars: np.ndarray, expected: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Log probabilities of words given as code points; adds expected piece counts to ``expected``."""
        count, length = chars.shape
        forward = np.full((length + 1, count), -np.inf)
        forward[0] = 0.0
        kept = []
        for start in range(length):
            for end, rows, ids in self.edges(chars, start):
                value = self.score(chars, start, rows, ids)
                forward[end, rows] = np.logaddexp(forward[end, rows], forward[start, rows] + value)
                if expected is not None:
                    kept.append((start, end, rows, ids, value))
        if expected is not None:
            backward = np.full((length + 1, count), -np.inf)
            backward[length] = 0.0
            for start, end, rows, ids, value in reversed(kept):
                through = value + backward[end, rows]
                backward[start, rows] = np.logaddexp(backward[start, rows], through)
                share = np.exp(forward[start, rows] + through - forward[length, rows])
                expected += np.bincount(ids, weights=share * weight[rows], minlength=len(expected))
        return forward[length]

    def words(self, words: list[str], expected: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Log marginal probability of each word, with its mark before it."""
        out = np.empty(len(words))
        weight = np.ones(len(words)) if weight is None else weight
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            for length in np.unique(lengths):
                own = np.flatnonzero(lengths == length)
                most = max(1, CHUNK * 16 // (int(length) + 1))
                for at in range(0, len(own), most):
                    some = own[at : at + most]
                    text = "".join(MARK + words[i] for i in some)
                    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(some), -1).astype(np.uint64)
                    out[some] = self.of_length(chars, expected, weight[some])
        return out
