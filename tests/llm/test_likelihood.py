"""Scores against counts by hand, the lattice against all segmentations, and held-out texts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tripstrata.llm import likelihood
from tripstrata.llm.lattice import Lattice, first_weights
from tripstrata.llm.pieces import MARK, Vocabulary

VOCABULARY = Vocabulary.load()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def by_hand(rows):
    held = {n: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for n, (i, _) in enumerate(rows)}
    count = Counter(w for n, (_, text) in enumerate(rows) if not held[n] for w in words(text))
    total, kinds = sum(count.values()), len(count)
    return [
        (i, held[n], len(ws := words(text)), sum(count[w] > 0 for w in ws), total, sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws))
        for n, (i, text) in enumerate(rows)
    ]


def checked(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, block string")
    found = likelihood.scores(docs, VOCABULARY).collect()
    key = lambda r: repr((r[0], r[1], r[2], r[3], round(r[5], 6)))
    assert len(found) == len(rows)
    for have, want in zip(sorted(map(tuple, found), key=key), sorted(by_hand(rows), key=key), strict=True):
        assert have[:5] == want[:5]
        assert have[5] == pytest.approx(want[5])
        assert math.isfinite(have[6]) and have[6] < 0 and math.isfinite(have[7]) and have[7] < 0
    return found


def test_base_counts(spark):
    rows = [(n, f"Aa bb  cc{n % 7}\tdd\n{'Éé' * (n % 3)}") for n in range(60)]
    checked(spark, rows + [(None, "aa"), (None, None), (71, ""), (72, None), (5, "aa bb"), (5, "aa bb"), (80, "z" * 5000 + " \U0001f600")])


def test_held_out_texts_gain_from_training(spark, sf_dir):
    """The base score is no distribution (it gives every unseen word a share), so the model is held against itself untrained."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    trained = [r for r in checked(spark, rows) if r.held_out]
    ids = {r.id for r in trained}
    alone = checked(spark, [r for r in rows if r[0] in ids])
    assert sum(r.score for r in trained) > 0.7 * sum(r.score for r in alone)
    assert sum(r.word_score for r in trained) > sum(r.score for r in trained)
    known = [r for r in trained if r.n_known == r.n_tokens]
    assert sum(r.word_score for r in known) > 1.1 * sum(r.base_score for r in known)


def test_empty_table_and_no_training(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert likelihood.scores(docs, VOCABULARY).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    checked(spark, [(only_held, "some text")])


def test_lattice_sums_all_segmentations():
    weights = first_weights(VOCABULARY)
    chance = {p: weights[i] for i, (p, ok) in enumerate(zip(VOCABULARY.pieces, VOCABULARY.plain)) if ok}
    spelled = weights[-1] / 256

    def total(text):
        if not text:
            return 1.0
        found = sum(chance[text[:n]] * total(text[n:]) for n in range(1, len(text) + 1) if text[:n] in chance)
        return found + (spelled ** len(text[0].encode()) * total(text[1:]) if text[0] not in chance else 0.0)

    some = ["the", "nation", "a", "thé", "hest", "x一\U0001f600y", "......", "ingen"]
    expected = np.zeros(len(weights))
    got = Lattice(VOCABULARY, weights).words(some, expected)
    assert np.allclose(np.exp(got), [total(MARK + w) for w in some], rtol=1e-9)
    lengths = np.array([len(p) for p in VOCABULARY.pieces] + [1])
    assert (expected * lengths).sum() == pytest.approx(sum(len(w) + 1 for w in some))


SMALL = Vocabulary(("<unk>", MARK, "a", "b", f"{MARK}a", "ab", "ba", f"{MARK}ab"), (0.0, 3.0, 2.0, 1.0, 0.0, -1.0, -2.0, -3.0), (False, *[True] * 7), tuple(range(256)))


def segmentations(text):
    """All ways to write ``text`` in pieces of the small vocabulary; other characters are spelled."""
    if not text:
        yield []
        return
    known = {p: n for n, (p, ok) in enumerate(zip(SMALL.pieces, SMALL.plain, strict=True)) if ok}
    for size in range(1, len(text) + 1):
        if text[:size] in known:
            yield from ([known[text[:size]], *rest] for rest in segmentations(text[size:]))
    if text[0] not in known:
        yield from ([("spelled", text[0]), *rest] for rest in segmentations(text[1:]))


def chance(path, weights):
    return math.prod((weights[-1] / 256) ** len(p[1].encode()) if isinstance(p, tuple) else weights[p] for p in path)


def fitted_by_hand(count, steps):
    first = weights = first_weights(SMALL)
    for _ in range(steps):
        expected = np.zeros(len(weights))
        for word, n in count.items():
            paths = list(segmentations(MARK + word))
            total = sum(chance(p, weights) for p in paths)
            for path in paths:
                for piece in path:
                    expected[-1 if isinstance(piece, tuple) else piece] += n * chance(path, weights) / total
        weights = (expected + first) / (expected + first).sum()
    return weights


def test_scores_against_all_segmentations(spark):
    texts = ["ab ba a", "abab b", "", "b b ab", "aé ab", None, "ab"]
    rows = [(n, texts[n % len(texts)]) for n in range(40)] + [(2**60 + 1, "ab"), (2**60 + 3, "ba"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    training = [(text or "").split() for (i, text) in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    count = Counter(w for words_ in training for w in words_)
    weights = fitted_by_hand(count, 2)
    stop = len(training) / (sum(count.values()) + len(training))

    def by_definition(text):
        each = [sum(chance(p, weights) for p in segmentations(MARK + w)) * (1 - stop) for w in (text or "").split()]
        return math.log10(stop) + sum(map(math.log10, each))

    found = likelihood.scores(docs, SMALL).collect()
    key = lambda pair: repr((pair[0], round(pair[1], 6)))
    have, want = sorted([(r.id, r.score) for r in found], key=key), sorted([(i, by_definition(t)) for i, t in rows], key=key)
    assert [i for i, _ in have] == [i for i, _ in want]
    assert [s for _, s in have] == pytest.approx([s for _, s in want])


def test_words_share_the_mass():
    """The probabilities of all strings of a length, and of shorter ones, do not exceed one."""
    weights = first_weights(SMALL)
    total = sum(chance(p, weights) for n in range(6) for bits in range(2**n) for p in segmentations(MARK + format(bits, f"0{n}b").replace("0", "a").replace("1", "b") * (n > 0)))
    assert 0 < total < 1
