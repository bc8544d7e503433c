"""Repeated strings against their definition, and suffix arrays against sorting."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tripstrata.llm import grouping, repeats
from tripstrata.llm.catalogue import QUERIES


def test_suffix_arrays():
    draw = random.Random(1)
    for _ in range(400):
        codes = [draw.randint(1, draw.choice([1, 2, 5, 30])) for _ in range(draw.randint(0, 60))] * draw.choice([1, 1, 4])
        codes.append(0)
        found = grouping.suffix_array(np.array(codes))
        assert found.tolist() == sorted(range(len(codes)), key=lambda i: codes[i:])  # noqa: B023
    assert len(grouping.suffix_array(np.empty(0, np.int64))) == 0


def test_groups_are_lyndon_prefixes():
    codes = [2, 1, 2, 1, 1, 2, 1, 2, 3, 1, 0]
    group, smaller = grouping.lyndon_groups(np.array(codes))
    for i in range(len(codes)):
        assert smaller[i] == max((j for j in range(i) if codes[j:] < codes[i:]), default=-1)
    prefix = [tuple(codes[i : next((j for j in range(i + 1, len(codes)) if codes[j:] < codes[i:]), len(codes))]) for i in range(len(codes))]
    assert all((group[i] < group[j]) == (prefix[i] < prefix[j]) for i in range(len(codes)) for j in range(len(codes)))


def brute(texts, length):
    """(n_bytes, n_removed, spans, kept) per text."""
    raws = [(t or "").encode() for t in texts]
    times = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        covered = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if times[raw[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = [(m, n) for m, n in _runs(covered)]
        out.append((len(raw), sum(covered), spans, bytes(b for b, c in zip(raw, covered, strict=True) if not c)))
    return out


def _runs(covered):
    start = None
    for i, c in enumerate([*covered, 0]):
        if c and start is None:
            start = i
        if not c and start is not None:
            yield start, i - 1
            start = None


def corpus(draw, length):
    """Passages of many lengths around ``length`` put between random texts, copies with edits, periodic texts, repeated lines."""
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(length // 3)[: length + draw.randint(-3, 60)] for _ in range(8)]
    rows = [None, "", " ", "short"]
    for _ in range(60):
        rows.append(text(draw.randint(0, 60)) + draw.choice(passages) + text(draw.randint(0, 60)) + draw.choice(["", draw.choice(passages)]))
    base = text(150)
    rows += [base] * 5
    for _ in range(30):
        at = draw.randint(0, len(base))
        rows.append(base[:at] + word() + base[at + draw.randint(0, 4) :])
    rows += ["ab" * 300, "a" * (length + 1), "a" * length, (text(12) + "\n") * 9, "b" * (length - 1), "é" * length]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("length", "most"), [(64, 20_000), (100, 20_000), (200, 20_000), (80, 3)])
def test_against_all_strings(spark, monkeypatch, length, most):
    monkeypatch.setattr(repeats, "SORTED_SYMBOLS", 3000)
    draw = random.Random(length + most)
    texts = corpus(draw, length)
    wanted = brute(texts, length)
    table = spark.createDataFrame([(n, t, "x", 1) for n, t in enumerate(texts)], "doc_id bigint, text string, block string, part int").repartition(5)
    got = {r.id: (r.n_bytes, r.n_removed, [tuple(s) for s in r.spans], bytes(r.kept)) for r in repeats.cut_repeats(table, length=length, most=most).collect()}
    assert [got[n] for n in range(len(texts))] == wanted


def test_long_documents_are_cut_into_pieces():
    draw = np.random.default_rng(2)
    raw = draw.integers(97, 123, 5000).astype(np.uint8)
    whole = repeats.Anchors(raw, np.array([2000, 0, 10, 2990]), 200)
    before = repeats.PIECE_BYTES
    try:
        repeats.PIECE_BYTES = 700
        parts = repeats.Anchors(raw, np.array([2000, 0, 10, 2990]), 200)
    finally:
        repeats.PIECE_BYTES = before
    spread = lambda x: {s: a for a, f, z in zip(x.at.tolist(), x.first.tolist(), x.last.tolist(), strict=True) for s in range(f, z + 1)}
    assert spread(whole) == spread(parts)
    assert sorted(spread(whole)) == [*range(1801), *range(2010, 4801)]


def test_ids_and_nothing(spark):
    text = "".join(chr(97 + (i * i) % 23) for i in range(260))
    table = spark.createDataFrame([(None, text), (2**60 + 1, text), (2**60 + 1, text), (2**60 + 3, None)], "doc_id bigint, text string")
    got = sorted(((str(r.id), r.n_bytes, r.n_removed, len(r.spans)) for r in repeats.cut_repeats(table).collect()))
    assert got == [(str(2**60 + 1), 260, 260, 1)] * 2 + [(str(2**60 + 3), 0, 0, 0), ("None", 260, 260, 1)]
    assert repeats.cut_repeats(table.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    wanted = brute([r.text for r in rows], 200)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_suffix_array_dedup"](spark, sf_dir).collect()}
    assert sum(w[1] for w in wanted) > 0
    for row, (n, removed, spans, kept) in zip(rows, wanted, strict=True):
        assert got[row.doc_id] == (n, removed, len(spans), hashlib.sha256(kept).hexdigest())
