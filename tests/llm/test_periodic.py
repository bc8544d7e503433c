"""Runs against their definition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from tripstrata.llm import periodic
from tripstrata.llm.catalogue import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """All maximal stretches by period, keeping the smallest period of each."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def by_start_and_period(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def words_of(text):
    return [bytes([c]) for c in text.encode()]


def test_runs_of_many_shapes():
    draw = random.Random(3)
    texts = ["", "a", "ab" * 40, "a" * 300, fibonacci(400), "abab" * 5 + "a" + "ba" * 9, "ababaababa" * 3, ("a" * 50 + "b") * 6, "abcdef" * 2, "xabcdefabcdefy", "abcde" * 2 + "ab"]
    for size in range(40):
        letters = "ab" if size % 2 else "abc"
        texts.append("".join(draw.choice(letters) for _ in range(draw.randint(10, 200))))
        base = "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 60)))
        texts.append("".join(draw.choice("xyzuvw") for _ in range(draw.randint(0, 30))) + base * draw.randint(1, 6) + base[: draw.randint(0, len(base))] + "qr")
        # two stretches of one small period inside a larger one
        inner = "ab" * draw.randint(2, 12) + "c" * draw.randint(0, 3) + "ba" * draw.randint(0, 4)
        texts.append(inner * draw.randint(2, 4) + inner[: draw.randint(0, len(inner))])
    documents = [words_of(t) for t in texts]
    together = periodic.slice_runs(documents)
    for text, words, found in zip(texts, documents, together, strict=True):
        assert found == by_start_and_period(brute(text)), text
        assert periodic.slice_runs([words])[0] == found


def test_wavelet_tree():
    draw = np.random.default_rng(1)
    values = draw.permutation(1000)
    tree = periodic.Wavelet(values)
    low = draw.integers(0, 1000, 200)
    high = np.minimum(low + draw.integers(1, 300, 200), 1000)
    limit = draw.integers(0, 1001, 200)
    less = tree.below(low, high, limit)
    for a, b, x, n in zip(low, high, limit, less, strict=True):
        assert n == (values[a:b] < x).sum()
    n = draw.integers(0, 300, 200) % (high - low)
    assert [sorted(values[a:b])[k] for a, b, k in zip(low, high, n, strict=True)] == tree.nth(low, high, n).tolist()


def test_documents(spark):
    rows = [
        (1, "a b " * 10 + "end"), (2, None), (3, ""), (4, " \t\n"), (None, "x " * 30), (2**60 + 1, "p q r s t u " * 3), (2**60 + 3, "p q r s t u " * 3),
        (5, " ".join(f"w{i % 700}" for i in range(30_000))), (1, "a b " * 10 + "end"), (6, "ä\x85ö " * 12 + "x\x1cy"),
    ]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, id int, runs string")
    got = sorted(((r.id is not None, r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(table).collect()), key=str)
    want = []
    for key, text in rows:
        words = WORD.findall(text or "")
        found = [(0, 30_000, 700)] if key == 5 else by_start_and_period(brute(words))
        left = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
        want.append((key is not None, key, len(words), found, " ".join(left)))
    assert got == sorted(want, key=str)
    assert periodic.find_runs(table.limit(0)).count() == 0


def damaged(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def test_damage(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 90))) for i in range(400)] + [(None, "a b"), (3, None), (10**17, "a  b \x0b c")]
    table = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, n int")
    got = periodic.repeated_tails(table)
    assert got.columns == table.columns
    assert [WORD.findall(r.text or "") for r in got.collect()] == [damaged(*r) for r in rows]


def test_query_against_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = damaged(doc_id, text)
        if len(words) > 1500:
            continue
        found = by_start_and_period(brute(words))
        left = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[doc_id]
        assert r.n_runs == len(found)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(left).encode()).hexdigest()
