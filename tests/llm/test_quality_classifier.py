"""The classifier's model against Kneser-Ney by hand, and its decisions on labelled documents."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripstrata.llm import quality

PLAN = quality.Quality()


def grams_of(word, order=quality.ORDER):
    """The n-gram that predicts each character of a word by itself and its end."""
    line = f" {word} "
    return [line[:end] for end in range(2, min(order, len(line) + 1))] + [line[at : at + order] for at in range(len(line) - order + 1)]


def kneser_ney(texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney over the same n-grams, with dictionaries."""
    raw = Counter(g for t in texts for w in t.split() for g in grams_of(w, order))
    raw += Counter(g for t in texts for g in across_blanks(t))
    counts = Counter(raw)
    current = {g: n for g, n in raw.items() if len(g) == order}
    for size in range(order - 1, 0, -1):
        before = defaultdict(set)
        for gram in current:
            before[gram[1:]].add(gram[0])
        shorter = {g: len(b) for g, b in before.items()}
        for g, n in shorter.items():
            counts[g] = max(counts[g], n)
        current = Counter(shorter) + Counter({g: n for g, n in raw.items() if len(g) == size})
    cut = {}
    kind = lambda g: (len(g), BLANK in g[1:-1])
    for k in {kind(g) for g in counts}:
        n = [sum(v == i for g, v in counts.items() if kind(g) == k) for i in range(6)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i
            cut[k, i] = max(0.1, min(d, i - 0.05))
    off = lambda g: cut[kind(g), min(counts[g], 3)]
    total, freed = Counter(), Counter()
    for g, n in counts.items():
        total[g[:-1]] += n
        freed[g[:-1]] += off(g)

    def p(gram):
        if not gram:
            return 1 / quality.ALPHABET
        own = (counts[gram] - off(gram)) / total[gram[:-1]] if gram in counts else 0.0
        return own + (freed[gram[:-1]] / total[gram[:-1]] if total[gram[:-1]] else 1.0) * p(gram[1:])

    return p


BLANK = quality.BLANK


def across_blanks(text):
    """N-grams that predict the first two characters after each blank between words from what stands before it."""
    line = f" {' '.join(text.split())} "
    return [line[at - 2 + k : at + 2 + k] for at in range(1, len(line) - 1) if line[at] == " " for k in (0, 1)]


def flow(p, text):
    """Mean over the whole line: after a blank between words the n-grams that span it, else those within the word."""
    grams = []
    for n, word in enumerate(text.split()):
        own = grams_of(word)
        if n:
            before = text.split()[n - 1]
            line = f" {before} {word} "
            at = len(before) + 1
            own = [line[at - 2 : at + 2], line[at - 1 : at + 3], *own[2:]]
        grams += own
    return -sum(math.log10(p(g)) for g in grams) / len(grams)


def test_matches_kneser_ney(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").where("lang in ('en', 'de')").collect()
    trusted = [r.doc_id for r in rows if r.doc_id % 3 == 0]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, lang string")
    sample = spark.createDataFrame([(r.doc_id, r.lang) for r in rows if r.doc_id in set(trusted)], "id bigint, lang string")
    found = {r.id: r for r in quality.perplexities(docs, sample, PLAN, "doc_id", "text", "lang").collect()}
    for lang in ("en", "de"):
        p = kneser_ney([r.text for r in rows if r.lang == lang and r.doc_id in set(trusted)])
        for row in [r for r in rows if r.lang == lang][:40]:
            assert found[row.doc_id].flow == pytest.approx(flow(p, row.text), rel=1e-9)


def test_probabilities_add_up(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("text").limit(20).collect()]
    p = kneser_ney(texts)
    alphabet = {c for t in texts for w in t.split() for c in w} | {" "}
    for head in (" ", " th", "the", "qqq", ""):
        known = sum(p(head + c) for c in alphabet)
        assert known < 1 + 1e-9


def test_keeps_good_and_rejects_bad(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), quality.trusted_ids(labels))
    shares = rows.join(labels, rows.id == labels.doc_id).groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    shares = {r["quality"]: r.kept for r in shares}
    assert shares[1] > 0.99
    assert shares[0] < 0.2


def test_odd_rows(spark):
    good = [(i, "the nation then other that " * 5, "en", 1) for i in range(30)]
    odd = [(100, None, "en", 1), (101, "", "en", 1), (102, " \n", None, 1), (103, "the other", None, 1), (None, "the other", "en", 1), (104, "%%% ### $$$ @@@ " * 20, "en", 1), (105, "x" * 50_000, "en", 1)]
    docs = spark.createDataFrame(good + odd + good[:1], "doc_id bigint, text string, lang string, keep int")
    labels = spark.createDataFrame([(i,) for i in range(30)] + [(None,)], "id bigint")
    rows = {r.id: r for r in quality.classify(docs, labels).collect()}
    assert [rows[i].keep for i in (0, 100, 101, 102, 103, None, 104, 105)] == [True, False, False, False, True, True, False, False]
    assert rows[103].perplexity is None
    kept = quality.kept_rows(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 33
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).where("keep").count() == 35


def test_threshold_is_near_trusted_range(spark):
    """A wide trusted range does not lift the limit to where random letters stay."""
    draw = random.Random(5)
    words = ["".join(draw.choice("etaoinsh") for _ in range(draw.randint(2, 7))) for _ in range(60)]
    prose = [" ".join(draw.choice(words) for _ in range(120)) for _ in range(60)]
    mixed = [" ".join(draw.choice(words) if draw.random() < 0.8 else f"{draw.choice('{}[]()=;')}{draw.randint(0, 9999)}" for _ in range(120)) for _ in range(20)]
    noise = [" ".join("".join(chr(draw.randint(97, 122)) for _ in range(6)) for _ in range(100)) for _ in range(10)]
    texts = prose + mixed + noise
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(80)], "id bigint")
    rows = {r.id: r for r in quality.classify(docs, labels).collect()}
    assert all(rows[i].keep for i in range(80))
    assert not any(rows[i].keep for i in range(80, 90))
    highest = max(math.log10(rows[i].perplexity) for i in range(80))
    assert all(math.log10(rows[i].threshold) < highest + 0.15 for i in range(80))


def test_order_and_repetition_count(spark, sf_dir):
    """The same words in another order, or one of them again and again, are less likely than the text."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").select("text").limit(40).collect()]
    texts = [t for t in texts if t and len(t.split()) > 50]
    draw = random.Random(2)
    shuffled = [" ".join(draw.sample(t.split(), len(t.split()))) for t in texts]
    all_texts = texts + shuffled + ["And " * 300]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(all_texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(len(texts))], "id bigint")
    found = {r.id: r for r in quality.classify(docs, labels).collect()}
    n = len(texts)
    assert sum(found[n + i].perplexity > found[i].perplexity for i in range(n)) > 0.9 * n
    assert found[2 * n].perplexity > sorted(found[i].perplexity for i in range(n))[n // 2]


def test_pieces_hold_each_window_once(monkeypatch):
    draw = random.Random(4)
    lines = ["", " a ", " ab ", *(" " + " ".join("".join(draw.choice("abé\U0001f600") for _ in range(draw.randint(1, 6))) for _ in range(n)) + " " for n in range(1, 30))]
    want = [Counter(line[i : i + 4] for i in range(len(line) - 3)) for line in lines]
    for chars, most in ((1_000_000, 65_536), (50, 65_536), (7, 5), (1_000_000, 4)):
        monkeypatch.setattr(quality, "PIECE_CHARS", chars)
        monkeypatch.setattr(quality, "MOST_CHARS", most)
        sums, found = [0.0] * len(lines), Counter()
        for owner, piece in quality.pieces_of(lines):
            texts = piece.texts(piece.codes)
            found.update(t for t, whole in zip(texts, piece.whole.tolist(), strict=True) if whole)
            value = np.array([hash(t) % 1000 for t in texts], float)
            for number, total in zip(owner.tolist(), piece.sums(value).tolist(), strict=True):
                sums[number] += total
        assert found == sum(want, Counter())
        assert sums == [sum(n * (hash(t) % 1000) for t, n in w.items()) for w in want]


def test_many_characters(spark):
    wide = " ".join(chr(c) for c in [*range(0x4E00, 0x9FFF), *range(0xAC00, 0xD7A3), *range(0x10000, 0x1FFFF)])
    docs = spark.createDataFrame([(1, wide, "en"), (2, "the other " * 9, "en"), (3, "the other " * 9, "en")], "doc_id bigint, text string, lang string")
    found = {r.id: r for r in quality.classify(docs, spark.createDataFrame([(2,)], "id bigint")).collect()}
    assert [found[i].keep for i in (1, 2, 3)] == [False, True, True] and found[1].n_chars == len(wide) + 1


def test_languages_are_apart():
    assert len({quality.tag_of(x) for x in (None, "", "en", "-", "+")}) == 5


def test_large_ids(spark):
    rows = [(2**60 + 1, "the other", "en"), (2**60 + 3, "the other", "en"), (None, "the other", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(2**60 + 1,)], "id bigint")
    assert {r.id for r in quality.classify(docs, labels).collect()} == {2**60 + 1, 2**60 + 3, None}


def test_rare_language_keeps_its_sample(spark):
    """A common language's trusted rows do not push out those of a rare one."""
    rows = [(i, f"word{i % 7} other", "en") for i in range(4000)] + [(10_000 + i, "selten wort", "xx") for i in range(3)] + [(20_000, "none", None)]
    docs = spark.createDataFrame(rows, "id bigint, text string, lang string")
    sample = quality.training_sample(docs, docs.select("id"), quality.Quality(train_rows=50))
    found = {r["lang"]: r["count"] for r in sample.where("trained").groupBy("lang").count().collect()}
    assert found["xx"] == 3 and found[None] == 1 and 20 <= found["en"] <= 90
    assert sample.count() == docs.count()
    half = quality.training_sample(docs, docs.select("id"), quality.Quality(share=0.5)).where("trained AND lang = 'en'").count()
    assert 1800 < half < 2200
    plan = quality.Quality(train_rows=50)
    noise = docs.limit(0).unionByName(spark.createDataFrame([(30_000, "qzv kpw jjx", "xx")], docs.schema))
    marks = quality.classify(docs.unionByName(noise), docs.select("id"), plan, "id").where("lang = 'xx'").collect()
    assert sorted(r.keep for r in marks) == [False, True, True, True]
