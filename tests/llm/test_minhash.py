"""Near-duplicates against brute force over all pairs."""

from __future__ import annotations

import random
import re

import pytest

from tripstrata.llm import minhash

SCHEMA = "doc_id bigint, text string, node string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute_force(rows):
    sets = [shingles(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return sorted(((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group)), key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(*row, "x") for row in rows], SCHEMA)
    return sorted((tuple(r) for r in minhash.near_duplicates(docs).select("id", "n_shingles", "component_id").collect()), key=repr)


def near_copies(seed, count, words, edits):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    texts = []
    for _ in range(count):
        copy = list(base)
        for _ in range(draw.randrange(edits + 1)):
            copy[draw.randrange(words)] = f"x{draw.randrange(5000)}"
        texts.append(" ".join(copy))
    return texts


def test_matches_brute_force(spark):
    texts = [t for seed in range(6) for t in near_copies(seed, 12, 120, 9)]
    texts += ["", None, " \t\n", "one two", "ONE  two", "one two three", "a b c d e", "a b c d e f", "É b c d e", "é b c d e"]
    texts += texts[:5]
    rows = list(enumerate(texts, start=7))
    assert found(spark, rows) == brute_force(rows)


def test_documents_match_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(spark, rows) == brute_force(rows)


def test_null_ids_repeated_rows_and_long_text(spark):
    long = " ".join(f"v{i % 9973}" for i in range(60_000))
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, None), (None, ""), (9, long), (8, long + " end")]
    assert found(spark, rows) == sorted(
        [(None, 3, 3), (3, 3, 3), (3, 3, 3), (None, 0, None), (None, 0, None), (9, 9973, 8), (8, 9974, 8)], key=repr
    )


def test_empty_table(spark):
    assert found(spark, []) == []


def test_one_of_each_keeps_columns(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "p"), (4, "a b c d e f", "q"), (6, None, "r")], SCHEMA)
    assert sorted(map(tuple, minhash.one_of_each(docs).collect())) == [(4, "a b c d e f", "q"), (6, None, "r")]


@pytest.mark.parametrize("size,seen", [(32, 16), (128, 16)])
def test_pruning_grows_with_evidence(size, seen):
    wanted = minhash.least_matches(minhash.NearDup(size=size, batch=seen))
    assert wanted == sorted(wanted) and 0 < wanted[0] < 12


def test_large_ids_beside_nulls(spark):
    texts = near_copies(3, 4, 80, 3)
    rows = [(2**60 + 1, texts[0]), (2**60 + 3, texts[1]), (None, texts[2]), (2**60 + 5, "quite another text of its own")]
    docs = spark.createDataFrame([(*row, "x") for row in rows], SCHEMA).coalesce(1)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).select("id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute_force(rows)
    assert {r.doc_id for r in minhash.one_of_each(docs).collect()} == {r[2] for r in got}


def test_blocks_are_bounded_in_shingles(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    rows = list(enumerate(near_copies(8, 40, 150, 12) + near_copies(9, 20, 90, 8)))
    assert found(spark, rows) == brute_force(rows)
