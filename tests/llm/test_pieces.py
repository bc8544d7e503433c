"""Encoding against the library's own lattice, and exact round trips."""

from __future__ import annotations

import random

import pytest
import sentencepiece

from tripstrata.llm import pieces

VOCABULARY = pieces.Vocabulary.load()


def varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


@pytest.fixture(scope="module")
def library():
    """The same vocabulary file with its model type set to unigram."""
    data = bytearray(open(pieces.MODEL_FILE, "rb").read())
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        size, at = varint(data, at)
        if key >> 3 == 2:
            place = data.index(b"\x18\x02", at, at + size)  # trainer_spec.model_type: 2 is BPE, 1 unigram
            data[place + 1] = 1
            break
        at += size
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(data))


def encoded(texts):
    return [list(map(int, ids)) for ids in pieces.encode_slice(texts, pieces.SharedViterbi(VOCABULARY))]


def test_matches_the_library(spark, sf_dir, library):
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    # characters without a piece cost 1e9, which the library's single precision cannot hold
    known = {p for p, ok in zip(VOCABULARY.pieces, VOCABULARY.plain) if ok and len(p) == 1}
    words = sorted({w for t in texts for w in t.split() if set(w) <= known})
    assert len(words) > 5000
    # the library's lattice search; its faster encoder misses the best path of some words, such as "hest"
    best = [library.nbest_encode_as_ids(w, 2)[0] for w in words]
    score = lambda ids: sum(VOCABULARY.scores[i] for i in ids)
    assert [score(ids) for ids in encoded(words)] == [score(ids) for ids in best]


def best_from(text, score):
    parts = [(score[text[:n]], text[n:]) for n in range(1, len(text) + 1) if text[:n] in score]
    return max((s + best_from(rest, score) for s, rest in parts), default=float("-inf")) if text else 0.0


def test_best_of_all_segmentations():
    score = {p: s for p, s, ok in zip(VOCABULARY.pieces, VOCABULARY.scores, VOCABULARY.plain) if ok}
    draw = random.Random(5)
    for word in {"".join(draw.choices("then ingéa", k=draw.randrange(1, 9))).strip() for _ in range(60)} - {""}:
        text = pieces.MARK + word.replace(" ", pieces.MARK)
        assert sum(VOCABULARY.scores[i] for i in encoded([word])[0]) == pytest.approx(best_from(text, score))


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, "  two  blanks "), (-4, "tab\tline\nend\r\n\x00"), (-5, "漢字 \U0001f600 é"), (-6, "x" * 200_000), (None, "a b")],
        "doc_id bigint, text string",
    )
    docs = docs.unionByName(odd, allowMissingColumns=True)
    done = pieces.encode(docs, VOCABULARY, restored_col="restored")
    assert {r.restored for r in done.select("restored").distinct().collect()} == {True, None}
    rows = done.select("doc_id", "text", "tokens", pieces.decode(done.tokens, VOCABULARY).alias("back")).collect()
    assert len(rows) == docs.count()
    for row in rows:
        assert row.back == row.text
        assert (row.tokens is None) == (row.text is None)
    assert {r.doc_id: r.tokens for r in rows}[-2] == []


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, node string")
    assert pieces.encode(docs, VOCABULARY).columns == ["doc_id", "text", "node", "tokens"]
    assert pieces.encode(docs, VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs, VOCABULARY, token_col="node")
