"""Document likelihood from a subword lattice.

A document is a sequence of words and one end. Every word weighs all its segmentations into the
vocabulary's pieces: its probability is the sum over them (forward recursion in log space), and a
document's score is the sum of its words' log probabilities, of going on after each, and of the
end. The file's scores weight the pieces first, and are fitted to the training texts by
expectation steps over the segmentations of all their words, each as often as it occurs.

``word_score`` beside it is a word model over the same training counts that uses the lattice for
what it has not seen. A word has the probability

    (count - d + d * distinct words * lattice) / all counts        without - d for unseen words

where the discount d is the one of a fixed grid that makes the training tokens most probable
when each is left out of the counts. Counts, expectations, d and scores cover all words of all
documents.

Words move as one row per block and distinct word; see ``textblocks``.

Defined cases: a NULL text is empty and has its end only; a NULL id reads as the empty text
for the split; ids of any type come through as they are; repeated rows count each; without
training documents the file's weights remain; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.llm.base import staged
from tripstrata.llm.lattice import Lattice, first_weights
from tripstrata.llm.pieces import Vocabulary
from tripstrata.llm.textblocks import Block, text_blocks, with_values

END_BASE = 1e-3
GATHER = 20_000
VALUES = ("sums", "lp", "plain", "known")
GRID = tuple(n / 20 for n in range(1, 20))


@dataclass(frozen=True)
class Split:
    """Documents with crc32(id as text) mod ``parts`` equal to ``held`` are held out."""

    parts: int = 5
    held: int = 1


@dataclass(frozen=True)
class Counts:
    """Training totals: tokens with ends, distinct tokens with the end, ends."""

    tokens: int
    distinct: int
    ends: int


def lowered_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def block_words(blocks: DataFrame) -> DataFrame:
    """``(block, place, word, trained)``: the distinct words of a block and their training counts."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, payload in zip(batch.block, batch.payload, strict=True):
                block = Block.unpack(payload)
                trained = block.totals(np.array([not row[1] for row in block.rows]))
                for at in range(0, len(block.words), 20_000):
                    words = block.words[at : at + 20_000]
                    yield pd.DataFrame({"block": name, "place": np.arange(at, at + len(words)), "word": words, "trained": trained[at : at + 20_000]})

    return blocks.mapInPandas(scan, "block bigint, place bigint, word binary, trained bigint")


def gathered(batches: Iterator[pd.DataFrame], rows: int = GATHER) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``rows`` and more: the lattice works on words of one length together."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= rows:
            yield pd.concat(held, ignore_index=True)
            held, count = [], 0
    if count:
        yield pd.concat(held, ignore_index=True)


def fitted(words: DataFrame, vocabulary: Vocabulary, steps: int) -> np.ndarray:
    """Piece weights after ``steps`` expectation steps over the training words ``(word, count)``."""
    first = weights = first_weights(vocabulary)
    for _ in range(steps):

        def scan(batches: Iterator[pd.DataFrame], weights=weights) -> Iterator[pd.DataFrame]:
            lattice, expected = Lattice(vocabulary, weights), np.zeros(len(weights))
            for batch in gathered(batches):
                lattice.words([w.decode("utf-8", "replace") for w in batch.word], expected, batch["count"].to_numpy().astype(float))
            some = np.flatnonzero(expected)
            yield pd.DataFrame({"piece": some, "n": expected[some]})

        # one row per piece: as many as the vocabulary has, whatever the corpus
        sums = words.where("count > 0").select("word", "count").mapInPandas(scan, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros(len(weights))
        found[sums.piece] = sums.n
        weights = found + first
        weights = weights / weights.sum()
    return weights


def scores(docs: DataFrame, vocabulary: Vocabulary, split: Split = Split(), steps: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score)`` per row, log10."""
    id_type = dict(docs.dtypes)[id_col]
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % split.parts == split.held
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    blocks = text_blocks(rows, ["id", "held_out"], lowered_words)
    ends = rows.where(~F.col("held_out")).count()
    words = staged(block_words(blocks).groupBy("word").agg(F.sum("trained").alias("count")), "words")
    total = words.where("count > 0").agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    counts = Counts(total[0] + ends, total[1] + (ends > 0), ends)
    weights = fitted(words, vocabulary, steps)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(vocabulary, weights)
        for batch in gathered(batches):
            yield batch.assign(sums=lattice.words([w.decode("utf-8", "replace") for w in batch.word]) / np.log(10))

    based = staged(words.mapInPandas(measure, "word binary, count bigint, sums double"), "word-sums", GATHER)
    based = based.withColumn("base", F.col("sums") + F.lit(float(np.log10(1 - END_BASE))))
    d = chosen_discount(based, counts)
    mass = F.col("base") + F.lit(float(np.log10(d * counts.distinct)) if counts.distinct else 0.0)
    # a document ends after a word, or at once, with the training texts' frequency
    stop = min(max(ends / counts.tokens, END_BASE), 1 - END_BASE) if ends else END_BASE
    goes_on = F.lit(float(np.log10(1 - stop)))
    seen = F.log10(F.col("count") - F.lit(d) + F.pow(F.lit(10.0), mass))
    lp = F.when(F.col("count") > 0, seen).otherwise(mass) - F.lit(float(np.log10(max(counts.tokens, 1))))
    plain = F.log10((F.col("count") + 0.5) / F.lit(counts.tokens + 0.5 * (counts.distinct + 1)))
    valued = based.select("word", (F.col("sums") + goes_on).alias("sums"), lp.alias("lp"), plain.alias("plain"), (F.col("count") > 0).cast("double").alias("known"))
    values = block_words(blocks).select("block", "place", "word").join(valued, "word").select("block", "place", *VALUES)
    end_lp = float(np.log10((ends - d + d * counts.distinct * END_BASE) / counts.tokens if ends else END_BASE))
    end_plain = float(np.log10((ends + 0.5) / (counts.tokens + 0.5 * (counts.distinct + 1))))

    def combine(block: Block, found: pd.DataFrame) -> pd.DataFrame:
        place = found.place.to_numpy().astype(np.int64)
        by_word = np.zeros((len(VALUES), len(block.words)))
        by_word[:, place] = found[[*VALUES]].to_numpy().T
        sums, lp, plain, known = (block.sums(v) for v in by_word)
        return pd.DataFrame(
            {
                "id": pd.Series([row[0] for row in block.rows], dtype="Int64" if id_type in ("bigint", "int") else object),
                "held_out": [row[1] for row in block.rows],
                "n_tokens": block.sums(np.ones(len(block.words))).astype(np.int64) + 1,
                "n_known": known.astype(np.int64) + (ends > 0),
                "train_tokens": counts.tokens,
                "base_score": plain + end_plain,
                "score": sums + float(np.log10(stop)),
                "word_score": lp + end_lp,
            }
        )

    schema = f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, word_score double"
    return with_values(blocks, values, ["place", *VALUES], combine, schema)


def chosen_discount(based: DataFrame, counts: Counts) -> float:
    """The discount that fits training tokens best, each left out of the counts."""
    sums = []
    for d in GRID:
        mass = F.col("base") + F.lit(float(np.log10(d * max(counts.distinct, 1))))
        rest = F.when(F.col("count") > 1, F.log10(F.col("count") - 1 - F.lit(d) + F.pow(F.lit(10.0), mass))).otherwise(mass)
        sums.append(F.sum(F.col("count") * rest).alias(f"s{len(sums)}"))
    found = based.where("count > 0").agg(*sums).first()
    return GRID[max(range(len(GRID)), key=lambda i: float("-inf") if found[i] is None else found[i])]
