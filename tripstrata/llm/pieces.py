"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

The vocabulary file's scores weight the pieces, and the best segmentation of a text is
found word by word (no piece reaches over a word mark). The distinct marked words of a
slice of documents are sorted, which lays them out as the depth-first walk of their trie:
a word starts from the forward scores of the prefix it shares with the word before it. Each
distinct word is searched once per slice, documents only look their words up. Nothing is shuffled.

The segmentation is that of a unigram model with the file's scores, also where the file was
made for merges. Ties go to the longer last piece. Characters without a piece become bytes.

Defined cases: a NULL text has NULL tokens and an empty text none; a literal mark (U+2581) is
read as a blank, as SentencePiece itself does; very long words and texts are searched whole;
all other columns come through as they are; a new column's name that the input has already is a
ValueError; an empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripstrata.llm.base import tidy
from tripstrata.llm.textblocks import Places

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
UNKNOWN_PENALTY = 10.0
SLICE_CHARS = 4_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; ``byte_ids`` are the 256 byte pieces, ``plain`` tells ordinary pieces."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    byte_ids: tuple[int, ...]

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> Vocabulary:
        """Read on the driver; the pieces go to the tasks with the job (their number is fixed)."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        return cls(
            tuple(model.id_to_piece(i) for i in ids),
            tuple(model.get_score(i) for i in ids),
            tuple(not s for s in special),
            tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256)),
        )

    def piece_bytes(self) -> list[bytes]:
        """What each piece decodes to."""
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        return [of_byte.get(i, p.replace(MARK, " ").encode() if ok else b"") for i, (p, ok) in enumerate(zip(self.pieces, self.plain, strict=True))]


def marked(text: str) -> list[str]:
    """The marked words of a text, in order; joined they are the marked text."""
    return WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


class SharedViterbi:
    """Best segmentations of sorted words; keeps the forward scores of the last word's prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # pieces by their last character first: node -> (id, score) under "", children under characters
        self.ends: dict = {}
        scores = [s for s, ok in zip(vocabulary.scores, vocabulary.plain, strict=True) if ok]
        for number, (piece, score, ok) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.plain, strict=True)):
            if ok:
                node = self.ends
                for char in reversed(piece):
                    node = node.setdefault(char, {})
                node[""] = (number, score)
        self.unknown = min(scores) - UNKNOWN_PENALTY

    def segment(self, words: list[str]) -> Iterator[list[int]]:
        """Piece ids of each of the sorted ``words``."""
        ends, unknown, byte_ids = self.ends, self.unknown, self.vocabulary.byte_ids
        best, start, piece = [0.0], [0], [0]
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], start[shared + 1 :], piece[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, origin, number = float("-inf"), end - 1, -1
                node, at = ends, end - 1
                while at >= 0:
                    node = node.get(word[at])
                    if node is None:
                        break
                    found = node.get("")
                    if found is not None and best[at] + found[1] >= top:
                        top, origin, number = best[at] + found[1], at, found[0]
                    at -= 1
                single = ends.get(word[end - 1])
                if (single is None or "" not in single) and best[end - 1] + unknown > top:
                    top, origin, number = best[end - 1] + unknown, end - 1, -1
                best.append(top)
                start.append(origin)
                piece.append(number)
            ids, at = [], len(word)
            while at:
                if piece[at] >= 0:
                    ids.append(piece[at])
                else:
                    ids += [byte_ids[b] for b in reversed(word[at - 1].encode())]
                at = start[at]
            ids.reverse()
            before = word
            yield ids


def encode_slice(texts: list[str], viterbi: SharedViterbi) -> list[np.ndarray]:
    """Ids of each text of one slice; of its words only the distinct ones are held."""
    places = Places()
    found = []
    for text in texts:
        words = marked(text)
        found.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
    counts = np.fromiter(map(len, found), np.int64, len(found))
    index = np.concatenate(found) if found else np.zeros(0, np.int32)
    words = sorted(places)
    segments = list(viterbi.segment(words))
    sizes = np.zeros(len(words), np.int64)
    order = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    flat = np.fromiter((i for ids in segments for i in ids), np.int32, int(lengths.sum()))
    sizes[order] = lengths
    starts = np.zeros(len(words), np.int64)
    starts[order] = np.cumsum(lengths) - lengths
    taken = sizes[index]
    ends = np.cumsum(taken)
    total = int(ends[-1]) if len(ends) else 0
    ids = flat[np.repeat(starts[index] - (ends - taken), taken) + np.arange(total)]
    bounds = np.concatenate([[0], ends])[np.cumsum(counts)[:-1]] if len(counts) > 1 else []
    return np.split(ids, bounds) if len(counts) else []


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", token_col: str = "tokens", restored_col: str | None = None
) -> DataFrame:
    """``docs`` with the piece ids of ``text_col`` in a new column ``token_col``.

    With ``restored_col``, another one tells whether the ids decode to the text again.
    """
    new = [T.StructField(token_col, T.ArrayType(T.IntegerType()))]
    new += [T.StructField(restored_col, T.BooleanType())] if restored_col else []
    if clash := {f.name for f in new} & set(docs.columns):
        raise ValueError(f"{sorted(clash)} are columns already")
    schema = T.StructType([*docs.schema.fields, *new])
    held = vocabulary.piece_bytes() if restored_col else None
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = SharedViterbi(vocabulary)
        for batch in batches:
            for part in slices(batch, at, SLICE_CHARS):
                column = part.column(at).to_pylist()
                texts = [text for text in column if text is not None]
                ids = iter(encode_slice(texts, viterbi))
                found = [None if text is None else next(ids) for text in column]
                added = [token_lists(found)]
                if restored_col:
                    same = [None if one is None else text_of(one, held) == text.replace(MARK, " ") for one, text in zip(found, column, strict=True)]
                    added.append(pa.array(same, pa.bool_()))
                # the other columns pass as they are, so that no id becomes a double
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=schema.fieldNames())

    return docs.mapInArrow(tidy(run), schema)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``most`` bytes; a longer text is a slice of its own."""
    sizes = np.array([len(text.as_buffer()) if text.is_valid else 0 for text in batch.column(column)], np.int64)
    group = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    for begin, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(begin, end - begin)


def token_lists(found: list[np.ndarray | None]) -> pa.Array:
    missing = np.array([one is None for one in found], bool)
    sizes = [0 if one is None else len(one) for one in found]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int32), *[one for one in found if one is not None]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(missing))


def text_of(ids: np.ndarray, held: list[bytes]) -> str:
    """Text of piece ids, given what each piece decodes to."""
    return b"".join([held[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


def decode(tokens: Column, vocabulary: Vocabulary) -> Column:
    """Text of an array of piece ids; NULL for NULL. Bytes that are no UTF-8 become U+FFFD."""
    held = vocabulary.piece_bytes()

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda one: None if one is None else text_of(one, held), na_action=None)

    return run(tokens)
