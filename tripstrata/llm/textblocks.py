"""Texts as blocks: documents packed with their distinct words, so that what is looked up per
word moves once per block and word, not once per token.

A block holds consecutive documents of about ``SLICE_BYTES``: the distinct words, and for each
document the places of its words in that list with their counts, compressed. Blocks are written
once; their names are drawn by the attempt that wrote them.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.llm.base import staged
from tripstrata.llm.blocks import by_block

SLICE_BYTES = 8_000_000


class Places(dict):
    """Word -> place, in order of first sight."""

    def __missing__(self, word) -> int:
        self[word] = place = len(self)
        return place


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress better."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _whole(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


@dataclass
class Block:
    """``rows``: what is carried per document; ``places``/``times``: document by document, ``sizes`` apiece."""

    rows: list[tuple]
    words: list[bytes]
    sizes: np.ndarray
    places: np.ndarray
    times: np.ndarray

    def pack(self) -> bytes:
        steps = np.diff(self.places, prepend=0)
        starts = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        steps[starts] = self.places[starts]
        whole = (self.rows, b"\n".join(self.words), self.sizes, _planes(steps), _planes(self.times))
        return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(whole))

    @classmethod
    def unpack(cls, payload: bytes) -> Block:
        rows, words, sizes, steps, times = pickle.loads(zstandard.ZstdDecompressor().decompress(payload))
        total = np.cumsum(_whole(steps), dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        before = np.where(starts > 0, total[np.maximum(starts - 1, 0)], 0) if len(total) else np.zeros(len(sizes), np.int64)
        total -= np.repeat(before, sizes)
        return cls(rows, words.split(b"\n") if words else [], sizes, total.astype(np.int32), _whole(times))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum per document of ``values`` (per word) times the word's count."""
        out, filled = np.zeros(len(self.sizes)), self.sizes > 0
        if filled.any():
            out[filled] = np.add.reduceat(values[self.places] * self.times, (np.cumsum(self.sizes) - self.sizes)[filled])
        return out

    def totals(self, chosen: np.ndarray) -> np.ndarray:
        """How often each word occurs in the ``chosen`` documents."""
        weights = self.times * np.repeat(chosen, self.sizes)
        return np.bincount(self.places, weights=weights, minlength=len(self.words)).astype(np.int64)


def text_blocks(docs: DataFrame, carried: list[str], words_of: Callable[[bytes], list[bytes]], text_col: str = "text") -> DataFrame:
    """``(block, payload)``, staged. ``words_of(text)`` gives a document's words, without line breaks.

    Carried values, ids among them, come through as they are, whatever their type.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, sizes, places, times, held = Places(), [], [], [], [], 0

        def block() -> pa.RecordBatch:
            whole = Block(rows, list(known), np.array(sizes), np.concatenate(places), np.concatenate(times))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([whole.pack()], pa.binary())], names=["block", "payload"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(carried))]
            for number, text in enumerate(batch.column(len(carried))):
                raw = text.as_py() or b""
                words = words_of(raw)
                found, count = np.unique(np.fromiter(map(known.__getitem__, words), np.int32, len(words)), return_counts=True)
                rows.append(tuple(column[number] for column in columns))
                sizes.append(len(found))
                places.append(found)
                times.append(count.astype(np.int32))
                held += len(raw)
                if held >= SLICE_BYTES:
                    yield block()
                    known, rows, sizes, places, times, held = Places(), [], [], [], [], 0
        if rows:
            yield block()

    picked = docs.select(*carried, F.col(text_col).cast("binary").alias("_text"))
    return staged(picked.mapInArrow(scan, "block bigint, payload binary"), "text-blocks")


def with_values(blocks: DataFrame, values: DataFrame, columns: list[str], work: Callable[[Block, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on each block with its rows of ``values`` (``block`` and ``columns``)."""
    kinds = dict(values.dtypes)
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in columns]
    rows = values.select("block", F.lit(None).cast("binary").alias("payload"), F.lit(1).alias("kind"), *columns).unionByName(
        blocks.select("block", "payload", F.lit(0).alias("kind"), *nothing)
    )

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return work(Block.unpack(part.payload.iloc[0]), part.iloc[1:])

    return by_block(rows, ["kind"], run, schema)
