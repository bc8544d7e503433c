"""Runs: maximal stretches of words that repeat with a period, found by internal pattern matching.

The words of a slice of documents are named by doubling: level k numbers the blocks of 2^k words
in their sorted order, so a number is also where the block's interval of the suffix array begins,
and equal numbers mean equal blocks. A wavelet tree over the suffix array then answers for any
block the least occurrence from a place on (range successor).

A run of period q and length L holds, wherever it lies, a block of b words that begins at a
multiple of b/2 and occurs again q words on, if b + b/2 - 1 <= L - q. Blocks of b words therefore
look for occurrences in neighbouring windows at those distances only that smaller or larger blocks
do not answer for. Occurrences of a block within b starts form one arithmetic progression, so
three queries give them all. Each distance is a candidate period, extended to both sides by
comparing names. Where a progression has three members or more and goes on from the block itself,
the block lies in a stretch of the progression's difference, and only that is a candidate: any
other distance would be a multiple of it.

Documents whose blocks of four words all differ hold no run and need no suffix array. Everything
happens within one document, so nothing is shuffled. A slice takes about 200 bytes a word; a long
document is a slice of its own.

Defined cases: words are what lies between ASCII white space; NULL and blank texts have no words,
no runs and an empty text left; ids of any type, NULL and repeated ones pass through; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_WORDS = 200_000
LEAST_LENGTH = 12
BASE = 2  # blocks of 2^BASE words are the smallest: enough for runs of LEAST_LENGTH words


# ---------------------------------------------------------------- names and suffix array


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, first place of each sorted key's group, and size of that group."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(heads, len(keys)))
    return order, np.repeat(heads, sizes), np.repeat(sizes, sizes)


def names(codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per level, each position's name and the size of its group; at the last level all differ.

    ``codes`` ends with a value that occurs once, as does each document in it.
    """
    count = len(codes)
    order, heads, sizes = ranked(codes)
    rank, size = np.empty(count, np.int64), np.empty(count, np.int64)
    rank[order], size[order] = heads, sizes
    ranks, group_sizes = [rank], [size]
    step = 1
    active = np.flatnonzero(size > 1)
    while len(active):
        old = rank[active]
        order, heads, sizes = ranked(old * count + rank[active + step])
        moved, before = active[order], old[order]
        # a group of equal old names is sorted as a whole: new names count on from its first place
        first = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        base = np.repeat(first, np.diff(np.append(first, len(before))))
        rank, size = rank.copy(), size.copy()
        rank[moved], size[moved] = before + heads - base, sizes
        ranks.append(rank)
        group_sizes.append(size)
        active = moved[sizes > 1]
        step *= 2
    return ranks, group_sizes


class Lengths:
    """Longest common extensions by names."""

    def __init__(self, ranks: list[np.ndarray]):
        self.ranks = ranks[:-1]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.ranks))):
            step = (self.ranks[level][i] == self.ranks[level][j]).astype(np.int64) << level
            i, j, total = i + step, j + step, total + step
        return total

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.ranks))):
            width = 1 << level
            room = np.minimum(i, j) >= width
            a, b = np.where(room, i - width, 0), np.where(room, j - width, 0)
            step = (room & (self.ranks[level][a] == self.ranks[level][b])).astype(np.int64) << level
            i, j, total = i - step, j - step, total + step
        return total


# ---------------------------------------------------------------- wavelet tree


class Wavelet:
    """Wavelet tree over ``values``, kept as one array of counted zeros per bit."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in reversed(range(max(1, int(len(values)).bit_length()))):
            one = (values >> bit) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - one))).astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate((values[one == 0], values[one == 1]))

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of the values at ``[low, high)`` are less than ``limit``."""
        found = np.zeros(len(low), np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = ((limit >> bit) & 1).astype(bool)
            found += np.where(one, b - a, 0)
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return found

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th least (from 0) of the values at ``[low, high)``."""
        value = np.zeros(len(low), np.int64)
        for bit, zeros, total in self.levels:
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            one = n >= b - a
            value += one.astype(np.int64) << bit
            n = np.where(one, n - (b - a), n)
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return value


# ---------------------------------------------------------------- runs


def distances(block: int) -> tuple[int, int]:
    """Distances that blocks of ``block`` words answer for."""
    return (1 if block == 1 << BASE else block + block // 2 - 1), 3 * block - 2


def candidates(ranks: list[np.ndarray], sizes: list[np.ndarray], longest: Lengths) -> tuple[np.ndarray, np.ndarray]:
    """``(place, distance)`` of blocks that occur again at the distance, enough to meet every run."""
    count = len(ranks[0])
    # the last level numbers all suffixes: its inverse is the suffix array
    suffixes = np.empty(count, np.int64)
    suffixes[ranks[-1]] = np.arange(count)
    tree = None
    places, steps = [], []

    def keep(at: np.ndarray, apart: np.ndarray) -> None:
        places.append(at)
        steps.append(apart)

    for level in range(BASE, len(ranks) - 1):
        block = 1 << level
        nearest, farthest = distances(block)
        at = np.arange(0, count, block // 2)
        at = at[sizes[level][at] > 1]
        if not len(at):
            continue
        tree = tree or Wavelet(suffixes)
        low = ranks[level][at]
        high = low + sizes[level][at]
        passed = tree.below(low, high, np.minimum(at + nearest, count))
        some = low + passed < high
        at, low, high, passed = at[some], low[some], high[some], passed[some]
        near = tree.nth(low, high, passed) <= at + farthest
        at, low, high, passed = at[near], low[near], high[near], passed[near]
        for begin in range(nearest, farthest + 1, block):
            until = tree.below(low, high, np.minimum(at + min(begin + block, farthest + 1), count))
            number = until - passed
            has = number > 0
            where, found = at[has], number[has]
            first = tree.nth(low[has], high[has], passed[has])
            keep(where[found <= 2], (first - where)[found <= 2])
            more = found >= 2
            second = tree.nth(low[has][more], high[has][more], passed[has][more] + 1)
            where, found, first = where[more], found[more], first[more]
            keep(where[found == 2], (second - where)[found == 2])
            many = found > 2
            where, found, first, apart = where[many], found[many], first[many], (second - first)[many]
            keep(where, apart)
            other = where + apart + longest.ahead(where, where + apart) < first + block
            where, found, first, apart = where[other], found[other], first[other], apart[other]
            member = np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
            keep(np.repeat(where, found), np.repeat(first - where, found) + member * np.repeat(apart, found))
            passed = until
    return np.concatenate([*places, np.empty(0, np.int64)]), np.concatenate([*steps, np.empty(0, np.int64)])


def runs(codes: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs of ``least`` (12 or more) words, by start and period."""
    ranks, sizes = names(codes)
    longest = Lengths(ranks)
    at, period = candidates(ranks, sizes, longest)
    start = at - longest.back(at, at + period)
    end = at + period + longest.ahead(at, at + period)
    good = end - start >= np.maximum(least, 2 * period)
    found = np.stack((start[good], end[good], period[good]))
    # one stretch may show several periods, of which the smallest is its own
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    if found.shape[1]:
        found = found[:, np.concatenate(([True], (np.diff(found[:2]) != 0).any(axis=0)))]
    found = found[:, np.lexsort((found[2], found[0]))]
    return found[0], found[1], found[2]


def repeating(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Documents with two equal blocks of four words; equal hashes of different blocks only add to them."""
    block = 1 << BASE
    owner = np.repeat(np.arange(len(sizes)), sizes)
    count = len(codes) - block + 1
    if count < 1:
        return np.empty(0, np.int64)
    whole = owner[:count] == owner[block - 1 :]
    mixed = owner[:count].astype(np.uint64)
    for j in range(block):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + count].astype(np.uint64)
    at = np.flatnonzero(whole)
    order = at[np.argsort(mixed[at], kind="stable")]
    again = mixed[order[1:]] == mixed[order[:-1]]
    return np.unique(owner[order[1:][again]])


def slice_runs(documents: list[list[bytes]], least: int = LEAST_LENGTH) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of the runs of each document."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    places: dict[bytes, int] = {}
    lists = [[places.setdefault(w, len(places)) for w in words] for words in documents]
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.fromiter((c for x in lists for c in x), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    chosen = repeating(flat, sizes)
    if not len(chosen):
        return out
    # a document's words are its own, and a value that occurs once ends it
    parts, total = [], len(places)
    for number, document in enumerate(chosen.tolist()):
        own = flat[ends[document] - sizes[document] : ends[document]]
        parts += [own + (number * (total + 1) + 1), np.array([number * (total + 1)])]
    begins = np.concatenate(([0], np.cumsum(sizes[chosen] + 1)))
    start, end, period = runs(np.concatenate(parts), least)
    owner = np.searchsorted(begins, start, side="right") - 1
    for number, s, e, q in zip(owner.tolist(), (start - begins[owner]).tolist(), (end - begins[owner]).tolist(), period.tolist(), strict=True):
        out[chosen[number]].append((s, e - s, q))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words left when each run keeps its first period only."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")]), False)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``(id, n_words, runs, collapsed)``: runs of ``least`` words or more, at least 12, and the text without their repetitions."""
    if least < LEAST_LENGTH:
        raise ValueError(f"runs shorter than {LEAST_LENGTH} words need smaller blocks")
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, documents, held = [], [], 0

        def result() -> pa.RecordBatch:
            found = slice_runs(documents, least)
            columns = [ids, [len(w) for w in documents], [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found], [collapsed(w, x) for w, x in zip(documents, found, strict=True)]]
            return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()  # bytes know no other white space
                ids.append(key)
                documents.append(words)
                held += len(words)
                if held >= SLICE_WORDS or len(ids) >= 10_000:
                    yield result()
                    ids, documents, held = [], [], 0
        if ids:
            yield result()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(scan, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with, in a tenth of them by a checksum of the id, the words from some place on replaced by repetitions of a few of them."""
    checksum = F.crc32(F.col(id_col).cast("string"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = docs.withColumn("_sum", checksum).withColumn("_words", F.when(F.col("_sum") % 10 == 0, words))
    g, n = F.floor(F.col("_sum") / 10), F.size("_words")
    marked = marked.withColumn("_g", g).withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    period = (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    marked = marked.withColumn("_p", period)
    tail = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    changed = F.slice(F.concat(F.slice("_words", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(tail, times))), F.lit(1), F.col("_n"))
    text = F.when(F.col("_n") > 0, F.array_join(changed, " ")).otherwise(F.col(text_col))
    return marked.withColumn(text_col, text).drop("_sum", "_words", "_g", "_n", "_a", "_p")
