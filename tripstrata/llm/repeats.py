"""Removal of strings that occur more than once in a corpus, by suffix arrays over what is contested.

Every string of ``length`` bytes has one anchor: the least of the hashed 16-byte grams that begin
at its first 32 bytes. Equal strings have equal anchors at the same place, so the corpus falls
apart by anchors without losing a match. The strings of one anchor, a few neighbouring starts, all
contain the ``length - 31`` bytes from the anchor on, its core; the bytes on both sides are its
wings. Then, block of texts by block:

1. Cores are counted over the corpus, once per block, and so are cores with their wings. A core
   that occurs once ends there. A core with its wings that occurs elsewhere too is settled: all
   its strings repeat.
2. What is left has a core that occurs elsewhere with other wings: the borders of the repeated
   passages. Each such anchor, and one of each settled kind with the same core, becomes a short
   sequence: left wing, a symbol for the core, right wing. Suffix arrays over such sequences, whole
   groups of a core together, are built by linear grouping of Lyndon prefixes (``grouping``); a
   string is repeated if its suffix agrees with a neighbour in the array over the string's length.
3. All starts found go back to their block, and the bytes they cover are cut.

Cores with more than ``most`` sequences are not sorted in one task: their strings are counted by
their wings, which spreads them. Within a block equal anchors are one before anything is shuffled,
so a group of a third of all rows costs a core at most one row per block.

Defined cases: a NULL text is empty; texts shorter than ``length`` lose nothing; texts are bytes, so
a cut may fall inside a character, and ``kept`` is binary; ids of any type, NULL and repeated ones
pass through, equal rows are documents of their own; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tripstrata.llm.base import staged
from tripstrata.llm.grouping import suffix_array
from tripstrata.llm.shingles import mixed

LENGTH = 200
GRAM, STARTS = 16, 32
BLOCK_BYTES = 4 << 20
PART_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
SORTED_SYMBOLS = 100_000
ROWS_A_TASK = 5_000
MOST = 20_000

_DRAW = np.random.default_rng(20)
_BYTES = _DRAW.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = _DRAW.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


# ---------------------------------------------------------------- anchors


def grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from each place on."""
    found, step = _BYTES[raw], 1
    while step < GRAM:
        found = found[:-step] * _ODD[step.bit_length()] + found[step:]
        found ^= found >> np.uint64(31)
        step *= 2
    return mixed(found)


def _spans(hashes: np.ndarray, begin: np.ndarray, width: int, seed: np.ndarray) -> np.ndarray:
    """Hash of ``width`` bytes from each of ``begin`` on."""
    for offset in [*range(0, width - GRAM, GRAM), width - GRAM]:
        seed = mixed(seed * _ODD[0] + hashes[begin + offset])
    return seed


class Anchors:
    """The anchors of a block's strings: place, first and last start, and hashes of core and core with wings."""

    def __init__(self, raw: np.ndarray, sizes: np.ndarray, length: int):
        ends = np.cumsum(sizes)
        parts = []
        begin = 0
        for last, size in zip(ends.tolist(), sizes.tolist(), strict=True):
            # documents are gathered to pieces; a longer document is cut into pieces of its own
            if last - begin >= PIECE_BYTES or last == len(raw):
                at = begin
                while last - at >= length:
                    stop = min(at + PIECE_BYTES, last - length + 1) if size > PIECE_BYTES else last - length + 1
                    inside = ends[(ends > at) & (ends < stop + length - 1)]
                    parts.append(self._piece(raw[at : stop + length - 1], inside - at, length, at))
                    at = stop
                begin = last
        empty = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint64)] * 2
        self.at, self.first, self.last, self.core, self.whole = (np.concatenate(x) for x in zip(*parts, empty, strict=True))

    @staticmethod
    def _piece(raw: np.ndarray, ends: np.ndarray, length: int, shift: int) -> tuple[np.ndarray, ...]:
        starts = len(raw) - length + 1
        hashes = grams(raw)
        least = (hashes[: starts + STARTS - 1] & ~_PLACE) | np.arange(starts + STARTS - 1, dtype=np.uint64)
        step = 1
        while step < STARTS:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        at = (least[:starts] & _PLACE).astype(np.int64)
        # strings do not reach over the end of a document
        for end in ends.tolist():
            at[max(0, end - length + 1) : end] = -1
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], starts) - 1
        at = at[first]
        real = at >= 0
        at, first, last = at[real], first[real], last[real]
        core = _spans(hashes, at, length - STARTS + 1, np.full(len(at), 1, np.uint64))
        # the wings have fewer than 32 bytes: two grams from the first start on, and two up to the last end, cover them
        whole = mixed(core * _ODD[0] + ((at - first) << 8 | (last - first)).astype(np.uint64))
        for place in (first, first + GRAM, last + length - 2 * GRAM, last + length - GRAM):
            whole = mixed(whole * _ODD[0] + hashes[place])
        return at + shift, first + shift, last + shift, core, whole


class Distinct:
    """Sorted distinct values, the first place of each, each place's number, and which come more than once."""

    def __init__(self, values: np.ndarray):
        self.values, self.first, self.number, times = np.unique(values, return_index=True, return_inverse=True, return_counts=True)
        self.again = times > 1

    def cells(self, bits: int) -> np.ndarray:
        """Bounds of the values by their leading ``bits``."""
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
        return np.concatenate(([0], np.searchsorted(self.values, edges), [len(self.values)]))


# ---------------------------------------------------------------- rows of bytes


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, bytes of equal weight side by side."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(planes: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def _streamed(rows: DataFrame, key: str, order: list[str], work: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """``work(key, rows)`` on the rows of each key, which are of bounded size together."""
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    columns = len(rows.columns)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of, out, size = [], None, [], 0

        def batch_of(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

        def rest() -> Iterator[tuple]:
            if held:
                yield from work(of, held)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(columns)), strict=True):
                if row[0] != of:
                    for found in rest():
                        out.append(found)
                        size += sum(len(v) if isinstance(v, (bytes, list)) else 8 for v in found)
                        if size > 4 << 20:
                            yield batch_of(out)
                            out, size = [], 0
                    held, of = [], row[0]
                held.append(row[1:])
        out.extend(rest())
        if out:
            yield batch_of(out)

    ordered = rows.select(key, *[c for c in rows.columns if c != key])
    return ordered.repartition(key).sortWithinPartitions(key, *order).mapInArrow(scan, kind)


# ---------------------------------------------------------------- the steps


def _text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(block, ids, bytes, sizes, payload)``, staged: consecutive texts of about ``BLOCK_BYTES``."""
    kind = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
            T.StructField("bytes", T.LongType()),
            T.StructField("sizes", T.BinaryType()),
            T.StructField("payload", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def block() -> pa.RecordBatch:
            sizes = np.array([len(x) for x in texts], "<i8")
            payload = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_pylist([{"block": uuid.uuid4().int >> 65, "ids": ids, "bytes": held, "sizes": sizes.tobytes(), "payload": payload}], arrow)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(key)
                texts.append(text.as_py() or b"")
                held += len(texts[-1])
                if held >= BLOCK_BYTES or len(ids) >= 100_000:
                    yield block()
                    ids, texts, held = [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return staged(rows.mapInArrow(scan, kind), "repeat-blocks")


def _unpacked(sizes: bytes, payload: bytes) -> tuple[bytes, np.ndarray]:
    return zstandard.ZstdDecompressor().decompress(payload), np.frombuffer(sizes, "<i8")


def _keys(blocks: DataFrame, length: int, bits: int) -> DataFrame:
    """``(part, block, payload)``: the distinct cores (even parts) and cores with wings (odd parts) of each block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text, sizes = _unpacked(sizes, payload)
                found = Anchors(np.frombuffer(text, np.uint8), sizes, length)
                cores, wholes = Distinct(found.core), Distinct(found.whole)
                # of a core's wings 40 bits go along; 0 where the block has several
                wings = found.whole & np.uint64((1 << 40) - 1)
                mixed_wings = np.bincount(cores.number, weights=wings != wings[cores.first][cores.number], minlength=len(cores.values)) > 0
                own = np.where(mixed_wings, np.uint64(0), wings[cores.first])
                out = []
                packer = zstandard.ZstdCompressor(level=1)
                for kind, distinct in ((0, cores), (1, wholes)):
                    bounds = distinct.cells(bits)
                    for part in np.flatnonzero(np.diff(bounds)).tolist():
                        cell = slice(bounds[part], bounds[part + 1])
                        # the leading bits are the part's number
                        rest = distinct.values[cell] << np.uint64(bits)
                        if kind:
                            data = _planes(rest, 8)
                        else:
                            data = _planes(rest >> np.uint64(24), 5) + _planes(own[cell], 5)
                        out.append((2 * part + kind, block, packer.compress(data + _bits(distinct.again[cell])), cell.stop - cell.start))
                if out:
                    part, owner, data, count = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(owner, pa.int64()), pa.array(data, pa.binary()), pa.array(count, pa.int64())], names=["part", "block", "payload", "count"])

    return blocks.select("block", "sizes", "payload").mapInArrow(scan, "part bigint, block bigint, payload binary, count bigint")


def _answer(part: int, rows: list[tuple]) -> Iterator[tuple]:
    """Per block of a part, as bits: cores that occur again, and cores whose wings differ; or wings that occur again, and the block that stands for them."""
    opened = [zstandard.ZstdDecompressor().decompress(payload) for _, payload, _ in rows]
    counts = [count for _, _, count in rows]
    width = 8 if part % 2 else 5
    values = np.concatenate([_values(data[: n * width], width) for data, n in zip(opened, counts, strict=True)])
    again = np.concatenate([_flags(data[-(-(-n // 8)) :], n) for data, n in zip(opened, counts, strict=True)])
    order = np.argsort(values, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], values[order][1:] != values[order][:-1])))
    sizes = np.diff(np.append(heads, len(values)))
    repeated = (sizes > 1) | (np.add.reduceat(again[order], heads, dtype=np.int64) > 0)
    one, two = np.zeros(len(values), bool), np.zeros(len(values), bool)
    one[order] = np.repeat(repeated, sizes)
    if part % 2:
        # rows come by block, so the sort leaves the least block of each value first
        two[order[heads]] = repeated
    else:
        wings = np.concatenate([_values(data[n * 5 : n * 10], 5) for data, n in zip(opened, counts, strict=True)])[order]
        low, high = np.minimum.reduceat(wings, heads), np.maximum.reduceat(wings, heads)
        two[order] = np.repeat(repeated & ((low != high) | (low == 0)), sizes)
    ends = np.cumsum(counts)
    for (block, _, _), n, end in zip(rows, counts, ends.tolist(), strict=True):
        cell = slice(end - n, end)
        if one[cell].any():
            yield block, part, _bits(one[cell]) + _bits(two[cell])


def _sequences(length: int, bits: int) -> Callable[[int, list[tuple]], Iterator[tuple]]:
    """Settled ranges of starts (no core), and contested anchors as ``(core, text, left, block, at, until, own)``."""

    def work(block: int, rows: list[tuple]) -> Iterator[tuple]:
        (_, sizes, payload), answers = rows[0], rows[1:]
        text, sizes = _unpacked(sizes, payload)
        found = Anchors(np.frombuffer(text, np.uint8), sizes, length)
        marks = []
        for kind, values in ((0, found.core), (1, found.whole)):
            distinct = Distinct(values)
            bounds = distinct.cells(bits)
            one, two = np.zeros(len(distinct.values), bool), np.zeros(len(distinct.values), bool)
            for part, _, data in answers:
                if part % 2 == kind:
                    cell = slice(bounds[part // 2], bounds[part // 2 + 1])
                    count = cell.stop - cell.start
                    half = -(-count // 8)
                    one[cell], two[cell] = _flags(data[:half], count), _flags(data[half:], count)
            marks.append((distinct, one[distinct.number], two[distinct.number], two))
        (_, again, differ, _), (wholes, settled, _, standing) = marks
        # neighbouring anchors that are settled make one range
        first, last = found.first[settled], found.last[settled] + 1
        if len(first):
            open_ = np.concatenate(([True], first[1:] != last[:-1]))
            close = np.concatenate((open_[1:], [True]))
            for a, b in zip(first[open_].tolist(), last[close].tolist(), strict=True):
                yield None, None, None, block, a, b, None
        own = again & ~settled
        stands = np.zeros(len(own), bool)
        stands[wholes.first[standing]] = True
        core = length - STARTS + 1
        wanted = np.flatnonzero(own | (stands & differ))
        columns = [x[wanted].tolist() for x in (found.core.view(np.int64), found.at, found.first, found.last, own)]
        for name, at, first, last, mine in zip(*columns, strict=True):
            yield name, text[first:at] + text[at + core : last + length], at - first, block, first, last + 1, mine

    return work


def repeated_windows(sequences: list[tuple[bytes, int, int]]) -> list[list[int]]:
    """For each ``(text, left, core)`` the offsets whose string occurs in another one, from one suffix array over all."""
    symbols, begins = [], []
    total = 0
    for text, left, core in sequences:
        # 0 ends all, 1 ends a sequence, then bytes, then cores
        codes = np.frombuffer(text, np.uint8).astype(np.int64) + 2
        symbols += [codes[:left], np.array([258 + core]), codes[left:], np.array([1])]
        begins.append(total)
        total += len(text) + 2
    codes = np.concatenate([*symbols, np.array([0])])
    order = suffix_array(codes)
    start = np.zeros(len(codes), bool)
    for begin, (_, left, _) in zip(begins, sequences, strict=True):
        start[begin : begin + left + 1] = True
    # a string begins in the left wing and reaches past the core into the right one
    span = np.array([len(text) + 1 for text, _, _ in sequences])
    room = np.zeros(len(codes), np.int64)
    for begin, n in zip(begins, span.tolist(), strict=True):
        room[begin : begin + n] = np.arange(n, 0, -1)
    a, b = order[:-1], order[1:]
    both = np.flatnonzero(start[a] & start[b] & (room[a] >= STARTS) & (room[b] >= STARTS))
    for offset in range(STARTS):
        both = both[codes[a[both] + offset] == codes[b[both] + offset]]
    hit = np.unique(np.concatenate((a[both], b[both])))
    owner = np.searchsorted(begins, hit, side="right") - 1
    out: list[list[int]] = [[] for _ in sequences]
    for number, place in zip(owner.tolist(), hit.tolist(), strict=True):
        out[number].append(place - begins[number])
    return out


def _sorted_groups(rows: DataFrame, tasks: int) -> DataFrame:
    """``(block, at, until)``: ranges of repeated starts of the sequences, whole groups of a core sorted together."""
    arrow = to_arrow_schema(T.StructType.fromDDL("block bigint, at bigint, until bigint"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        cores: dict[int, int] = {}
        symbols = 0

        def result() -> pa.RecordBatch:
            found = repeated_windows([(text, left, cores[core]) for core, text, left, *_ in held])
            out = [(block, at + x, at + x + 1) for (_, _, _, block, at, own), hits in zip(held, found, strict=True) if own for x in hits]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ((), (), ()))], schema=arrow)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] not in cores and symbols >= SORTED_SYMBOLS:
                    yield result()
                    held, cores, symbols = [], {}, 0
                cores.setdefault(row[0], len(cores))
                held.append(row)
                symbols += len(row[1]) + 2
        if held:
            yield result()

    columns = ["core", "text", "left", "block", "at", "own"]
    return rows.select(*columns).repartition(tasks, "core").sortWithinPartitions("core").mapInArrow(scan, "block bigint, at bigint, until bigint")


def _counted_groups(rows: DataFrame) -> DataFrame:
    """The same for cores with very many sequences: equal strings meet by core, place and wings, and are counted before they are sent."""
    each = rows.select("core", "left", "text", "block", "at", "own", F.explode(F.sequence(F.lit(0), F.col("until") - F.col("at") - 1)).alias("offset"))
    string = F.col("text").substr(F.col("offset").cast("int") + 1, F.lit(STARTS - 1))
    keys = {"core": F.col("core"), "before": F.col("left") - F.col("offset"), "string": F.sha2(string, 256)}
    marked = each.select(*[v.alias(k) for k, v in keys.items()], "block", "at", "own", "offset")
    repeated = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = marked.where("own").join(repeated, list(keys), "left_semi")
    return found.select("block", (F.col("at") + F.col("offset")).alias("at"), (F.col("at") + F.col("offset") + 1).alias("until"))


def _cut(length: int) -> Callable[[int, list[tuple]], Iterator[tuple]]:
    def work(block: int, rows: list[tuple]) -> Iterator[tuple]:
        (_, _, _, ids, sizes, payload), ranges = rows[0], rows[1:]
        text, sizes = _unpacked(sizes, payload)
        change = np.zeros(len(text) + length + 1, np.int32)
        if ranges:
            at, until = np.array([r[1] for r in ranges]), np.array([r[2] for r in ranges])
            np.add.at(change, at, 1)
            np.add.at(change, until + length - 1, -1)
        covered = np.cumsum(change[: len(text)]) > 0
        raw = np.frombuffer(text, np.uint8)
        end = 0
        for key, size in zip(ids, sizes.tolist(), strict=True):
            own = covered[end : end + size]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            spans = [{"first": a, "last": b - 1} for a, b in edges.reshape(-1, 2).tolist()]
            kept = raw[end : end + size][~own].tobytes() if spans else text[end : end + size]
            yield key, size, size - len(kept), spans, kept
            end += size

    return work


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = MOST) -> DataFrame:
    """``(id, n_bytes, n_removed, spans, kept)`` per row: the bytes in no string of ``length`` bytes that begins elsewhere too."""
    if length < 2 * STARTS:
        raise ValueError(f"strings must have {2 * STARTS} bytes at least")
    blocks = _text_blocks(docs, id_col, text_col)
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    bits = max(3, (total // PART_BYTES).bit_length())

    answers = _streamed(_keys(blocks, length, bits), "part", ["block"], _answer, "block bigint, part bigint, bits binary")
    none = F.lit(None)
    texts = blocks.select("block", F.lit(-1).cast("bigint").alias("part"), "sizes", "payload")
    asked = texts.unionByName(answers.select("block", "part", none.cast("binary").alias("sizes"), F.col("bits").alias("payload")))
    schema = "core bigint, text binary, left int, block bigint, at bigint, until bigint, own boolean"
    found = staged(_streamed(asked, "block", ["part"], _sequences(length, bits), schema), "repeat-sequences")

    contested = found.where("core IS NOT NULL")
    groups = contested.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("open")).where("n > 1 AND open")
    small, large = (contested.join(groups.where(F.col("n") <= most if few else F.col("n") > most).select("core"), "core", "left_semi") for few in (True, False))
    settled = found.where("core IS NULL").select("block", "at", "until")
    # sorting takes its time per row, not per byte: the number of tasks follows the rows
    tasks = -(-contested.count() // ROWS_A_TASK) or 1
    ranges = settled.unionByName(_sorted_groups(small, tasks)).unionByName(_counted_groups(large))

    id_kind = blocks.schema["ids"].dataType.elementType
    whole = blocks.select("block", F.lit(0).alias("kind"), none.cast("bigint").alias("at"), none.cast("bigint").alias("until"), "ids", "sizes", "payload")
    empty = {"ids": blocks.schema["ids"].dataType, "sizes": "binary", "payload": "binary"}
    cuts = ranges.select("block", F.lit(1).alias("kind"), "at", "until", *[none.cast(kind).alias(name) for name, kind in empty.items()])
    result = "id " + id_kind.simpleString() + ", n_bytes bigint, n_removed bigint, spans array<struct<first: bigint, last: bigint>>, kept binary"
    return _streamed(whole.unionByName(cuts), "block", ["kind"], _cut(length), result)
