"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each character of a text, one blank between words, from the three before it
(n-grams of up to ``ORDER`` characters). The first two characters of a word are so predicted across
the blank, from the end of the word before: these n-grams back off to those that begin a word, so
order and repetition of words count. The model is trained per
language on trusted documents: ``share`` of them by hash, and at most about ``train_rows``. N-grams are
counted, discounted and interpolated as tables sharded by n-gram, order by order; what
documents need is looked up there by joins, one row per block and distinct n-gram.

A document is rejected when its log perplexity per character is over its language's
threshold. ``allowance`` digits over its length are taken off first, as the mean of a few characters
says little: one unseen word of a short text is no reason to reject it. The threshold is the
``quantile`` of what is left of all trusted documents that the model does not know, plus ``margin``. A language of fewer than ``fewest``
trusted documents trains on all of them and takes its threshold from these.

Defined cases: a document without words (NULL and empty texts) is rejected; a language without
trusted documents has no model, and its documents stay with a NULL perplexity; a NULL
language is one of its own; rows with a NULL id stay or go by their text; repeated rows get
the same result; an empty input gives an empty result.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tripstrata.llm.base import condensed, discard, let_go, small_batches, staged, tidy
from tripstrata.session import scratch_dir
from tripstrata.storage.files import Files

BLANK = " "
ORDER = 4
ALPHABET = 65_536
# different characters that the numbers of a piece tell apart
MOST_CHARS = 65_536
PIECE_CHARS = 500_000
BLOCK_BYTES = 24_000_000
# rows of ids and languages, some 100 bytes apiece
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Quality:
    train_rows: int = 20_000
    share: float = 0.75
    fewest: int = 8
    quantile: float = 0.99
    margin: float = 0.05
    allowance: float = 3.0


def line_of(text: bytes) -> str:
    """The words of a text with a blank before, between and after them; empty without words."""
    words = text.split()
    return f"{BLANK}{b' '.join(words).decode('utf-8', 'replace')}{BLANK}" if words else ""


class Piece:
    """Lines, or parts of lines, as one array of characters, and their n-grams as numbers.

    Every character is predicted by the ones before it: the first two of a line by what the line
    begins with, all others by three characters, across blanks too.
    """

    def __init__(self, lines: list[str], chars: np.ndarray, known: np.ndarray):
        sizes = np.array([len(x) for x in lines], np.int64)
        ends = np.cumsum(sizes)
        self.known = known
        place = np.zeros(int(known[-1]) + 1 if len(known) else 1, np.uint16)
        place[known] = np.arange(len(known))
        small = place[chars]
        # four characters side by side in one number
        self.width = np.uint64(8 if len(known) <= 256 else 16)
        self.codes = np.zeros(max(0, len(small) - ORDER + 1), np.uint32 if self.width == 8 else np.uint64)
        for offset in range(ORDER):
            shift = self.codes.dtype.type(self.width * np.uint64(ORDER - 1 - offset))
            self.codes |= small[offset : len(small) - ORDER + 1 + offset].astype(self.codes.dtype) << shift
        # windows that begin in the last three characters of a line reach into the next one
        self.whole = np.ones(len(self.codes), bool)
        for back in range(1, ORDER):
            over = (ends - back)[sizes >= back]
            self.whole[over[over < len(self.codes)]] = False
        self.filled = np.flatnonzero(sizes >= ORDER)
        self.begins = (ends - sizes)[self.filled]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each filled line's n-grams."""
        return np.add.reduceat(np.where(self.whole, values, 0.0), self.begins) if len(self.filled) else np.empty(0)

    def texts(self, codes: np.ndarray) -> list[str]:
        """The n-grams that the numbers stand for."""
        mask = np.uint64((1 << int(self.width)) - 1)
        columns = [self.known[((codes.astype(np.uint64) >> (self.width * np.uint64(ORDER - 1 - i))) & mask).astype(np.int64)] for i in range(ORDER)]
        return np.ascontiguousarray(np.stack(columns, axis=1).astype("<u4")).view(f"<U{ORDER}").ravel().tolist() if len(codes) else []


def parts_of(line: str, most: int) -> Iterator[str]:
    """A line in parts of ``most`` n-grams: neighbouring parts share what an n-gram begins with."""
    for at in range(0, max(1, len(line) - ORDER + 1), most):
        yield line[at : at + most + ORDER - 1]


def pieces_of(lines: list[str]) -> Iterator[tuple[np.ndarray, Piece]]:
    """``lines`` in pieces of about ``PIECE_CHARS``, each with the number of the line of each of its filled parts."""

    def told_apart(owner: list[int], parts: list[str]) -> Iterator[tuple[np.ndarray, Piece]]:
        chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
        known = np.unique(chars)
        if len(known) <= MOST_CHARS:
            piece = Piece(parts, chars, known)
            yield np.array(owner, np.int64)[piece.filled], piece
            return
        # parts so short that their characters can be told apart
        for number, part in zip(owner, parts, strict=True):
            for short in parts_of(part, MOST_CHARS - ORDER + 1):
                yield from told_apart([number], [short])

    owner, held, size = [], [], 0
    for number, line in enumerate(lines):
        for part in parts_of(line, PIECE_CHARS):
            if held and size + len(part) > PIECE_CHARS:
                yield from told_apart(owner, held)
                owner, held, size = [], [], 0
            owner.append(number)
            held.append(part)
            size += len(part)
    if held:
        yield from told_apart(owner, held)


def opening(line: str) -> list[str]:
    """The n-grams that predict the first two characters of a line."""
    return [line[:2], line[:3]]


def word_beginnings(line: str) -> Counter:
    """The n-grams that begin a word: what those across blanks fall back on."""
    found: Counter = Counter()
    for word in line.split(BLANK)[1:-1]:
        found[BLANK + word[:1]] += 1
        found[BLANK + (word + BLANK)[:2]] += 1
    return found


def tag_of(lang) -> str:
    """A NULL language is one of its own, apart from the empty text."""
    return "-" if lang is None else f"+{lang}"


class TextStore:
    """``(block, payload)``: consecutive rows of about ``BLOCK_BYTES`` of text, compressed.

    A table bucketed by block, so that what is looked up for a block can come to its texts, and
    the texts stay where they are.
    """

    def __init__(self, docs: DataFrame, carried: list[str]):
        self.spark = docs.sparkSession
        self.name = f"classifier_texts_{uuid.uuid4().hex}"
        self.path = f"{scratch_dir(self.spark, 'classifier-texts')}/rows"
        width = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with small_batches(self.spark):
            _packed(docs, carried).write.option("path", self.path).bucketBy(width, "block").format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        Files(self.spark).delete(self.path)


def _packed(docs: DataFrame, carried: list[str]) -> DataFrame:

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, texts, held = [], [], 0

        def block() -> pa.RecordBatch:
            payload = zstandard.ZstdCompressor(level=3).compress(pickle.dumps((rows, texts)))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(carried))]
            for number, text in enumerate(batch.column(len(carried))):
                rows.append(tuple(column[number] for column in columns))
                texts.append(text.as_py() or b"")
                held += len(texts[-1])
                if held >= BLOCK_BYTES:
                    yield block()
                    rows, texts, held = [], [], 0
        if rows:
            yield block()

    picked = docs.select(*carried, F.col("text").cast("binary").alias("_text"))
    return picked.mapInArrow(tidy(scan), "block bigint, payload binary")


def opened(payload: bytes) -> tuple[list[tuple], list[bytes]]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def by_language(rows: list[tuple]) -> dict[tuple[str, bool], list[int]]:
    """Numbers of the rows ``(id, lang, trained)`` per language, those of the training documents apart."""
    found: dict[tuple[str, bool], list[int]] = {}
    for number, (_, lang, trained) in enumerate(rows):
        found.setdefault((tag_of(lang), trained), []).append(number)
    return found


def block_grams(blocks: DataFrame) -> DataFrame:
    """``(block, lang, gram, n)``: the distinct n-grams of each block, and how often they occur in its training documents."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, payload in zip(batch.block, batch.payload, strict=True):
                rows, texts = opened(payload)
                grams: dict[str, Counter] = {}
                for (lang, trained), numbers in by_language(rows).items():
                    found = grams.setdefault(lang, Counter())
                    lines = [line for n in numbers if (line := line_of(texts[n]))]
                    for _, piece in pieces_of(lines):
                        codes, times = np.unique(piece.codes[piece.whole], return_counts=True)
                        found.update(dict(zip(piece.texts(codes), times.tolist() if trained else [0] * len(codes), strict=True)))
                    for line in lines:
                        found.update(word_beginnings(line) if trained else dict.fromkeys(opening(line), 0))
                for lang, found in grams.items():
                    left = iter(found.items())
                    while some := list(islice(left, 20_000)):
                        yield pd.DataFrame({"block": name, "lang": lang, "gram": [g for g, _ in some], "n": [n for _, n in some]})

    return blocks.mapInPandas(tidy(scan), "block bigint, lang string, gram string, n bigint")


def kind(gram: str) -> Column:
    """N-grams of one kind share their discounts: those of one length, crossing ones apart."""
    size = F.char_length(gram)
    inner = F.substring(gram, F.lit(2), F.greatest(size - 2, F.lit(0)))
    return size + F.when(inner.contains(BLANK), 100).otherwise(0)


def context(gram: str) -> Column:
    return F.substring(gram, F.lit(1), F.char_length(gram) - 1)


def suffix(gram: str) -> Column:
    return F.substring(gram, F.lit(2), F.char_length(gram) - 1)


def count_tables(raw: DataFrame, order: int) -> DataFrame:
    """``(lang, gram, n)`` of every order: as counted for the longest n-grams and those that begin
    a word, else the number of different characters before them."""
    grams = raw.select("lang", "gram", "n")
    levels = [grams]
    current = grams.where(F.char_length("gram") == order)
    for size in range(order - 1, 0, -1):
        shorter = current.groupBy("lang", suffix("gram").alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(shorter)
        begins = grams.where(F.char_length("gram") == size)
        current = shorter.unionByName(begins).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    # n-grams that begin a word are counted themselves; a continuation never begins with a blank unless it is one
    return whole.groupBy("lang", "gram").agg(F.max("n").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """``(lang, kind, d1, d2, d3)`` from the numbers of n-grams seen once to four times."""
    seen = counts.groupBy("lang", kind("gram").alias("kind")).agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

    def d(i: int):
        low, high = F.col(f"n{i}"), F.col(f"n{i + 1}")
        raw = F.when(low > 0, F.lit(float(i)) - (i + 1) * y * high / low).otherwise(0.5 * i)
        return F.greatest(F.lit(0.1), F.least(raw, F.lit(i - 0.05)))

    return seen.select("lang", "kind", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


def model(raw: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """``grams``: (lang, gram, share) after discounting; ``contexts``: (lang, context, back_off)."""
    counts = staged(count_tables(raw, order), "ngram-counts")
    keyed = counts.withColumn("context", context("gram")).withColumn("kind", kind("gram"))
    keyed = keyed.join(discounts(counts), ["lang", "kind"])
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    sums = keyed.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(off).alias("freed"))
    shares = keyed.join(sums, ["lang", "context"]).select("lang", "gram", ((F.col("n") - off) / F.col("total")).alias("share"))
    return staged(shares, "ngram-shares"), staged(sums.select("lang", "context", (F.col("freed") / F.col("total")).alias("back_off")), "ngram-contexts")


def probabilities(wanted: DataFrame, grams: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """``(lang, gram, lp)`` of the distinct n-grams in ``wanted``, log10, shortest order first."""
    levels = [wanted.select("lang", "gram").distinct()]
    for size in range(order, 1, -1):
        longer = levels[-1].where(F.char_length("gram") == size)
        levels.append(levels[-1].where(F.char_length("gram") < size).unionByName(longer.select("lang", suffix("gram").alias("gram"))).distinct())
    lower = None
    for size, level in zip(range(1, order + 1), reversed(levels), strict=True):
        own = level.where(F.char_length("gram") == size)
        found = own.join(grams, ["lang", "gram"], "left").withColumn("context", context("gram")).join(contexts, ["lang", "context"], "left")
        if lower is None:
            below = F.lit(1.0 / ALPHABET)
        else:
            found = found.withColumn("shorter", suffix("gram")).join(
                lower.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below")), ["lang", "shorter"], "left"
            )
            below = F.col("below")
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("back_off", F.lit(1.0)) * below
        now = found.select("lang", "gram", p.alias("p"))
        before = lower
        lower = staged(now if lower is None else now.unionByName(lower), "ngram-probabilities", 10_000)
        if before is not None:
            discard(before)
    return lower.select("lang", "gram", F.log10("p").alias("lp"))


def training_sample(rows: DataFrame, labels: DataFrame, plan: Quality) -> DataFrame:
    """``(id, lang, trained)``, distinct: the trusted rows, and which of them the model is trained on.

    These are ``share`` of a language's rows, and at most about ``train_rows``; the others are kept from
    the model, so that the threshold can be taken from documents it does not know. A language with
    fewer than ``fewest`` rows trains on all of them.
    """
    own = staged(rows.select("id", "lang").join(labels.select("id").distinct(), "id", "left_semi").distinct(), "trusted-rows")
    sizes = own.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    joined = own.alias("o").join(sizes.alias("s"), F.col("o.lang").eqNullSafe(F.col("s.lang")))
    part = F.when(F.col("size") < plan.fewest, 1.0).otherwise(F.least(F.lit(plan.share), plan.train_rows / F.col("size")))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < part * float(1 << 30)
    return staged(joined.select("id", "o.lang", drawn.alias("trained")), "trusted-sample")


def perplexities(docs: DataFrame, sample: DataFrame, plan: Quality, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``(id, lang, n_words, n_chars, flow)``, staged: mean -log10 probability of a character.
    ``sample`` holds ``(id, lang)`` of the training documents."""
    id_type, lang_type = (dict(docs.dtypes)[c] for c in (id_col, lang_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # ids only; a bounded number of rows per language, and broadcast while all of them together are few
    chosen = sample.select("id", "lang", F.lit(True).alias("trained"))
    if chosen.count() <= MOST_BROADCAST:
        chosen = F.broadcast(chosen)
    same = (F.col("d.id") == F.col("s.id")) & F.col("d.lang").eqNullSafe(F.col("s.lang"))
    marked = rows.alias("d").join(chosen.alias("s"), same, "left").select("d.id", "d.lang", F.coalesce("trained", F.lit(False)).alias("trained"), "text")
    store = TextStore(marked, ["id", "lang", "trained"])
    needed = staged(block_grams(store.read()), "block-grams")
    raw = needed.where("n > 0").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams, contexts = model(staged(raw, "trusted-grams"), ORDER)
    values = needed.join(probabilities(needed, grams, contexts, ORDER), ["lang", "gram"]).select("block", "lang", "gram", "lp")
    schema = T.StructType.fromDDL(f"id {id_type}, lang {lang_type}, n_words bigint, n_chars bigint, flow double")
    arrow = to_arrow_schema(schema)

    def summed(block: pa.Table, found: pa.Table) -> pa.Table:
        rows, texts = opened(block.column("payload")[0].as_py())
        known: dict[str, dict[str, float]] = {}
        for some in found.to_batches(max_chunksize=10_000):
            for lang, gram, lp in zip(*(some.column(name).to_pylist() for name in ("lang", "gram", "lp")), strict=True):
                known.setdefault(lang, {})[gram] = lp
        words, chars, logs = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for (lang, _), numbers in by_language(rows).items():
            numbers = np.array(numbers)
            lines = [line_of(texts[n]) for n in numbers]
            chance = known.get(lang, {}).__getitem__
            chars[numbers] = [max(0, len(line) - 1) for line in lines]
            words[numbers] = [max(0, line.count(BLANK) - 1) for line in lines]
            logs[numbers] = [sum(map(chance, opening(line))) if line else 0.0 for line in lines]
            for owner, piece in pieces_of(lines):
                codes, place = np.unique(piece.codes, return_inverse=True)
                # windows over the end of a line may stand for n-grams that nobody asked for
                each = np.array([known.get(lang, {}).get(g, 0.0) for g in piece.texts(codes)])
                if len(owner):
                    np.add.at(logs, numbers[owner], piece.sums(each[place]))
        with np.errstate(invalid="ignore", divide="ignore"):
            flow = -logs / chars
        columns = [[row[0] for row in rows], [row[1] for row in rows], words, chars, flow]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    def combine(block: pa.Table, found: pa.Table) -> pa.Table:
        try:
            return summed(block, found)
        finally:
            let_go()

    together = store.read().groupBy("block").cogroup(values.groupBy("block"))
    found = staged(together.applyInArrow(combine, schema), "perplexities")
    store.drop()
    discard(needed)
    return found


def classify(docs: DataFrame, labels: DataFrame, plan: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, lang, n_words, n_chars, perplexity, threshold, keep)`` per row.

    ``labels`` has an ``id`` column: the ids of trusted documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    sample = training_sample(rows, labels.where(F.col("id").isNotNull()), plan)
    training = sample.where("trained").select("id", "lang")
    found = condensed(lambda: perplexities(docs, training, plan, id_col, text_col, lang_col), "perplexities")
    # all trusted documents: those the model does not know, or where a language has none of these, those it does
    spare = plan.allowance / F.greatest("n_chars", F.lit(1))
    own = F.col("flow") - spare
    limit = lambda value: F.percentile_approx(value, plan.quantile, 10_000)
    same = (F.col("f.id") == F.col("s.id")) & F.col("f.lang").eqNullSafe(F.col("s.lang"))
    ranges = (
        found.where("n_words > 0")
        .alias("f")
        .join(sample.alias("s"), same)
        .groupBy("f.lang")
        .agg((F.coalesce(limit(F.when(~F.col("trained"), own)), limit(own)) + plan.margin).alias("base"))
    )
    joined = found.alias("f").join(ranges.alias("r"), F.col("f.lang").eqNullSafe(F.col("r.lang")), "left")
    joined = joined.withColumn("limit", F.col("base") + spare)
    spelled = (F.col("n_words") > 0) & F.col("limit").isNotNull()
    keep = (F.col("n_words") > 0) & (F.col("limit").isNull() | (F.col("flow") <= F.col("limit")))
    power = lambda x: F.when(spelled, F.pow(F.lit(10.0), x))
    return joined.select(
        "id", F.col("f.lang").alias("lang"), "n_words", "n_chars", power(F.col("flow")).alias("perplexity"), power(F.col("limit")).alias("threshold"), keep.alias("keep")
    )


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents labelled as good and not toxic."""
    return labels.where("quality = 1 AND toxic = 0").select(F.col(id_col).alias("id"))


def kept_rows(docs: DataFrame, labels: DataFrame, plan: Quality = Quality(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps.

    Ids name rows here: rows that share an id stay when all of them would.
    """
    marks = classify(docs, labels, plan, id_col, text_col, lang_col)
    rejected = staged(marks.where(~F.col("keep")).select("id").distinct(), "rejected")
    inner = docs.select(F.struct("*").alias("_row"))
    left = inner.alias("d").join(rejected.alias("r"), F.col(f"d._row.{id_col}").eqNullSafe(F.col("r.id")), "left_anti")
    return left.select("_row.*")
