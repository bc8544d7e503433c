"""What the operators share: staging, ASCII word rules, and table access."""

from __future__ import annotations

import ctypes
import gc
import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.session import scratch_dir
from tripstrata.storage.files import Files

# The white space that separates words, as a character class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int | None = None) -> Iterator[None]:
    """Arrow batches of few rows, and of few bytes where given, meanwhile: rows here are texts, sets and vectors, and workers must stay small."""
    wanted = {BATCH_CONF: str(rows)} | ({BYTES_CONF: f"{size}b"} if size else {})
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def staged(df: DataFrame, label: str, batch_rows: int = BATCH_ROWS, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back.

    Cuts the lineage: what reads it survives lost executors without redoing the work. ``batch_rows``
    and ``batch_bytes`` bound the Arrow batches Python workers get meanwhile, which both sides hold
    outside the heap; rows are few unless they are known to be short.
    """
    spark = df.sparkSession
    folder = scratch_dir(spark, label)
    with small_batches(spark, batch_rows, batch_bytes):
        df.write.parquet(f"{folder}/rows")
    if _STEPS:
        _STEPS[-1].append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


# folders that were staged within each open ``condensed``
_STEPS: list[list[str]] = []


def condensed(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The staged result of ``make``; what was staged on the way to it is removed."""
    _STEPS.append([])
    try:
        result = staged(make(), label)
    finally:
        folders = _STEPS.pop()
    for folder in folders[:-1]:
        Files(result.sparkSession).delete(folder)
    if _STEPS:
        _STEPS[-1].append(folders[-1])
    return result


def discard(*frames: DataFrame) -> None:
    """Remove staged frames that nothing reads any more; what the session ends with is removed then."""
    for df in frames:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            Files(df.sparkSession).delete(folder)


def let_go() -> None:
    """Give what this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(scan: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``scan``, a task's work in Python, after which its memory goes back to the system.

    Workers wait for the next task beside the JVM, and what they keep counts as the executor's in
    all later steps, also in those without Python.
    """

    @wraps(scan)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from scan(batches)
        finally:
            let_go()

    return run


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character unchanged."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of ``keys`` between two aliased frames."""
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def keep_one(docs: DataFrame, marks: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``docs``, all columns, that ``marks`` keeps; one row of those with equal keys.

    ``keys`` are expressions over ``docs``; ``marks`` holds them as columns, and ``kept``, which
    rows with equal keys share. Only the keys of dropped and of repeated rows are joined. The dropped
    grow with the input, so they are merged with the rows at every size and never broadcast.
    """
    names = list(keys)
    dropped = staged(marks.where(~F.col("kept")).select(*names).distinct(), "dropped")
    repeated = marks.where("kept").groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = staged(repeated.select(*names), "repeated")
    # operators see the rows of ``docs`` as one struct, so that names cannot clash
    inner = docs.select(F.struct("*").alias("_row"), *[value.alias(name) for name, value in keys.items()])
    left = inner.alias("l").join(dropped.hint("merge").alias("r"), same("l", "r", names), "left_anti")
    once = left.alias("l").join(repeated.alias("r"), same("l", "r", names), "left_anti")
    again = left.alias("l").join(repeated.alias("r"), same("l", "r", names), "left_semi").dropDuplicates(names)
    return once.unionByName(again).select("_row.*")
