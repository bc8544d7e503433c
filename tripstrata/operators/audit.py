"""Does clean hold exactly the rows it should, counted as a multiset?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.operators.staging import clean_trips
from tripstrata.schemas import LAYERS
from tripstrata.storage.manifest import DIGEST_FIELDS, Digest, digest_columns

# copies of one row that one task writes out
COPIES_PER_TASK = 100_000


class BatchMismatch(RuntimeError):
    """Clean and the staged rows it was built from differ."""


def surplus(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left.exceptAll(right)`` with a count ``n`` in place of repeated rows.

    A row repeated a billion times stays one row, so no task has to write it out.
    """
    columns = left.columns
    signed = left.withColumn("n", F.lit(1)).unionAll(right.select(*columns).withColumn("n", F.lit(-1)))
    return signed.groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def repeated(counted: DataFrame, copies_per_task: int = COPIES_PER_TASK) -> DataFrame:
    """Each row of ``counted`` as often as its ``n`` says.

    Counts are cut into numbered chunks, which are dealt out before the copies are made, so the
    copies of one row are written by many tasks.
    """
    columns = [c for c in counted.columns if c != "n"]
    chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / copies_per_task)))
    # the number is given, as few bytes before the copies are many after them
    width = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.select("*", chunks.alias("_chunk")).repartition(width, *columns, "_chunk")
    size = F.least(F.lit(copies_per_task), F.col("n") - F.col("_chunk") * copies_per_task).cast("int")
    return dealt.select(*columns, F.explode(F.sequence(F.lit(1), size)).alias("_copy")).drop("_copy")


def missing_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected minus actual, keeping repeats."""
    return repeated(surplus(expected, actual))


def extra_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return missing_rows(actual, expected)


def batch_digests(trips: DataFrame) -> DataFrame:
    """Digest of each batch's fingerprints; the shuffle carries one row per batch and task."""
    return trips.groupBy("batch_id").agg(*digest_columns(F.col("row_fingerprint")))


def _digests(trips: DataFrame) -> dict[str | None, Digest]:
    """A batch is a month file, so even all of them are few."""
    return {r["batch_id"]: Digest(*(r[name] for name in DIGEST_FIELDS)) for r in batch_digests(trips).collect()}


def _among(batches: list[str | None]) -> Column:
    named = F.col("batch_id").isin([b for b in batches if b is not None])
    return named | F.col("batch_id").isNull() if None in batches else named


def recount(staged: DataFrame, clean: DataFrame) -> DataFrame:
    """Per batch: expected, actual, missing and extra row counts, from one count per fingerprint."""
    expected = clean_trips(staged).select("batch_id", "row_fingerprint", F.lit(1).alias("e"), F.lit(0).alias("a"))
    actual = clean.select("batch_id", "row_fingerprint", F.lit(0).alias("e"), F.lit(1).alias("a"))
    per_row = (
        expected.unionAll(actual)
        .groupBy("batch_id", "row_fingerprint")
        .agg(F.sum("e").alias("e"), F.sum("a").alias("a"))
    )
    return per_row.groupBy("batch_id").agg(
        F.sum("e").alias("expected"),
        F.sum("a").alias("actual"),
        F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("missing"),
        F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("extra"),
    )


def audit_batches(staged: DataFrame, clean: DataFrame, known: dict[str, Digest] | None = None) -> DataFrame:
    """Per batch: expected, actual, missing and extra row counts.

    Both sides are first reduced to one digest per batch; ``known`` are clean's digests where the
    manifests have them, and clean is then not read. Fingerprints are shuffled and counted for the
    batches whose digests differ, and for no others.
    """
    expected, actual = _digests(clean_trips(staged)), _digests(clean) if known is None else known
    batches = {*expected, *(b for b, d in actual.items() if d.rows)}
    none = Digest()
    differ = [b for b in batches if expected.get(b, none) != actual.get(b, none)]
    agree = [(b, expected[b].rows, expected[b].rows, 0, 0) for b in batches if b not in differ]
    found = staged.sparkSession.createDataFrame(agree, "batch_id string, expected bigint, actual bigint, missing bigint, extra bigint")
    return found.unionAll(recount(staged.where(_among(differ)), clean.where(_among(differ)))) if differ else found


def assert_in_sync(
    staged: DataFrame, clean: DataFrame, batches: list[str] | None = None, known: dict[str, Digest] | None = None
) -> None:
    """Raise unless the batches (all when not given) agree row for row."""
    if batches is not None:
        staged = staged.where(F.col("batch_id").isin(batches))
        clean = clean.where(F.col("batch_id").isin(batches))
        known = None if known is None else {b: d for b, d in known.items() if b in batches}
    wrong = audit_batches(staged, clean, known).where((F.col("missing") > 0) | (F.col("extra") > 0)).orderBy("batch_id")
    rows = wrong.collect()
    if rows:
        detail = "; ".join(
            f"{r['batch_id']}: expected={r['expected']} actual={r['actual']} missing={r['missing']} extra={r['extra']}"
            for r in rows
        )
        raise BatchMismatch(f"{LAYERS['clean'].relation} differs from its source in {len(rows)} batches: {detail}")
