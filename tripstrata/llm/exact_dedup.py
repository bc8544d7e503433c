"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text.
A batch is reduced to one candidate per digest (partial aggregation, so a text repeated
a million times costs each task one row), anti-joined with the index by sort-merge on the
bucket key, and appended. Only digests, ids and lengths are shuffled, never texts.

Defined cases: a NULL text counts as empty, and empty texts are equal to each other; a
NULL id is larger than every id; rows that repeat id and text are all marked as the row
that stays, while ``new_rows`` returns one of them; an empty input gives an empty result.
Other columns are carried by ``new_rows`` whatever their names are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm.base import SPACES, condensed, keep_one, staged

INDEX_SCHEMA = "digest binary, keep_id {id}, chars int, batch string"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), 256))


class DigestIndex:
    """All digests seen so far, with the id and length of the row that stands for each.

    ``path`` is a shared folder; opening an existing one continues it. ``buckets`` is
    fixed when the index is made and must be given again when it is opened elsewhere.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, id_type: str = "bigint"):
        self.spark, self.buckets = spark, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({INDEX_SCHEMA.format(id=id_type)}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the table's name; its files stay, and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, candidates: DataFrame, batch: str) -> None:
        """Add digests the index lacks, as those of ``batch``; one writer, so one new file, per bucket."""
        known = self.read().select("digest")
        fresh = candidates.hint("merge").join(known.hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", "keep_id", "chars", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .saveAsTable(self.name)
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, chars)`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), text_digest(text).alias("digest"), F.char_length(text).alias("chars")
    )


def candidates(facts: DataFrame) -> DataFrame:
    """The longest text, then the smallest id, of each digest, and how many rows share it."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    return (
        facts.groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("chars"), "group_size")
    )


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Append the batch to ``index``; return ``(id, digest, keep_id, group_size, kept)`` per row.

    ``keep_id`` is the index's row for the text, which may come from an earlier batch;
    ``group_size`` counts the rows of this batch. A batch that was appended before its result was
    safe is offered again under the same name: its own digests do not count as known.
    """
    batch = batch or uuid.uuid4().hex
    facts = staged(digests(docs, id_col, text_col), "digests")
    groups = staged(candidates(facts), "digest-groups")
    known_before = index.read().where(F.col("batch") != batch).select("digest", F.lit(True).alias("old"))
    old = staged(groups.select("digest").hint("merge").join(known_before.hint("merge"), "digest", "left_semi"), "digests-known")
    index.append(groups, batch)
    stays = staged(
        groups.select("digest", "group_size")
        .hint("merge")
        .join(index.read().select("digest", "keep_id").hint("merge"), "digest")
        .join(old.withColumn("old", F.lit(True)), "digest", "left"),
        "digest-stays",
    )
    # one row per digest against all rows: a join that Spark can split where a digest is frequent
    kept = F.col("old").isNull() & F.col("id").eqNullSafe(F.col("keep_id"))
    return facts.join(stays, "digest").select("id", "digest", "keep_id", "group_size", kept.alias("kept"))


def new_rows(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the index did not have; one per text."""
    marks = condensed(lambda: deduplicate(docs, index, id_col, text_col, batch).select("id", "digest", "kept"), "digest-marks")
    # rows with the winner's id and digest but another spacing are marked too: one of them stays
    return keep_one(docs, marks, {"id": F.col(id_col), "digest": text_digest(F.col(text_col))})
