"""From raw documents to training tokens: five operators in order, each on what the one before kept.

Defined cases: documents with a NULL or blank text go with the classifier; a NULL id is an id like
others, and NULL languages and sources are ones of their own; of rows with equal texts one
stays, also of equal rows; texts of any length are worked on whole; all columns of ``documents``,
whatever their names, come through as they are up to the last stage, which adds ``tokens`` and raises
a ValueError where that is a column already; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripstrata.llm import exact_dedup, minhash, mixing, pieces, quality
from tripstrata.llm.base import staged, table
from tripstrata.llm.catalogue import new_index

# of texts that are cut into pieces at a time; their ids take about as much again
BATCH_BYTES = 1 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.kept_rows(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of those with equal texts."""
    index = new_index(spark)
    kept = exact_dedup.new_rows(docs, index)
    index.close()  # the result reads what was staged
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, which decode to the text.

    Written here: left to whoever writes it, the session's Arrow batches of 10,000 rows would be held
    by the workers and the JVM.
    """
    return staged(pieces.encode(docs, pieces.Vocabulary.load()), "pieces", batch_bytes=BATCH_BYTES)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

# The classifier's perplexities and the segmentations are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
