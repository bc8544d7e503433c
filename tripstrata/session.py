"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tripstrata.storage.files import Files

# What the jobs rely on. Everything else is left to the cluster.
#  - timestamps without zone are used throughout; UTC only fixes ``ingested_at`` text
#  - AQE coalesces the small aggregate shuffles, splits hot join keys and splits
#    oversized slices of the rebalanced writes
#  - the advisory size is the size of a written table file before compression
#  - recording a Python call site for every column expression makes plans slow to build
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def shuffle_partitions_for(input_bytes: int, target_bytes: int = 256 << 20, cores: int = 8) -> int:
    """Initial shuffle width for one job over ``input_bytes``; AQE coalesces downwards from it."""
    return max(cores, -(-input_bytes // target_bytes))


def build_session(
    app: str = "tripstrata", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with ``BASE_CONF``; keyword settings use ``__`` for dots.

    Give ``input_bytes``, the size of what one job reads, for jobs that shuffle whole
    rows (building clean, the audit, row-level joins).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    width = {"spark.sql.shuffle.partitions": str(shuffle_partitions_for(input_bytes))} if input_bytes else {}
    for key, value in {**BASE_CONF, **width, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, wanted: Mapping[str, str]) -> Iterator[None]:
    """The session with these settings meanwhile."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_UNITS = {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def size_in_bytes(text: str) -> int:
    """A size as Spark's settings write it."""
    number, unit = re.fullmatch(r"\s*([0-9]+)\s*([kmgtp]?)i?b?\s*", text.lower()).groups()
    return int(number) << _UNITS[unit]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder, removed when the JVM ends.

    Without ``spark.checkpoint.dir`` it lies in the session's own warehouse, which every
    executor reaches as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{base.rstrip('/')}/tripstrata-{label}-{uuid.uuid4().hex}"
    Files(spark).make(path, delete_on_exit=True)
    return path
