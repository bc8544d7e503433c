"""Timing logs of the query workload, one CSV per run and phase."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.schemas import RUN_LOG, RUN_LOG_OLD
from tripstrata.storage.files import Files

PHASES = ("before", "after")
# The two generations of log names. A log is a file or a Spark folder of that name.
NAME = r"benchmarks_([^/]+)_(before|after)\.csv"
OLD_NAME = r"benchmarks_(before|after)_([^/]+)\.csv"


def log_name(run_id: str, phase: str) -> str:
    return f"benchmarks_{run_id}_{phase}.csv"


def run_id_of(path: Column) -> Column:
    """Run id in a log's path; the stamp for logs of the older kind; NULL for other names."""
    current = F.regexp_extract(path, NAME, 1)
    older = F.regexp_extract(path, OLD_NAME, 2)
    return F.coalesce(F.nullif(current, F.lit("")), F.nullif(older, F.lit("")))


def phase_of(path: Column) -> Column:
    current = F.regexp_extract(path, NAME, 2)
    older = F.regexp_extract(path, OLD_NAME, 1)
    return F.coalesce(F.nullif(current, F.lit("")), F.nullif(older, F.lit("")))


@dataclass(frozen=True)
class RunLog:
    """One log: its path and what its name says. ``run_id`` of the older kind is its stamp."""

    path: str
    run_id: str
    phase: str
    older: bool = False


def parse_log_name(path: str) -> RunLog | None:
    """What a log's name says; None for other names."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if found := re.fullmatch(NAME, name):
        return RunLog(path, found[1], found[2])
    if found := re.fullmatch(OLD_NAME, name):
        return RunLog(path, found[2], found[1], True)
    return None


def list_run_logs(spark: SparkSession, folder: str) -> list[RunLog]:
    """The logs of a folder, both generations, by run and phase."""
    found = [parse_log_name(path) for path in Files(spark).glob(f"{folder}/benchmarks_*.csv")]
    return sorted((log for log in found if log), key=lambda log: (log.run_id, log.phase, log.path))


def read_logs(spark: SparkSession, logs: Iterable[RunLog]) -> DataFrame:
    """The rows of the given logs in the current columns."""
    parts = []
    current = [log.path for log in logs if not log.older]
    if current:
        parts.append(spark.read.schema(RUN_LOG).option("header", True).csv(current))
    for log in logs:
        if log.older:
            parts.append(spark.read.schema(RUN_LOG_OLD).option("header", True).csv(log.path).withColumn("run_id", F.lit(log.run_id)))
    return reduce(DataFrame.unionByName, parts).select(*RUN_LOG.fieldNames())


def write_run_log(log: DataFrame, folder: str, run_id: str, phase: str) -> str:
    """Write one run's rows of one phase with a header; returns the path."""
    if phase not in PHASES:
        raise ValueError(f"phase must be one of {PHASES}: {phase!r}")
    path = f"{folder}/{log_name(run_id, phase)}"
    log.select(*RUN_LOG.fieldNames()).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_run_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All logs of a folder in the current columns, both generations."""
    files = Files(spark)
    current, older = [], []
    for phase in PHASES:
        current += files.glob(f"{folder}/benchmarks_*_{phase}.csv")
        older += files.glob(f"{folder}/benchmarks_{phase}_*.csv")
    parts = []
    if current:
        parts.append(spark.read.schema(RUN_LOG).option("header", True).csv(current))
    only_older = sorted(set(older) - set(current))
    if only_older:
        rows = spark.read.schema(RUN_LOG_OLD).option("header", True).csv(only_older)
        parts.append(rows.withColumn("run_id", run_id_of(F.col("_metadata.file_path"))))
    if not parts:
        raise FileNotFoundError(f"no timing logs in {folder}")
    return reduce(DataFrame.unionByName, parts).select(*RUN_LOG.fieldNames())
