"""Summaries and comparisons of timing logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.functions.order_stats import median
from tripstrata.functions.scalars import improvement_pct, speedup
from tripstrata.sources.runlog import PHASES, RunLog, list_run_logs, parse_log_name, read_logs
from tripstrata.storage.files import Files

_GROUP = ["run_id", "phase", "query"]


def summarize(log: DataFrame) -> DataFrame:
    """Count, min, max, mean and median per run, phase and query."""
    elapsed = F.col("elapsed_ms")
    basic = log.groupBy(*_GROUP).agg(
        F.count(elapsed).alias("count"),
        F.min(elapsed).cast("double").alias("min"),
        F.max(elapsed).cast("double").alias("max"),
        (F.sum(elapsed).cast("double") / F.nullif(F.count(elapsed), F.lit(0))).alias("mean"),
    )
    return basic.join(median(log, _GROUP, "elapsed_ms", "median"), _GROUP, "left")


def complete_runs(log: DataFrame) -> DataFrame:
    """Runs with rows of both phases."""
    known = log.where(F.col("phase").isin(*PHASES))
    phases = known.groupBy("run_id").agg(F.collect_set("phase").alias("phases"))
    return phases.where(F.size("phases") == len(PHASES)).select("run_id")


def latest_complete_run(log: DataFrame) -> str:
    latest = complete_runs(log).agg(F.max("run_id")).first()[0]
    if latest is None:
        raise FileNotFoundError("no run has both a before and an after log")
    return latest


def resolve_runs(
    log: DataFrame, run_id: str = "", before_run: str = "", after_run: str = "", allow_mismatched: bool = False
) -> tuple[str, str]:
    """Which runs to compare: the named run, else the named pair, else the latest complete run."""
    run_id, before_run, after_run = run_id.strip(), before_run.strip(), after_run.strip()
    if run_id:
        if {before_run or run_id, after_run or run_id} != {run_id}:
            raise ValueError("the named before and after runs are not the requested run")
        pair = (run_id, run_id)
    elif before_run or after_run:
        if not (before_run and after_run):
            raise ValueError("name both the before and the after run")
        if before_run != after_run and not allow_mismatched:
            raise ValueError("before and after belong to different runs; allow this explicitly if it is meant")
        pair = (before_run, after_run)
    else:
        latest = latest_complete_run(log)
        pair = (latest, latest)
    for run, phase in zip(pair, PHASES):
        if log.where((F.col("run_id") == run) & (F.col("phase") == phase)).limit(1).isEmpty():
            raise FileNotFoundError(f"run {run} has no {phase} log")
    return pair


def resolve_files(
    spark: SparkSession, folder: str = "", run_id: str = "", before_file: str = "", after_file: str = "", allow_mismatched: bool = False
) -> tuple[RunLog, RunLog]:
    """The two logs to compare: those of a run of ``folder``, else two named files from anywhere, else the latest complete run's.

    With a run id, one or both files may be named instead of taken from ``folder``; their names
    must then agree with it. Names must say the right phase; without a common run, the caller has to
    allow the comparison.
    """
    files, run_id = Files(spark), run_id.strip()
    named = {"before": before_file.strip(), "after": after_file.strip()}
    if not run_id and any(named.values()) and not all(named.values()):
        raise ValueError("name both the before and the after file")
    if not run_id and not any(named.values()):
        listed = list_run_logs(spark, folder)
        complete = {log.run_id for log in listed if log.phase == PHASES[0]} & {log.run_id for log in listed if log.phase == PHASES[1]}
        if not complete:
            raise FileNotFoundError(f"no run in {folder} has both a before and an after log")
        run_id = max(complete)
    pair = []
    for phase in PHASES:
        path = named[phase]
        if not path:
            own = [log for log in list_run_logs(spark, folder) if (log.run_id, log.phase) == (run_id, phase)]
            if not own:
                raise FileNotFoundError(f"run {run_id} has no {phase} log in {folder}")
            # a run logged under both kinds of names counts once
            path = min(own, key=lambda log: log.older).path
        if not files.exists(path):
            raise FileNotFoundError(f"no {phase} log at {path}")
        log = parse_log_name(path)
        if log is None and not allow_mismatched:
            raise ValueError(f"the name of {path} says neither run nor phase")
        if log is not None and log.phase != phase:
            raise ValueError(f"{path} is no {phase} log")
        if run_id and (log is None or log.run_id != run_id):
            raise ValueError(f"{path} is not of run {run_id}")
        pair.append(log or RunLog(path, "", phase))
    before, after = pair
    if before.run_id != after.run_id and not allow_mismatched:
        raise ValueError("before and after belong to different runs; allow this explicitly if it is meant")
    return before, after


def compare_files(spark: SparkSession, **choice: object) -> DataFrame:
    """Before/after comparison of two logs; ``choice`` is what :func:`resolve_files` takes."""
    before, after = resolve_files(spark, **choice)
    sides = [median(read_logs(spark, [log]), ["query"], "elapsed_ms", f"{phase}_ms") for phase, log in zip(PHASES, (before, after), strict=True)]
    return compare(*sides)


def phase_medians(log: DataFrame, run_id: str, phase: str) -> DataFrame:
    rows = log.where((F.col("run_id") == run_id) & (F.col("phase") == phase))
    return median(rows, ["query"], "elapsed_ms", f"{phase}_ms")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Medians side by side; queries present on one side only are kept with NULLs."""
    both = before.join(after, "query", "full_outer")
    return both.select(
        "query",
        "before_ms",
        "after_ms",
        speedup(F.col("before_ms"), F.col("after_ms")).alias("speedup_x"),
        improvement_pct(F.col("before_ms"), F.col("after_ms")).alias("improvement_pct"),
    ).orderBy(F.col("speedup_x").desc_nulls_last(), "query")


def compare_runs(log: DataFrame, **choice: object) -> DataFrame:
    """Before/after comparison; ``choice`` is what :func:`resolve_runs` takes."""
    before_run, after_run = resolve_runs(log, **choice)
    return compare(phase_medians(log, before_run, "before"), phase_medians(log, after_run, "after"))
