"""Schema tests and tolerance-based expectation suites as single-pass aggregates."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripstrata.functions.scalars import text
from tripstrata.schemas import RUN_DOCUMENT, RUN_RESULT, RUN_SUITE
from tripstrata.storage.files import Files

SAMPLE_SIZE = 20
SAMPLE_MERGERS = 256

# Columns that must hold a value, and keys that must not repeat.
NOT_NULL = {
    "stg": ("pickup_ts", "dropoff_ts", "pu_location_id", "do_location_id", "total_amount", "trip_distance"),
    "daily_revenue": ("trip_date", "trips", "revenue"),
    "hourly_peak": ("pickup_hour", "hr", "trips"),
    "daily_zone": ("trip_date", "pu_location_id", "trips"),
}
UNIQUE = {
    "daily_revenue": (("trip_date",),),
    "hourly_peak": (("pickup_hour",),),
    "daily_zone": (("trip_date", "pu_location_id"),),
}


def null_counts(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """``(column_name, failures)`` for all columns from one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns])
    return counted.select(F.inline(rows))


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """Keys that occur more than once; rows with a NULL in the key are left out."""
    present = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return df.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def schema_tests(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per declared test with its failure count."""
    results = []
    for name, df in tables.items():
        label = [F.lit(name).alias("table_name")]
        nulls = null_counts(df, NOT_NULL[name])
        results.append(nulls.select(*label, F.lit("not_null").alias("test"), "column_name", "failures"))
        for keys in UNIQUE.get(name, ()):
            repeated = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("failures"))
            columns = F.lit(",".join(keys)).alias("column_name")
            results.append(repeated.select(*label, F.lit("unique").alias("test"), columns, "failures"))
    return reduce(DataFrame.unionByName, results)


@dataclass(frozen=True)
class Expectation:
    """A condition on one column or a column pair.

    ``missing`` is true for rows left out of the denominator (None: no such rows) and
    ``unexpected`` for rows that break the condition.
    """

    kind: str
    column: str
    severity: str
    domain: str
    rationale: str
    missing: str | None
    unexpected: str
    value: str
    min_value: float | None = None
    max_value: float | None = None
    value_set: tuple[int, ...] | None = None
    mostly: float = 1.0


# Expectation type names.
_NOT_NULL = "expect_column_values_to_not_be_null"
_BETWEEN = "expect_column_values_to_be_between"
_PAIR = "expect_column_pair_values_A_to_be_greater_than_B"
_IN_SET = "expect_column_values_to_be_in_set"


def not_null(column: str, **meta: str) -> Expectation:
    return Expectation(_NOT_NULL, column, missing=None, unexpected=f"{column} IS NULL", value=column, **meta)


def between(column: str, low: float | None = None, high: float | None = None, mostly: float = 1.0, **meta: str) -> Expectation:
    sides = [f"{column} < {low}"] if low is not None else []
    sides += [f"{column} > {high}"] if high is not None else []
    return Expectation(
        _BETWEEN, column, missing=f"{column} IS NULL", unexpected=" OR ".join(sides), value=column,
        min_value=low, max_value=high, mostly=mostly, **meta,
    )


def pair_not_below(a: str, b: str, mostly: float = 1.0, or_equal: bool = True, **meta: str) -> Expectation:
    return Expectation(
        _PAIR, f"{a},{b}", missing=f"{a} IS NULL OR {b} IS NULL", unexpected=f"{a} {'<' if or_equal else '<='} {b}",
        value=f"concat_ws(',', {a}, {b})", mostly=mostly, **meta,
    )


def in_set(column: str, values: tuple[int, ...], mostly: float = 1.0, **meta: str) -> Expectation:
    listed = ", ".join(str(v) for v in values)
    return Expectation(
        _IN_SET, column, missing=f"{column} IS NULL", unexpected=f"{column} NOT IN ({listed})", value=column,
        value_set=values, mostly=mostly, **meta,
    )


@dataclass(frozen=True)
class Policy:
    """Tolerances, suite versions and which suite's failure blocks a run."""

    mostly: float = 0.999
    payment_mostly: float = 0.95
    prefix: str = "clean_yellow_trips"
    critical_version: str = "v1"
    warning_version: str = "v1"
    fail_on_critical: bool = True
    fail_on_warning: bool = False

    def version(self, severity: str) -> str:
        written = (self.critical_version if severity == "critical" else self.warning_version).strip() or "v1"
        return written if written.startswith("v") else f"v{written}"

    def suite(self, severity: str) -> str:
        return f"{self.prefix}__{severity}__{self.version(severity)}"


def suites(policy: Policy) -> tuple[Expectation, ...]:
    """The six critical and three warning expectations on clean trips."""
    integrity = {"severity": "critical", "domain": "integrity"}
    realism = {"severity": "warning", "domain": "realism"}
    return (
        not_null("pickup_ts", rationale="Every mart and every folder is chosen by the pickup time.", **integrity),
        not_null("dropoff_ts", rationale="daily_zone averages the trip duration.", **integrity),
        not_null("pu_location_id", rationale="daily_zone has one row per day and pickup zone.", **integrity),
        not_null("do_location_id", rationale="The row fingerprint covers both zones.", **integrity),
        between("total_amount", low=0.0, severity="critical", domain="financial_validity",
                rationale="daily_revenue adds totals up; refunds belong to quarantine."),
        pair_not_below("dropoff_ts", "pickup_ts", mostly=policy.mostly, severity="critical", domain="temporal_integrity",
                       rationale="Speed and duration are computed from the two times; clean filters by the same rule."),
        between("trip_distance", low=0.0, rationale="daily_zone averages distances, and speeds divide by them.", **realism),
        between("passenger_count", low=0, high=8, mostly=policy.mostly,
                rationale="No mart uses the count, so a few odd ones only warn.", **realism),
        in_set("payment_type", (1, 2, 3, 4, 5, 6), mostly=policy.payment_mostly, severity="warning",
               domain="domain_monitoring", rationale="Clean lets code 0 through; this shows how much of it there is."),
    )


def _percent(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.nullif(whole, F.lit(0)).cast("double") * 100


_DESCRIPTION = (
    "position int, suite string, suite_version string, expectation_type string, severity string, domain string, "
    "rationale string, column_name string, min_value double, max_value double, value_set string, mostly double"
)


def _describe(expectations: tuple[Expectation, ...], policy: Policy) -> list[dict[str, object]]:
    """The columns of a result row that do not depend on the data."""
    return [
        {
            "position": position,
            "suite": policy.suite(e.severity),
            "suite_version": policy.version(e.severity),
            "expectation_type": e.kind,
            "severity": e.severity,
            "domain": e.domain,
            "rationale": e.rationale,
            "column_name": e.column,
            "min_value": e.min_value,
            "max_value": e.max_value,
            "value_set": ",".join(map(str, e.value_set)) if e.value_set else None,
            "mostly": e.mostly,
        }
        for position, e in enumerate(expectations)
    ]


def evaluate(df: DataFrame, expectations: tuple[Expectation, ...], policy: Policy = Policy()) -> DataFrame:
    """One row per expectation; all counters come from one aggregate over ``df``.

    The tolerance applies to non-missing values, and a column without any passes.
    """
    counters = [F.count(F.lit(1)).alias("n")]
    for i, e in enumerate(expectations):
        skip = F.expr(e.missing) if e.missing else F.lit(False)
        broken = ~skip & F.expr(e.unexpected)
        counters += [F.count_if(skip).alias(f"m{i}"), F.count_if(broken).alias(f"u{i}")]
    described = F.from_json(F.lit(json.dumps(_describe(expectations, policy))), f"array<struct<{_DESCRIPTION}>>")
    numbers = range(len(expectations))
    own = F.col("position") + 1
    present = F.col("element_count") - F.col("missing_count")
    kept = (present - F.col("unexpected_count")).cast("double") / F.nullif(present, F.lit(0)).cast("double")
    return (
        df.agg(*counters)
        .select(
            F.inline(described),
            F.col("n").alias("element_count"),
            F.array(*[f"m{i}" for i in numbers]).alias("_missing"),
            F.array(*[f"u{i}" for i in numbers]).alias("_unexpected"),
        )
        .withColumn("missing_count", F.element_at("_missing", own))
        .withColumn("unexpected_count", F.element_at("_unexpected", own))
        .drop("_missing", "_unexpected")
        .withColumn("missing_percent", _percent(F.col("missing_count"), F.col("element_count")))
        .withColumn("unexpected_percent", _percent(F.col("unexpected_count"), present))
        .withColumn("unexpected_percent_total", _percent(F.col("unexpected_count"), F.col("element_count")))
        .withColumn("success", F.coalesce(kept >= F.col("mostly"), F.lit(True)))
    )


def _least(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """The ``size`` smallest values of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first()))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")


def unexpected_sample(df: DataFrame, expectations: tuple[Expectation, ...], size: int = SAMPLE_SIZE) -> DataFrame:
    """Up to ``size`` unexpected values per expectation, counted within that sample.

    The smallest values are taken, so the sample does not depend on how the data is
    split. Every task keeps ``size`` rows per expectation (WindowGroupLimit), and so does
    each of ``SAMPLE_MERGERS`` tasks they are first sent to, so the last merge sees at most
    ``size`` rows from each of these, whatever the number of tasks and of bad rows.
    """
    found = [
        F.when(
            F.coalesce(F.expr(e.unexpected), F.lit(False)) & (~F.expr(e.missing) if e.missing else F.lit(True)),
            F.struct(F.lit(i).alias("position"), F.lit(e.column).alias("column_name"), text(F.expr(e.value)).alias("value")),
        )
        for i, e in enumerate(expectations)
    ]
    listed = df.select(F.inline(F.array_compact(F.array(*found))), (F.spark_partition_id() % SAMPLE_MERGERS).alias("_merger"))
    return (
        _least(_least(listed, size, "position", "_merger"), size, "position")
        .groupBy("position", "column_name", "value")
        .agg(F.count(F.lit(1)).alias("sample_count"))
    )


def suite_summary(results: DataFrame) -> DataFrame:
    """Evaluated and failed expectations per suite. Anything but a plain success counts as failed."""
    failed = F.count_if(~F.coalesce(F.col("success"), F.lit(False)))
    return results.groupBy("severity", "suite", "suite_version").agg(
        F.count(F.lit(1)).alias("evaluated_expectations"),
        failed.alias("failed_expectations"),
        (failed == 0).alias("success"),
    )


def fail_decision(summary: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Per suite, whether its failure blocks the run."""
    blocks = F.when(F.col("severity") == "critical", F.lit(policy.fail_on_critical)).otherwise(F.lit(policy.fail_on_warning))
    return summary.withColumn("blocks_run", blocks & ~F.col("success"))


class QualityError(RuntimeError):
    """A suite failed that the policy does not let pass."""


def enforce(summary: DataFrame, policy: Policy = Policy()) -> None:
    rows = fail_decision(summary, policy).collect()
    missing = {e.severity for e in suites(policy)} - {row["severity"] for row in rows}
    reasons = [f"{row['suite']}: {row['failed_expectations']} failed" for row in rows if row["blocks_run"]]
    reasons += [f"no result for the {severity} suite" for severity in sorted(missing)]
    if reasons:
        raise QualityError("; ".join(reasons))


def settled(results: DataFrame) -> DataFrame:
    """The result rows, worked out once: a handful, one per expectation."""
    return results.sparkSession.createDataFrame(results.collect(), results.schema)


def write_results(results: DataFrame, summary: DataFrame, folder: str) -> None:
    """Per-expectation rows, one JSON folder per suite, and the summary."""
    results.repartition("severity").write.mode("overwrite").partitionBy("severity").json(f"{folder}/results")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def run_document(results: DataFrame, unexpected: DataFrame, table: str, moment: datetime, policy: Policy = Policy()) -> DataFrame:
    """One quality run as one nested row: decision, suites, their results, and in each the values that broke it."""
    names = RUN_RESULT.fieldNames()[:-1]
    values = unexpected.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("value", "sample_count"))).alias("unexpected"))
    listed = F.coalesce("unexpected", F.array().cast(RUN_RESULT["unexpected"].dataType)).alias("unexpected")
    detail = results.join(values, "position", "left").select("severity", F.struct(*names, listed).alias("result"))
    nested = detail.groupBy("severity").agg(F.sort_array(F.collect_list("result")).alias("results"))
    suite = fail_decision(suite_summary(results), policy).join(nested, "severity")
    suites_of = F.sort_array(F.collect_list(F.struct(*RUN_SUITE.fieldNames())))
    return suite.groupBy().agg(
        F.lit(f"{moment:%Y-%m-%dT%H:%M:%S}").alias("run_time"),
        F.lit(table).alias("table_name"),
        F.lit(policy.fail_on_critical).alias("fail_on_critical"),
        F.lit(policy.fail_on_warning).alias("fail_on_warning"),
        F.bool_and("success").alias("success"),
        F.bool_or("blocks_run").alias("blocked"),
        suites_of.alias("suites"),
    )


def write_run(df: DataFrame, results: DataFrame, folder: str, table: str, moment: datetime, policy: Policy = Policy()) -> str:
    """One quality run as a nested JSON document below its own stamp.

    ``results`` are settled ones of ``df``, which is read again only where an expectation found
    unexpected values. The document is written aside and put in place by one rename, so a reader
    of the history sees whole runs only. Earlier runs stay. Returns the run's folder.
    """
    files = Files(df.sparkSession)
    path, draft = f"{folder}/run={moment:%Y%m%dT%H%M%S%f}", f"{folder}/.draft-{uuid.uuid4().hex}"
    if files.exists(path):
        raise FileExistsError(f"there is a run at {path}")
    broken = not results.where("unexpected_count > 0").isEmpty()
    found = unexpected_sample(df, suites(policy)) if broken else df.sparkSession.createDataFrame([], "position int, value string, sample_count bigint")
    run_document(results, found, table, moment, policy).coalesce(1).write.json(draft)
    files.move(draft, path)
    return path


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs of a report folder as one table, a row per run, with ``run`` its stamp."""
    return spark.read.schema(T.StructType([*RUN_DOCUMENT.fields, T.StructField("run", T.StringType())])).json(folder)


def run_results(runs: DataFrame) -> DataFrame:
    """The history as one row per run and expectation."""
    about = ["run", "run_time", "table_name", "blocked"]
    each = runs.select(*about, F.explode("suites").alias("s"))
    named = [F.col(f"s.{name}").alias("suite_success" if name == "success" else name) for name in RUN_SUITE.fieldNames()[:-1]]
    return each.select(*about, *named, F.explode("s.results").alias("r")).select("*", "r.*").drop("r")
