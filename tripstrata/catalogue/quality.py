"""Quality operators: K01-K15, and S12, the run document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.catalogue.base import LOADED_AT, built_warehouse, clean, query, sql, staged
from tripstrata.functions.scalars import plain_number
from tripstrata.operators.audit import audit_batches
from tripstrata.operators.checks import (
    NOT_NULL,
    Policy,
    between,
    duplicate_keys,
    evaluate,
    fail_decision,
    in_set,
    not_null,
    null_counts,
    pair_not_below,
    read_runs,
    run_results,
    settled,
    suite_summary,
    suites,
    unexpected_sample,
    write_run,
)
from tripstrata.operators.staging import clean_trips, with_reason
from tripstrata.plans.builds import run_schema_tests
from tripstrata.rules import is_valid
from tripstrata.session import scratch_dir

_META = {"severity": "critical", "domain": "test", "rationale": "test"}


@query(
    "K01_not_null",
    sql("ev", " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS failures FROM ev_stg" for c in NOT_NULL["stg"]
    )),
)
def k01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_counts(staged(spark, sf_dir, "ev"), NOT_NULL["stg"])


@query(
    "K01_K02_schema_tests",
    sql("yr", " UNION ALL ".join(
        [f"SELECT 'stg' AS table_name, 'not_null' AS test, '{c}' AS column_name, count(*) - count({c}) AS failures FROM yr_stg" for c in NOT_NULL["stg"]]
        + [f"SELECT '{t}', 'not_null', '{c}', CAST(0 AS BIGINT)" for t, cs in NOT_NULL.items() if t != "stg" for c in cs]
        + ["SELECT 'daily_revenue', 'unique', 'trip_date', 0", "SELECT 'hourly_peak', 'unique', 'pickup_hour', 0",
           "SELECT 'daily_zone', 'unique', 'trip_date,pu_location_id', 0"]
    )),
)
def schema_tests_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_schema_tests(built_warehouse(spark, sf_dir))


@query(
    "K02_unique",
    sql("li", "SELECT vendor_id, count(*) AS n FROM li_stg WHERE vendor_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
)
def k02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(staged(spark, sf_dir, "li"), ["vendor_id"])


@query(
    "K02_compound_unique",
    sql("li", """SELECT pu_location_id, trip_date, count(*) AS n FROM (
          SELECT DISTINCT pu_location_id, CAST(pickup_ts AS DATE) AS trip_date, payment_type FROM li_clean)
        WHERE pu_location_id IS NOT NULL AND trip_date IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""),
)
def k02_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = clean(spark, sf_dir, "li")
    rows = trips.select("pu_location_id", F.to_date("pickup_ts").alias("trip_date"), "payment_type").distinct()
    return duplicate_keys(rows, ["pu_location_id", "trip_date"])


_RESULT = ("column_name", "element_count", "missing_count", "unexpected_count", "unexpected_percent", "unexpected_percent_total", "success")


def _expect_sql(source: str, column: str, missing: str, unexpected: str, mostly: float) -> str:
    """One expectation's result row, with the tolerance over non-missing rows."""
    return f"""SELECT '{column}' AS column_name, n AS element_count, m AS missing_count, u AS unexpected_count,
        CAST(u AS DOUBLE) / nullif(n - m, 0) * 100 AS unexpected_percent, CAST(u AS DOUBLE) / nullif(n, 0) * 100 AS unexpected_percent_total,
        coalesce(CAST(n - m - u AS DOUBLE) / nullif(n - m, 0) >= CAST({mostly} AS DOUBLE), true) AS success
      FROM (SELECT count(*) AS n, count(CASE WHEN {missing} THEN 1 END) AS m,
              count(CASE WHEN NOT ({missing}) AND ({unexpected}) THEN 1 END) AS u FROM {source})"""


@query(
    "K03_expect_not_null",
    sql("ev", " UNION ALL ".join(
        _expect_sql("ev_stg", c, "false", f"{c} IS NULL", 1.0) for c in ("pickup_ts", "dropoff_ts", "pu_location_id", "do_location_id")
    )),
)
def k03(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = tuple(not_null(c, **_META) for c in ("pickup_ts", "dropoff_ts", "pu_location_id", "do_location_id"))
    return evaluate(staged(spark, sf_dir, "ev"), wanted).select(*_RESULT)


@query(
    "K04_expect_between",
    sql("ev", " UNION ALL ".join([
        _expect_sql("ev_stg", "total_amount", "total_amount IS NULL", "total_amount < 0", 1.0),
        _expect_sql("ev_stg", "trip_distance", "trip_distance IS NULL", "trip_distance < 0", 1.0),
        _expect_sql("ev_stg", "rate_code_id", "rate_code_id IS NULL", "rate_code_id < 0 OR rate_code_id > 6", 0.9),
    ])),
)
def k04(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (
        between("total_amount", low=0.0, **_META),
        between("trip_distance", low=0.0, **_META),
        between("rate_code_id", low=0, high=6, mostly=0.9, **_META),
    )
    return evaluate(staged(spark, sf_dir, "ev"), wanted).select(*_RESULT)


_PAIR_MISSING = "dropoff_ts IS NULL OR pickup_ts IS NULL"


@query(
    "K05_expect_pair",
    sql("ev", " UNION ALL ".join(
        f"SELECT {mostly} AS mostly, * FROM ({_expect_sql('ev_stg', 'dropoff_ts,pickup_ts', _PAIR_MISSING, f'dropoff_ts {op} pickup_ts', mostly)})"
        .replace(f"{mostly} AS mostly", f"CAST({mostly} AS DOUBLE) AS mostly")
        for mostly, op in ((0.999, "<"), (0.95, "<"), (0.5, "<="))
    )),
)
def k05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerated at 0.95, not at 0.999; the strict form also counts zero durations."""
    wanted = (
        pair_not_below("dropoff_ts", "pickup_ts", mostly=0.999, **_META),
        pair_not_below("dropoff_ts", "pickup_ts", mostly=0.95, **_META),
        pair_not_below("dropoff_ts", "pickup_ts", mostly=0.5, or_equal=False, **_META),
    )
    return evaluate(staged(spark, sf_dir, "ev"), wanted).select("mostly", *_RESULT)


@query(
    "K06_expect_in_set",
    sql("ev", _expect_sql("ev_clean", "payment_type", "payment_type IS NULL", "payment_type NOT IN (1,2,3,4,5,6)", 0.95)),
)
def k06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(clean(spark, sf_dir, "ev"), (in_set("payment_type", (1, 2, 3, 4, 5, 6), mostly=0.95, **_META),)).select(*_RESULT)


_SUITE = (
    [(c, "false", f"{c} IS NULL", 1.0) for c in ("pickup_ts", "dropoff_ts", "pu_location_id", "do_location_id")]
    + [("total_amount", "total_amount IS NULL", "total_amount < 0", 1.0)]
    + [("dropoff_ts,pickup_ts", _PAIR_MISSING, "dropoff_ts < pickup_ts", 0.999)]
    + [("trip_distance", "trip_distance IS NULL", "trip_distance < 0", 1.0)]
    + [("passenger_count", "true", "false", 0.999)]
    + [("payment_type", "payment_type IS NULL", "payment_type NOT IN (1,2,3,4,5,6)", 0.95)]
)


@query("K07_tolerance", sql("ev", " UNION ALL ".join(_expect_sql("ev_stg", *e) for e in _SUITE)))
def k07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both suites over unfiltered rows, an all-NULL column among them."""
    return evaluate(staged(spark, sf_dir, "ev"), suites(Policy())).select(*_RESULT)


_SAMPLE = """SELECT {pos} AS position, '{col}' AS column_name, value, count(*) AS sample_count FROM (
    SELECT {val} AS value FROM ev_stg WHERE NOT ({missing}) AND ({bad}) ORDER BY value NULLS FIRST LIMIT 20) GROUP BY value"""


@query(
    "K08_unexpected_sample",
    sql("ev", " UNION ALL ".join(f"SELECT * FROM ({part})" for part in (
        _SAMPLE.format(pos=0, col="payment_type", val="CAST(payment_type AS VARCHAR)", missing="payment_type IS NULL", bad="payment_type NOT IN (1,2,3,4,5,6)"),
        _SAMPLE.format(pos=1, col="rate_code_id", val="CAST(rate_code_id AS VARCHAR)", missing="rate_code_id IS NULL", bad="rate_code_id > 4"),
        _SAMPLE.format(pos=2, col="dropoff_ts,pickup_ts", val="CAST(dropoff_ts AS VARCHAR) || ',' || CAST(pickup_ts AS VARCHAR)", missing=_PAIR_MISSING, bad="dropoff_ts < pickup_ts"),
    ))),
)
def k08(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (
        in_set("payment_type", (1, 2, 3, 4, 5, 6), **_META),
        between("rate_code_id", high=4, **_META),
        pair_not_below("dropoff_ts", "pickup_ts", **_META),
    )
    return unexpected_sample(staged(spark, sf_dir, "ev"), wanted)


@query(
    "K09_suite_metadata",
    sql("ev", """SELECT suite, severity, suite_version, domain, expectations, (SELECT count(*) FROM ev_clean) AS element_count FROM (VALUES
        ('clean_yellow_trips__critical__v2', 'critical', 'v2', 'integrity', CAST(4 AS BIGINT)),
        ('clean_yellow_trips__critical__v2', 'critical', 'v2', 'financial_validity', 1),
        ('clean_yellow_trips__critical__v2', 'critical', 'v2', 'temporal_integrity', 1),
        ('clean_yellow_trips__warning__v1', 'warning', 'v1', 'realism', 2),
        ('clean_yellow_trips__warning__v1', 'warning', 'v1', 'domain_monitoring', 1))
        AS v(suite, severity, suite_version, domain, expectations)"""),
)
def k09(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = Policy(critical_version="2")
    results = evaluate(clean(spark, sf_dir, "ev"), suites(policy), policy)
    return results.groupBy("suite", "severity", "suite_version", "domain").agg(
        F.count(F.lit(1)).alias("expectations"), F.max("element_count").alias("element_count")
    )


_ALL = " UNION ALL ".join(
    f"SELECT '{'critical' if i < 6 else 'warning'}' AS severity, * FROM ({_expect_sql('ev_stg', *e)})" for i, e in enumerate(_SUITE)
)


@query(
    "K11_suite_summary",
    sql("ev", f"""SELECT severity, count(*) AS evaluated_expectations, count(CASE WHEN NOT success THEN 1 END) AS failed_expectations,
        bool_and(success) AS success FROM ({_ALL}) GROUP BY 1"""),
)
def k11(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = evaluate(staged(spark, sf_dir, "ev"), suites(Policy()))
    return suite_summary(results).select("severity", "evaluated_expectations", "failed_expectations", "success")


@query(
    "K12_fail_policy",
    sql("ev", f"SELECT severity, severity = 'critical' AND NOT bool_and(success) AS blocks_run FROM ({_ALL}) GROUP BY 1"),
)
def k12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By default a failed critical suite blocks and a failed warning suite does not."""
    summary = suite_summary(evaluate(staged(spark, sf_dir, "ev"), suites(Policy())))
    return fail_decision(summary).select("severity", "blocks_run")


@query(
    "K14_batch_audit",
    sql("li", """SELECT batch_id, count(*) AS expected,
        CASE WHEN batch_id >= '2000-01' THEN 0 WHEN batch_id BETWEEN '1997-01' AND '1997-12' THEN 3 * count(*) ELSE count(*) END AS actual,
        CASE WHEN batch_id >= '2000-01' THEN count(*) ELSE 0 END AS missing,
        CASE WHEN batch_id BETWEEN '1997-01' AND '1997-12' THEN 2 * count(*) ELSE 0 END AS extra
        FROM li_clean GROUP BY 1"""),
)
def k14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean with some batches absent and others inserted three times."""
    trips = staged(spark, sf_dir, "li")
    built = clean_trips(trips).where(F.col("batch_id") < "2000-01")
    copies = F.when(F.col("batch_id").between("1997-01", "1997-12"), F.lit(3)).otherwise(F.lit(1))
    tripled = built.select("batch_id", "row_fingerprint", F.explode(F.sequence(F.lit(1), copies)))
    return audit_batches(trips, tripled)


@query(
    "K15_clean_quarantine_split",
    sql("ev", """SELECT coalesce(r.reason_code, 'none') AS reason_code, c.vendor_id IS NOT NULL AS in_clean,
          r.reason_code IS NOT NULL AS in_quarantine, count(*) AS n
        FROM ev_reason r LEFT JOIN ev_clean c ON r.vendor_id = c.vendor_id GROUP BY 1, 2, 3"""),
)
def k15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every staged row is in clean, in quarantine, or, for a speed reason only, in both."""
    rows = with_reason(staged(spark, sf_dir, "ev")).withColumn("in_clean", F.coalesce(is_valid(), F.lit(False)))
    return rows.groupBy(
        F.coalesce("reason_code", F.lit("none")).alias("reason_code"),
        "in_clean",
        F.col("reason_code").isNotNull().alias("in_quarantine"),
    ).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- the run document

_NUMBER = "regexp_replace(CAST({} AS VARCHAR), '(\\.0*|(\\.[0-9]*[1-9])0+)$', '\\2')"
_VALUES = {
    **{c: "CAST(NULL AS VARCHAR)" for c in ("pickup_ts", "dropoff_ts", "pu_location_id", "do_location_id")},
    "total_amount": "CAST(total_amount AS VARCHAR)",
    "dropoff_ts,pickup_ts": "CAST(dropoff_ts AS VARCHAR) || ',' || CAST(pickup_ts AS VARCHAR)",
    "trip_distance": "CAST(trip_distance AS VARCHAR)",
    "passenger_count": "''",
    "payment_type": "CAST(payment_type AS VARCHAR)",
}
# Expectation types and limits, in suite order.
_KINDS = (
    ["expect_column_values_to_not_be_null"] * 4
    + ["expect_column_values_to_be_between", "expect_column_pair_values_A_to_be_greater_than_B"]
    + ["expect_column_values_to_be_between"] * 2
    + ["expect_column_values_to_be_in_set"]
)
_LIMITS = {4: (0.0, None), 6: (0.0, None), 7: (0.0, 8.0)}


def _document_sql(position: int, column: str, missing: str, bad: str, mostly: float) -> str:
    low, high = _LIMITS.get(position, (None, None))
    number = lambda v: "CAST(NULL AS DOUBLE)" if v is None else f"CAST({v} AS DOUBLE)"
    written = _NUMBER.format("value") if column in ("total_amount", "trip_distance") else "value"
    severity = "critical" if position < 6 else "warning"
    return f"""SELECT {position} AS position, '{severity}' AS severity, 'clean_yellow_trips__{severity}__v1' AS suite,
        '{_KINDS[position]}' AS expectation_type, {number(low)} AS min_value, {number(high)} AS max_value, CAST({mostly} AS DOUBLE) AS mostly,
        CAST(m AS DOUBLE) / nullif(n, 0) * 100 AS missing_percent, r.* EXCLUDE (m, n),
        coalesce((SELECT string_agg(coalesce(v, 'NULL') || ':' || k, ';' ORDER BY v NULLS FIRST) FROM (
          SELECT {written} AS v, count(*) AS k FROM (
            SELECT {_VALUES[column]} AS value FROM ev_stg WHERE NOT ({missing}) AND ({bad}) ORDER BY value NULLS FIRST LIMIT 20) GROUP BY value)), '') AS unexpected
      FROM (SELECT *, missing_count AS m, element_count AS n FROM ({_expect_sql("ev_stg", column, missing, bad, mostly)})) AS r"""


@query(
    "S12_write_quality_json",
    sql("ev", f"""SELECT *, (SELECT NOT bool_and(success) FROM ({_ALL}) WHERE severity = 'critical') AS blocked,
        severity = 'critical' AND NOT bool_and(success) OVER (PARTITION BY severity) AS blocks_run,
        CAST(count(*) OVER (PARTITION BY severity) AS BIGINT) AS evaluated_expectations,
        CAST(count(CASE WHEN NOT success THEN 1 END) OVER (PARTITION BY severity) AS BIGINT) AS failed_expectations
      FROM ({" UNION ALL ".join(_document_sql(i, *e) for i, e in enumerate(_SUITE))})"""),
)
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over unfiltered trips, written as a nested document and read back from the history: results, values and decision."""
    folder, policy, trips = scratch_dir(spark, "quality"), Policy(), staged(spark, sf_dir, "ev")
    write_run(trips, settled(evaluate(trips, suites(policy), policy)), folder, "staged trips", LOADED_AT, policy)
    amount = F.col("column_name").isin("total_amount", "trip_distance")
    written = F.transform("unexpected", lambda v: F.concat(F.coalesce(F.when(amount, plain_number(v.value)).otherwise(v.value), F.lit("NULL")), F.lit(":"), v.sample_count))
    kept = ("position", "severity", "suite", "expectation_type", "min_value", "max_value", "mostly", "missing_percent", *_RESULT)
    decision = ("blocked", "blocks_run", "evaluated_expectations", "failed_expectations")
    return run_results(read_runs(spark, folder)).select(*kept, F.array_join(written, ";").alias("unexpected"), *decision)
