"""Projections and scalar expressions: P01-P17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.catalogue.base import doubles, query, raw, sql, staged
from tripstrata.catalogue.relations import ODD_BATCH_SQL, odd_batches
from tripstrata.functions import temporal as TS
from tripstrata.functions.scalars import blank_to_null, improvement_pct, plain_number, row_fingerprint, speedup, text
from tripstrata.operators.staging import valid_trips, with_reason
from tripstrata.operators.windows import anchor_month
from tripstrata.sources.runlog import phase_of, run_id_of
from tripstrata.sources.tables import table


@query(
    "P01_stage_columns",
    sql("ev", """SELECT batch_id, vendor_id, pickup_ts, dropoff_ts, CAST(trip_distance AS DOUBLE) AS trip_distance, rate_code_id,
        pu_location_id, do_location_id, payment_type, CAST(tip_amount AS DOUBLE) AS tip_amount,
        CAST(total_amount AS DOUBLE) AS total_amount FROM ev_stg"""),
)
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(
        staged(spark, sf_dir, "ev").select(
            "batch_id", "vendor_id", "pickup_ts", "dropoff_ts", "trip_distance", "rate_code_id", "pu_location_id",
            "do_location_id", "payment_type", "tip_amount", "total_amount",
        )
    )


@query("P02_trip_duration", sql("ev", "SELECT vendor_id, trip_duration_sec FROM ev_stg"))
def p02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(staged(spark, sf_dir, "ev").select("vendor_id", "trip_duration_sec"))


@query("P03_average_speed", sql("ev", "SELECT vendor_id, avg_speed_kmh FROM ev_stg"))
def p03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "ev").select("vendor_id", "avg_speed_kmh")


@query("P04_row_fingerprint", sql("li", "SELECT row_fingerprint, count(*) AS n FROM li_clean GROUP BY 1"))
def p04(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = valid_trips(staged(spark, sf_dir, "li")).select(row_fingerprint().alias("row_fingerprint"))
    return marked.groupBy("row_fingerprint").agg(F.count(F.lit(1)).alias("n"))


def _counted(spark: SparkSession, sf_dir: str, name: str, value: Column, kind: str = "ev") -> DataFrame:
    return staged(spark, sf_dir, kind).groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))


@query("P05_to_date", sql("ev", "SELECT CAST(pickup_ts AS DATE) AS trip_date, count(*) AS n FROM ev_stg GROUP BY 1"))
def p05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "trip_date", TS.day_of("pickup_ts"))


@query("P06_truncate_hour", sql("ev", "SELECT CAST(date_trunc('hour', pickup_ts) AS TIMESTAMP) AS pickup_hour, count(*) AS n FROM ev_stg GROUP BY 1"))
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "pickup_hour", TS.hour_start("pickup_ts"))


@query("P07_truncate_month", sql("li", "SELECT CAST(date_trunc('month', pickup_ts) AS TIMESTAMP) AS month_start, count(*) AS n FROM li_stg GROUP BY 1"))
def p07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "month_start", TS.month_start("pickup_ts"), "li")


@query("P08_hour_of_day", sql("ev", "SELECT CAST(hour(pickup_ts) AS INTEGER) AS hr, count(*) AS n FROM ev_stg GROUP BY 1"))
def p08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "hr", F.hour("pickup_ts"))


@query(
    "P09_batch_month",
    f"""SELECT batch_id, CASE WHEN regexp_matches(batch_id, '^[0-9]{{4}}-[0-9]{{2}}$')
          THEN CAST(TRY_CAST(batch_id || '-01' AS DATE) AS TIMESTAMP) END AS first_day, count(*) AS n
        FROM (SELECT {ODD_BATCH_SQL} AS batch_id FROM events) GROUP BY 1, 2""",
)
def p09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odd_batches(spark, sf_dir)
    return rows.groupBy("batch_id", TS.batch_month("batch_id").alias("first_day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P10_month_arithmetic",
    sql("li", """SELECT batch_id, CAST(batch_id || '-01' AS TIMESTAMP) - INTERVAL 3 MONTH AS back_3,
        CAST(batch_id || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH AS next_1, count(*) AS n FROM li_raw GROUP BY 1"""),
)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = raw(spark, sf_dir, "li").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    month = TS.batch_month("batch_id")
    return counted.select("batch_id", TS.plus_months(month, -3).alias("back_3"), TS.plus_months(month, 1).alias("next_1"), "n")


@query("P11_month_key", sql("li", "SELECT strftime(pickup_ts, '%Y%m') AS month_key, count(*) AS n FROM li_stg GROUP BY 1"))
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir, "month_key", TS.month_key("pickup_ts"), "li")


@query("P12_reason_code", sql("ev", "SELECT vendor_id, coalesce(reason_code, 'none') AS reason_code FROM ev_reason"))
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_reason(staged(spark, sf_dir, "ev"))
    return rows.select("vendor_id", F.coalesce("reason_code", F.lit("none")).alias("reason_code"))


@query(
    "P13_blank_defaults",
    """SELECT coalesce(nullif(trim(CASE event_id % 3 WHEN 0 THEN '   ' WHEN 1 THEN ' ' || event_type || ' ' END), ''), 'fallback') AS name,
         count(*) AS n FROM events GROUP BY 1""",
)
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.expr("CASE event_id % 3 WHEN 0 THEN '   ' WHEN 1 THEN concat(' ', event_type, ' ') END")
    name = F.coalesce(blank_to_null(padded), F.lit("fallback")).alias("name")
    return table(spark, sf_dir, "events").groupBy(name).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P14_current_month_fallback",
    """SELECT coalesce(max(CASE WHEN regexp_matches(event_type, '^[0-9]{4}-[0-9]{2}$') THEN CAST(TRY_CAST(event_type || '-01' AS DATE) AS TIMESTAMP) END),
         CAST(date_trunc('month', current_date) AS TIMESTAMP)) AS anchor FROM events""",
)
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No event type is a month, so the anchor is this month."""
    return anchor_month(table(spark, sf_dir, "events").select(F.col("event_type").alias("batch_id")))


@query(
    "P15_speedup_ratios",
    """SELECT event_type, before_ms, after_ms, round_even(before_ms / after_ms * 100, 0) / 100 AS speedup_x,
         round_even((1.0 - after_ms / before_ms) * 100 * 10, 0) / 10 AS improvement_pct FROM (
         SELECT event_type, CAST(sum(CASE WHEN user_id % 2 = 0 THEN CAST(value AS DECIMAL(18,3)) END) AS DOUBLE) AS before_ms,
           CAST(sum(CASE WHEN user_id % 2 = 1 THEN CAST(value AS DECIMAL(18,3)) END) AS DOUBLE) AS after_ms
         FROM events GROUP BY 1)""",
)
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("value").cast("decimal(18,3)")
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.sum(F.when(F.col("user_id") % 2 == 0, amount)).cast("double").alias("before_ms"),
        F.sum(F.when(F.col("user_id") % 2 == 1, amount)).cast("double").alias("after_ms"),
    )
    before, after = F.col("before_ms"), F.col("after_ms")
    return sums.select("*", speedup(before, after).alias("speedup_x"), improvement_pct(before, after).alias("improvement_pct"))


@query(
    "P16_text_cast",
    sql("ev", """SELECT CAST(vendor_id AS VARCHAR) AS vendor_id, CAST(pickup_ts AS VARCHAR) AS pickup_ts,
        regexp_replace(CAST(total_amount AS VARCHAR), '\\.?0+$', '') AS total_amount FROM ev_stg"""),
)
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(spark, sf_dir, "ev")
    written = [text(F.col(c)).alias(c) for c in ("vendor_id", "pickup_ts")]
    # an amount has the digits of its source, not those of its type
    return rows.select(*written, plain_number(F.col("total_amount")).alias("total_amount"))


@query(
    "P17_parse_log_names",
    r"""SELECT nullif(regexp_extract(p, 'benchmarks_(run[0-9]+)_(before|after)\.csv', 1), '') AS run_id,
          nullif(regexp_extract(p, 'benchmarks_(run[0-9]+)_(before|after)\.csv', 2), '') AS phase, count(*) AS n
        FROM (SELECT '/logs/' || CASE event_type WHEN 'error' THEN 'other_' ELSE 'benchmarks_' END || 'run' || (user_id % 10) || '_' ||
                CASE event_type WHEN 'click' THEN 'before' WHEN 'view' THEN 'after' WHEN 'error' THEN 'after' ELSE 'during' END || '.csv' AS p
              FROM events) GROUP BY 1, 2""",
)
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("""concat('/logs/', CASE event_type WHEN 'error' THEN 'other_' ELSE 'benchmarks_' END, 'run', user_id % 10, '_',
        CASE event_type WHEN 'click' THEN 'before' WHEN 'view' THEN 'after' WHEN 'error' THEN 'after' ELSE 'during' END, '.csv')""")
    parsed = table(spark, sf_dir, "events").select(path.alias("p"))
    return parsed.groupBy(run_id_of(F.col("p")).alias("run_id"), phase_of(F.col("p")).alias("phase")).agg(F.count(F.lit(1)).alias("n"))
