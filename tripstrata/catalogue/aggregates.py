"""Aggregations and timing-log comparisons: A01-A13, J04, T04 and W10."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.catalogue.base import (
    LOADED_AT,
    built_warehouse,
    clean,
    doubles,
    exact_avg_sql,
    exact_sum_sql,
    query,
    raw,
    sql,
    staged,
    with_place,
)
from tripstrata.catalogue.sources import LOG_RUN_SQL, LOG_RUNS, LOG_SQL, event_log, write_event_logs
from tripstrata.functions.order_stats import median, percentile_nearest
from tripstrata.operators.batches import distinct_batches
from tripstrata.operators.marts import daily_revenue, daily_zone, hourly_peak
from tripstrata.operators.timings import compare, compare_files, compare_runs, complete_runs, phase_medians, summarize
from tripstrata.operators.windows import batch_month_bounds
from tripstrata.operators.zoning import zone_totals
from tripstrata.plans.builds import row_counts
from tripstrata.plans.workload import hourly_ranking_from_mart
from tripstrata.session import scratch_dir
from tripstrata.sources.runlog import log_name, read_run_logs
from tripstrata.sources.tables import nation_zones


@query("A01_count_by_key", sql("li", "SELECT pu_location_id, count(*) AS trips FROM li_clean GROUP BY 1"))
def a01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(spark, sf_dir, "li").groupBy("pu_location_id").agg(F.count(F.lit(1)).alias("trips"))


@query(
    "A02_sum_by_date",
    sql("li", f"""SELECT CAST(pickup_ts AS DATE) AS trip_date, count(*) AS trips, {exact_sum_sql('total_amount')} AS revenue
        FROM li_clean GROUP BY 1"""),
)
def a02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(daily_revenue(clean(spark, sf_dir, "li")))


@query(
    "A03_average_after_join",
    sql("li", f"""SELECT borough, zone, count(*) AS trips, {exact_avg_sql('total_amount')} AS avg_total
        FROM li_clean JOIN zones ON locationid = pu_location_id GROUP BY 1, 2""", zones=True),
)
def a03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_totals(clean(spark, sf_dir, "li"), nation_zones(spark, sf_dir))


DAILY_ZONE_SQL = f"""SELECT CAST(pickup_ts AS DATE) AS trip_date, pu_location_id, count(*) AS trips,
    {exact_avg_sql('total_amount')} AS avg_total_amount, {exact_avg_sql('tip_amount')} AS avg_tip_amount,
    {exact_avg_sql('trip_distance')} AS avg_distance, {exact_avg_sql('trip_duration_sec', 'DECIMAL(18,6)')} AS avg_duration_sec"""


@query("A04_averages_by_two_keys", sql("li", f"{DAILY_ZONE_SQL} FROM li_clean GROUP BY 1, 2"))
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_zone(clean(spark, sf_dir, "li"))


@query("A05_reaggregate_mart", sql("ev", "SELECT CAST(hour(pickup_ts) AS INTEGER) AS hr, count(*) AS trips FROM ev_clean GROUP BY 1"))
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_ranking_from_mart(hourly_peak(clean(spark, sf_dir, "ev")))


@query(
    "A06_latest_load_having",
    sql("li", "SELECT batch_id, count(*) AS n FROM li_raw WHERE CAST(substr(batch_id, 6, 2) AS INT) % 2 = 0 GROUP BY 1"),
)
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches loaded in June, with their size; those of odd months were loaded in May."""
    june = F.substring("batch_id", 6, 2).cast("int") % 2 == 0
    trips = raw(spark, sf_dir, "li").withColumn("ingested_at", F.when(june, F.lit(LOADED_AT)).otherwise(F.lit(LOADED_AT - timedelta(days=20))))
    loads = trips.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("ingested_at").alias("loaded_at"))
    return loads.where(F.col("loaded_at") > F.lit(LOADED_AT - timedelta(days=10))).select("batch_id", "n")


@query(
    "A07_batch_month_bounds",
    sql("li", """SELECT min(CAST(batch_id || '-01' AS TIMESTAMP)) AS first_month, max(CAST(batch_id || '-01' AS TIMESTAMP)) AS last_month
        FROM li_raw"""),
)
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_month_bounds(raw(spark, sf_dir, "li"))


@query("A08_distinct_batches", sql("li", "SELECT DISTINCT batch_id FROM li_raw ORDER BY 1"))
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_batches(staged(spark, sf_dir, "li"))


@query(
    "A09_row_counts",
    sql("yr", """SELECT 'raw.yellow_trips' AS relation, count(*) AS row_count FROM yr_raw
        UNION ALL SELECT 'stg.stg_yellow_trips', count(*) FROM yr_stg
        UNION ALL SELECT 'clean.clean_yellow_trips', count(*) FROM yr_clean
        UNION ALL SELECT 'quarantine.quarantine_yellow_trips', count(*) FROM yr_reason WHERE reason_code IS NOT NULL
        UNION ALL SELECT 'marts.marts_daily_revenue', count(DISTINCT CAST(pickup_ts AS DATE)) FROM yr_clean
        UNION ALL SELECT 'marts.marts_hourly_peak', count(DISTINCT date_trunc('hour', pickup_ts)) FROM yr_clean"""),
)
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_counts(built_warehouse(spark, sf_dir))


# ---------------------------------------------------------------- timing logs

_RANKED = """ranked AS (
  SELECT run_id, phase, query, elapsed_ms, row_number() OVER (PARTITION BY run_id, phase, query ORDER BY elapsed_ms) - 1 AS pos,
    count(*) OVER (PARTITION BY run_id, phase, query) AS n FROM log)"""
_MEDIANS = """medians AS (
  SELECT run_id, phase, query, sum(CASE WHEN pos = (n - 1) // 2 THEN elapsed_ms ELSE 0 END
      + CASE WHEN pos = n // 2 THEN elapsed_ms ELSE 0 END) / 2 AS median
  FROM ranked GROUP BY 1, 2, 3)"""


@query(
    "A10_timing_summary",
    f"""WITH {LOG_SQL}, {_RANKED}, {_MEDIANS}
        SELECT run_id, phase, query, count(*) AS count, min(elapsed_ms) AS min, max(elapsed_ms) AS max,
          CAST(sum(CAST(elapsed_ms AS DECIMAL(18,3))) AS DOUBLE) / count(*) AS mean, any_value(median) AS median
        FROM log JOIN medians USING (run_id, phase, query) GROUP BY 1, 2, 3""",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(event_log(spark, sf_dir))


@query(
    "A11_nearest_rank_p95",
    f"""WITH {LOG_SQL}, {_RANKED}
        SELECT run_id, phase, query, elapsed_ms AS p95 FROM ranked WHERE pos = CAST(round_even((n - 1) * CAST(0.95 AS DOUBLE), 0) AS BIGINT)""",
)
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentile_nearest(event_log(spark, sf_dir), ["run_id", "phase", "query"], "elapsed_ms", 0.95, "p95")


@query("A12_exact_median", f"WITH {LOG_SQL}, {_RANKED}, {_MEDIANS} SELECT run_id, phase, query, median AS median_ms FROM medians")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return median(event_log(spark, sf_dir), ["run_id", "phase", "query"], "elapsed_ms", "median_ms")


@query(
    "A13_complete_runs",
    f"""WITH {LOG_SQL}, cut AS (
          SELECT CASE WHEN phase = 'before' AND iter % 3 = 0 THEN '20240103_000000' ELSE run_id END AS run_id, phase FROM log)
        SELECT run_id, run_id = max(run_id) OVER () AS is_latest FROM (
          SELECT run_id FROM cut GROUP BY 1 HAVING count(DISTINCT phase) = 2)""",
)
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest run has one phase only."""
    broken_off = (F.col("phase") == "before") & (F.col("iter") % 3 == 0)
    log = event_log(spark, sf_dir).withColumn("run_id", F.when(broken_off, "20240103_000000").otherwise(F.col("run_id")))
    complete = complete_runs(log)
    latest = complete.agg(F.max("run_id").alias("_latest"))
    marked = complete.join(latest, complete.run_id == latest._latest, "left")
    return marked.select("run_id", F.col("_latest").isNotNull().alias("is_latest"))


def _comparison(before_run: str, after_run: str, before_where: str = "true", after_where: str = "true") -> str:
    return f"""WITH {LOG_SQL}, {_RANKED}, {_MEDIANS},
        b AS (SELECT query, median AS before_ms FROM medians WHERE run_id = {before_run} AND phase = 'before' AND {before_where}),
        a AS (SELECT query, median AS after_ms FROM medians WHERE run_id = {after_run} AND phase = 'after' AND {after_where})
        SELECT query, before_ms, after_ms, round_even(before_ms / after_ms * 100, 0) / 100 AS speedup_x,
          round_even((1.0 - after_ms / before_ms) * 100 * 10, 0) / 10 AS improvement_pct FROM b FULL OUTER JOIN a USING (query)"""


@query(
    "J04_full_outer_medians",
    _comparison("'20240101_000000'", "'20240101_000000'", "query <> 'click'", "query <> 'view'").replace(LOG_RUN_SQL, "'20240101_000000'"),
)
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query is timed only before, another only after; both runs as one."""
    run = "20240101_000000"
    log = event_log(spark, sf_dir).withColumn("run_id", F.lit(run))
    before = phase_medians(log.where("query <> 'click'"), run, "before")
    return compare(before, phase_medians(log.where("query <> 'view'"), run, "after"))


@query(
    "T04_sort_by_speedup",
    f"SELECT *, row_number() OVER (ORDER BY speedup_x DESC NULLS LAST, query) AS place FROM ({_comparison('(SELECT max(run_id) FROM log)', '(SELECT max(run_id) FROM log)')})",
)
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_place(compare_runs(event_log(spark, sf_dir)), F.col("speedup_x").desc_nulls_last(), "query")


@query("W10_compare_latest_run", _comparison("(SELECT max(run_id) FROM log)", "(SELECT max(run_id) FROM log)"))
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written as CSV, read back, latest complete run compared."""
    return compare_runs(read_run_logs(spark, write_event_logs(spark, sf_dir)))


@query("W10_compare_named_files", _comparison("'20240101_000000'", "'20240102_000000'"))
def w10_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of the older kind in one folder against one of the current kind in another."""
    folder, elsewhere = write_event_logs(spark, sf_dir), scratch_dir(spark, "logs-older")
    old = event_log(spark, sf_dir).where(f"run_id = '{LOG_RUNS[0]}' AND phase = 'before'").drop("run_id")
    before = f"{elsewhere}/benchmarks_before_{LOG_RUNS[0]}.csv"
    old.write.option("header", True).csv(before)
    return compare_files(spark, before_file=before, after_file=f"{folder}/{log_name(LOG_RUNS[1], 'after')}", allow_mismatched=True)


@query("W10_compare_named_pair", _comparison("'20240101_000000'", "'20240102_000000'"))
def w10_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return compare_runs(log, before_run="20240101_000000", after_run="20240102_000000", allow_mismatched=True)
