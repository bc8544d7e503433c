"""Filters, joins, sorts and set operations: F, J, T and X."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.catalogue.base import (
    LOADED_AT,
    Q1_END,
    Q1_START,
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
from tripstrata.functions.temporal import BATCH_PATTERN
from tripstrata.operators.audit import missing_rows, surplus
from tripstrata.operators.batches import batch_list, changed_batches, has_batch, trips_of
from tripstrata.operators.layout import list_partitions, manifest_differences
from tripstrata.operators.staging import quarantined_trips, valid_trips, with_reason
from tripstrata.operators.windows import anchor_month, in_window
from tripstrata.operators.zoning import with_zone
from tripstrata.plans import workload as W
from tripstrata.rules import PAYMENT_TYPES, is_valid
from tripstrata.sources.tables import nation_zones, table
from tripstrata.storage.manifest import folder_values

# ---------------------------------------------------------------- filters


@query(
    "F01_valid_trips",
    sql("li", f"""SELECT batch_id, count(*) AS trips, {exact_sum_sql('total_amount')} AS revenue
        FROM li_clean GROUP BY 1"""),
)
def f01(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = valid_trips(staged(spark, sf_dir, "li"))
    return doubles(valid.groupBy("batch_id").agg(F.count(F.lit(1)).alias("trips"), F.sum("total_amount").alias("revenue")))


@query("F02_quarantined_trips", sql("ev", "SELECT vendor_id, reason_code FROM ev_reason WHERE reason_code IS NOT NULL"))
def f02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantined_trips(staged(spark, sf_dir, "ev")).select("vendor_id", "reason_code")


@query(
    "F03_half_open_window",
    sql("ev", """SELECT vendor_id, pickup_ts FROM ev_stg
        WHERE pickup_ts >= TIMESTAMP '2024-01-15' AND pickup_ts < TIMESTAMP '2024-01-16'"""),
)
def f03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_window(staged(spark, sf_dir, "ev"), Q1_START, Q1_END).select("vendor_id", "pickup_ts")


@query(
    "F04_domain_or_null",
    """SELECT CAST(event_id AS BIGINT) AS event_id FROM events
       WHERE CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 11 END IS NULL OR event_id % 11 IN (0,1,2,3,4,5,6)""",
)
def f04(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 11)
    rows = table(spark, sf_dir, "events").withColumn("code", code)
    return rows.where(F.col("code").isNull() | F.col("code").isin(*PAYMENT_TYPES)).select("event_id")


_BATCH_TEXT = """CASE event_id % 5 WHEN 0 THEN '2024-13' WHEN 1 THEN 'test' WHEN 2 THEN '2024-1'
    WHEN 3 THEN '2023-11' ELSE {month} END"""


def odd_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch ids of which some are no month at all."""
    text = _BATCH_TEXT.format(month="date_format(ts, 'yyyy-MM')")
    return table(spark, sf_dir, "events").selectExpr(f"{text} AS batch_id")


ODD_BATCH_SQL = _BATCH_TEXT.format(month="strftime(ts, '%Y-%m')")


@query(
    "F05_batch_pattern",
    f"""SELECT batch_id, count(*) AS n FROM (SELECT {ODD_BATCH_SQL} AS batch_id FROM events)
        WHERE regexp_matches(batch_id, '^[0-9]{{4}}-[0-9]{{2}}$') GROUP BY 1""",
)
def f05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = odd_batches(spark, sf_dir).where(F.col("batch_id").rlike(BATCH_PATTERN))
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F06_listed_batches",
    sql("li", "SELECT batch_id, count(*) AS n FROM li_stg WHERE batch_id IN ('1996-02', '1998-07', '2001-08') GROUP BY 1"),
)
def f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trips_of(staged(spark, sf_dir, "li"), batch_list(" 1996-02,1998-07 , ,2001-08"))
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F07_subquery_batches",
    sql("li", """SELECT batch_id, count(*) AS n FROM li_stg
        WHERE batch_id IN (SELECT strftime(o_orderdate, '%Y-%m') FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice > 350000)
        GROUP BY 1"""),
)
def f07(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%' AND o_totalprice > 350000")
    batches = urgent.selectExpr("date_format(o_orderdate, 'yyyy-MM') AS batch_id").distinct()
    rows = trips_of(staged(spark, sf_dir, "li"), batches)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F08_batch_exists",
    sql("li", """SELECT probe AS batch_id, EXISTS (SELECT 1 FROM li_raw r WHERE r.batch_id = probe) AS present
        FROM (VALUES ('1995-01'), ('1999-12'), ('2001-09'), ('none')) AS p(probe)"""),
)
def f08(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = raw(spark, sf_dir, "li")
    found = [(b, has_batch(trips, b)) for b in ("1995-01", "1999-12", "2001-09", "none")]
    return spark.createDataFrame(found, "batch_id string, present boolean")


# ---------------------------------------------------------------- joins


@query(
    "J01_trips_with_zone",
    sql("ev", "SELECT vendor_id, locationid, borough, zone FROM ev_clean JOIN zones ON locationid = pu_location_id", zones=True),
)
def j01(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = with_zone(clean(spark, sf_dir, "ev"), nation_zones(spark, sf_dir))
    return joined.select("vendor_id", "locationid", "borough", "zone")


def stale_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean as it was before the batches from 2000 on arrived and those of 1997 were reloaded."""
    older = F.lit(LOADED_AT) - F.make_dt_interval(F.lit(1))
    reloaded = F.col("batch_id").between("1997-01", "1997-12")
    trips = clean(spark, sf_dir, "li").where(F.col("batch_id") < "2000-01")
    return trips.withColumn("ingested_at", F.when(reloaded, older).otherwise(F.col("ingested_at")))


IS_CHANGED = "(batch_id >= '2000-01' OR batch_id BETWEEN '1997-01' AND '1997-12')"
_CHANGED = sql("li", f"SELECT DISTINCT batch_id FROM li_raw WHERE {IS_CHANGED}")


@query("J02_changed_batches_left_join", _CHANGED)
def j02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_batches(staged(spark, sf_dir, "li"), stale_clean(spark, sf_dir))


@query(
    "J03_semi_join_changed",
    sql("li", f"""SELECT batch_id, count(*) AS n FROM li_stg
        WHERE {IS_CHANGED} GROUP BY 1"""),
)
def j03(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = staged(spark, sf_dir, "li")
    changed = changed_batches(trips, stale_clean(spark, sf_dir))
    return trips_of(trips, changed).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J05_scalar_subqueries",
    sql("li", """SELECT (SELECT max(CAST(batch_id || '-01' AS TIMESTAMP)) FROM li_raw) AS anchor,
        (SELECT count(*) FROM li_raw) AS raw_rows, (SELECT count(*) FROM li_clean) AS clean_rows,
        (SELECT count(*) FROM li_reason WHERE reason_code IS NOT NULL) AS quarantine_rows,
        (SELECT count(DISTINCT batch_id) FROM li_raw) AS batches"""),
)
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = staged(spark, sf_dir, "li")
    counted = with_reason(trips).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(is_valid()).alias("clean_rows"),
        F.count("reason_code").alias("quarantine_rows"),
        F.count_distinct("batch_id").alias("batches"),
    )
    anchor = F.lit(anchor_month(trips).first()[0]).cast("timestamp_ntz")
    return counted.select(anchor.alias("anchor"), "raw_rows", "clean_rows", "quarantine_rows", "batches")


@query(
    "J06_partition_inventory",
    sql("yr", """SELECT CASE WHEN month_key BETWEEN '199501' AND '200102' THEN month_key ELSE 'default' END AS pickup_month,
        CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS files_missed, CAST(0 AS BIGINT) AS bytes_missed FROM yr_clean GROUP BY 1"""),
)
def j06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, files and bytes per month from the manifests, the latter two as differences from what the file system lists."""
    warehouse = built_warehouse(spark, sf_dir)
    if not manifest_differences(warehouse).isEmpty():
        raise RuntimeError("a file differs from its manifest")
    stored = [(folder_values(folder)[1], size) for folder, _, size in warehouse.listed("clean")]
    listed = spark.createDataFrame(stored, "pickup_month string, size bigint").groupBy("pickup_month").agg(
        F.count(F.lit(1)).alias("listed"), F.sum("size").alias("size")
    )
    both = list_partitions(warehouse).join(listed, "pickup_month", "full_outer")
    return both.select("pickup_month", "rows", (F.col("files") - F.col("listed")).alias("files_missed"), (F.col("bytes") - F.col("size")).alias("bytes_missed"))


# ---------------------------------------------------------------- sorts and top lists


@query(
    "T01_order_by_count",
    sql("li", f"""SELECT payment_type, trips, avg_tip, row_number() OVER (ORDER BY trips DESC, payment_type) AS place FROM (
        SELECT payment_type, count(*) AS trips, {exact_avg_sql('tip_amount')} AS avg_tip FROM li_clean GROUP BY 1)"""),
)
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_place(W.payment_stats(clean(spark, sf_dir, "li")), F.desc("trips"), "payment_type")


@query(
    "T02_order_by_key",
    sql("li", f"""SELECT trip_date, trips, revenue, row_number() OVER (ORDER BY trip_date) AS place FROM (
        SELECT CAST(pickup_ts AS DATE) AS trip_date, count(*) AS trips, {exact_sum_sql('total_amount')} AS revenue
        FROM li_clean GROUP BY 1)"""),
)
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(with_place(W.revenue_by_day(clean(spark, sf_dir, "li")), "trip_date"))


@query(
    "T03_top_20",
    sql("li", """SELECT pu_location_id, count(*) AS trips FROM li_clean
        GROUP BY 1 ORDER BY trips DESC, pu_location_id LIMIT 20"""),
)
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_pickup_zones(clean(spark, sf_dir, "li"), datetime(1900, 1, 1), datetime(2100, 1, 1))


# ---------------------------------------------------------------- set operations


def _two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Zone pairs of staged and of clean trips: many repeats on both sides."""
    pair = ("pu_location_id", "do_location_id", "payment_type")
    return staged(spark, sf_dir, "li").select(*pair), clean(spark, sf_dir, "li").select(*pair)


_PAIR = "pu_location_id, do_location_id, payment_type"


@query(
    "X01_missing_multiset",
    sql("li", f"SELECT {_PAIR}, count(*) AS n FROM (SELECT {_PAIR} FROM li_stg EXCEPT ALL SELECT {_PAIR} FROM li_clean) GROUP BY ALL"),
)
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, actual = _two_sides(spark, sf_dir)
    return surplus(expected, actual)


_THRICE = " UNION ALL ".join([f"SELECT {_PAIR} FROM li_clean"] * 3)


@query(
    "X01_missing_rows",
    sql("li", "SELECT batch_id, vendor_id FROM li_stg EXCEPT ALL SELECT batch_id, vendor_id FROM li_clean"),
)
def x01_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each missing row itself: trips of orders that lost some of their lines."""
    keys = ("batch_id", "vendor_id")
    return missing_rows(staged(spark, sf_dir, "li").select(*keys), clean(spark, sf_dir, "li").select(*keys))


@query(
    "X02_extra_multiset",
    sql("li", f"SELECT {_PAIR}, count(*) AS n FROM (({_THRICE}) EXCEPT ALL SELECT {_PAIR} FROM li_stg) GROUP BY ALL"),
)
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean three times over against its source: batches inserted again without their delete."""
    expected, actual = _two_sides(spark, sf_dir)
    return surplus(actual.unionAll(actual).unionAll(actual), expected)
