"""Sources and sinks: S01-S13 (S09, the fixed sample, is covered by the tests; S12 is among the quality queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.catalogue.base import (
    LOADED_AT,
    doubles,
    exact_sum_sql,
    month_files,
    new_warehouse,
    query,
    raw,
    sql,
)
from tripstrata.operators.batches import load_batch, load_frame
from tripstrata.operators.staging import stage, with_reason
from tripstrata.schemas import RUN_LOG, SOURCE_TYPES
from tripstrata.session import scratch_dir
from tripstrata.sources.runlog import PHASES, log_name, read_run_logs, write_run_log
from tripstrata.sources.tables import event_trips, nation_zones, table
from tripstrata.sources.trips import conform, known_columns, read_by_schema, tag
from tripstrata.sources.zones import read_zones
from tripstrata.storage.warehouse import ALL


@query(
    "S01_read_month_files",
    sql("yr", f"""SELECT batch_id, count(*) AS trips, {exact_sum_sql('total_amount')} AS total_amount,
        CAST(sum(payment_type) AS BIGINT) AS codes FROM yr_raw GROUP BY 1"""),
)
def s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    (trips,) = read_by_schema(spark, month_files(spark, sf_dir, "yr"))
    return doubles(
        trips.groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("trips"),
            F.sum("Total_Amount").alias("total_amount"),
            F.sum("payment_type").alias("codes"),
        )
    )


@query(
    "S02_resolve_columns",
    sql("ev", """SELECT vendor_id AS vendorid, CAST(trip_distance AS DOUBLE) AS trip_distance,
        CAST(total_amount AS DOUBLE) AS total_amount, rate_code_id AS ratecodeid FROM ev_raw"""),
)
def s02(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = event_trips(spark, sf_dir)
    padded = trips.withColumnRenamed("Total_Amount", " TOTAL_Amount ").withColumn("not_known", F.lit(1))
    spelled = known_columns(padded)
    wanted = ("vendorid", "trip_distance", "total_amount", "ratecodeid")
    return doubles(padded.select(*[F.col(f"`{spelled[name]}`").alias(name) for name in wanted]))


_FILLED = {
    "vendorid": "vendor_id",
    "tpep_pickup_datetime": "pickup_ts",
    "tpep_dropoff_datetime": "dropoff_ts",
    "trip_distance": "trip_distance",
    "ratecodeid": "rate_code_id",
    "pulocationid": "pu_location_id",
    "dolocationid": "do_location_id",
    "payment_type": "payment_type",
    "tip_amount": "tip_amount",
    "total_amount": "total_amount",
}


@query(
    "S03_conform_schema",
    sql("ev", " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS column_name, count({_FILLED.get(name, 'NULL')}) AS filled, count(*) AS total FROM ev_raw"
        for i, name in enumerate(SOURCE_TYPES)
    )),
)
def s03(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conform(event_trips(spark, sf_dir))
    counted = rows.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in rows.columns])
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(c).alias("filled"), F.col("_all").alias("total"))
        for i, c in enumerate(rows.columns)
    ]
    return counted.select(F.inline(F.array(*entries)))


@query(
    "S03_exact_amounts",
    """SELECT event_id, CAST((event_id % 7 - 3) / 2500.0 AS DOUBLE) AS trip_distance,
         CAST(CAST((event_id % 5 - 2) AS DECIMAL(10,0)) * 0.001234 AS DOUBLE) AS total_amount,
         CAST(8 + (event_id % 3) * 0.02 AS DOUBLE) AS passenger_count,
         CASE WHEN event_id % 7 <= 3 THEN 'invalid_distance' WHEN event_id % 5 < 2 THEN 'invalid_total_amount' END AS reason_code
       FROM events""",
)
def s03_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles and decimals of four and more places around zero decide by their exact value."""
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id AS VendorID", "ts AS tpep_pickup_datetime", "ts + INTERVAL 60 SECONDS AS tpep_dropoff_datetime",
        "1 AS PULocationID", "2 AS DOLocationID", "CAST(event_id % 7 - 3 AS DOUBLE) / 2500 AS trip_distance",
        "CAST(event_id % 5 - 2 AS DECIMAL(10,0)) * 0.001234BD AS total_amount",
        "CAST(CAST(8 + (event_id % 3) * 0.02BD AS STRING) AS DOUBLE) AS passenger_count",
    )
    found = with_reason(stage(tag(conform(rows), F.lit("2024-01"), LOADED_AT)))
    return doubles(found.select(F.col("vendor_id").alias("event_id"), "trip_distance", "total_amount", "passenger_count", "reason_code"))


def _odd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as text and fractions, with words and halves among them."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS VendorID",
        """CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN concat(user_id, '.0') WHEN 2 THEN concat(user_id, '.5')
           WHEN 3 THEN '' WHEN 4 THEN concat(' ', user_id, ' ') ELSE cast(user_id AS STRING) END AS PULocationID""",
        "value AS RatecodeID",
        "CASE WHEN event_id % 4 = 0 THEN cast('NaN' AS DOUBLE) ELSE cast(user_id AS DOUBLE) END AS payment_type",
        "ts AS tpep_pickup_datetime",
    )


_ODD_PU = """CASE event_id % 6 WHEN 1 THEN user_id WHEN 4 THEN user_id WHEN 5 THEN user_id END"""
_ODD_RATE = "CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END"


@query(
    "S04_coerce_codes",
    f"""SELECT event_id AS vendorid, {_ODD_PU} AS pulocationid, {_ODD_RATE} AS ratecodeid,
        CASE WHEN event_id % 4 <> 0 THEN user_id END AS payment_type FROM events""",
)
def s04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(_odd_codes(spark, sf_dir)).select("vendorid", "pulocationid", "ratecodeid", "payment_type")


@query(
    "S05_empty_text_to_null",
    """SELECT user_id % 25 AS pulocationid, count(*) AS trips, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS flags
       FROM events GROUP BY 1""",
)
def s05(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(
        "user_id % 25 AS PULocationID", "CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS Store_And_Fwd_Flag"
    )
    return conform(rows).groupBy("pulocationid").agg(F.count(F.lit(1)).alias("trips"), F.count("store_and_fwd_flag").alias("flags"))


@query(
    "S06_tag_batch",
    """SELECT '2024-01' AS batch_id, count(*) AS trips, CAST(1 AS BIGINT) AS load_times, TIMESTAMP '2024-06-01' AS loaded_at
       FROM events""",
)
def s06(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tag(conform(event_trips(spark, sf_dir)), F.lit("2024-01"), LOADED_AT)
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_distinct("ingested_at").alias("load_times"),
        F.to_utc_timestamp(F.max("ingested_at"), F.current_timezone()).cast("timestamp_ntz").alias("loaded_at"),
    )


@query(
    "S07_zone_lookup_csv",
    """SELECT n_nationkey AS locationid, r_name AS borough, n_name AS zone,
         CASE WHEN n_nationkey % 2 = 0 THEN 'Zone ' || r_name END AS service_zone
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def s07(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "zones")
    zones = nation_zones(spark, sf_dir).selectExpr(
        "locationid AS LocationID", "borough AS ` Borough`", "zone AS `ZONE `",
        "CASE WHEN locationid % 2 = 0 THEN concat('Zone ', borough) END AS Service_Zone",
    )
    zones.write.mode("overwrite").option("header", True).csv(folder)
    return read_zones(spark, folder)


@query(
    "S08_append_batches",
    sql("yr", f"""SELECT batch_id, count(*) AS trips, {exact_sum_sql('total_amount')} AS total_amount
        FROM yr_raw GROUP BY 1"""),
)
def s08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches arrive in two writes; the second leaves the first one's folders alone."""
    warehouse = new_warehouse(spark, "append")
    rows = raw(spark, sf_dir, "yr")
    early, late = rows.where(F.col("batch_id") < "1998-01"), rows.where(F.col("batch_id") >= "1998-01")
    load_frame(warehouse, early, ALL)
    load_frame(warehouse, late, [r[0] for r in late.select("batch_id").distinct().collect()])
    return doubles(
        warehouse.read("raw").groupBy("batch_id").agg(F.count(F.lit(1)).alias("trips"), F.sum("total_amount").alias("total_amount"))
    )


@query(
    "S10_rejected_input",
    f"""SELECT event_id, '2024-01' AS batch_id, 'not a whole number: ' || concat_ws(', ',
          CASE WHEN value <> floor(value) THEN 'ratecodeid' END,
          CASE WHEN event_id % 6 IN (0, 2) THEN 'pulocationid' END) AS error_reason
        FROM events WHERE value <> floor(value) OR event_id % 6 IN (0, 2)""",
)
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded twice: the errors of the second load take the place of the first one's."""
    warehouse = new_warehouse(spark, "rejected")
    source = scratch_dir(spark, "odd-codes")
    _odd_codes(spark, sf_dir).write.mode("overwrite").parquet(source)
    for replace in (False, True):
        load_batch(warehouse, "2024-01", source, replace, moment=LOADED_AT)
    event_id = F.get_json_object("raw_payload", "$.VendorID").cast("bigint").alias("event_id")
    return warehouse.read("ingest_errors").select(event_id, "batch_id", "error_reason")


# ---------------------------------------------------------------- timing logs

LOG_RUNS = ("20240101_000000", "20240102_000000")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as timings: even users before, odd ones after; the second half of the month is a second run."""
    return table(spark, sf_dir, "events").selectExpr(
        f"CASE WHEN day(ts) <= 15 THEN '{LOG_RUNS[0]}' ELSE '{LOG_RUNS[1]}' END AS run_id",
        "CASE WHEN user_id % 2 = 0 THEN 'before' ELSE 'after' END AS phase",
        "event_type AS query",
        "CAST(event_id AS INT) AS iter",
        "CAST(value AS DECIMAL(18,3)) AS elapsed_ms",
    )


LOG_RUN_SQL = f"CASE WHEN day(ts) <= 15 THEN '{LOG_RUNS[0]}' ELSE '{LOG_RUNS[1]}' END"
LOG_SQL = f"""log AS (
  SELECT {LOG_RUN_SQL} AS run_id,
    CASE WHEN user_id % 2 = 0 THEN 'before' ELSE 'after' END AS phase, event_type AS query,
    CAST(event_id AS INTEGER) AS iter, CAST(CAST(value AS DECIMAL(18,3)) AS DOUBLE) AS elapsed_ms FROM events)"""


def write_event_logs(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_dir(spark, "logs")
    log = event_log(spark, sf_dir)
    for run in LOG_RUNS:
        for phase in PHASES:
            write_run_log(log.where((F.col("run_id") == run) & (F.col("phase") == phase)), folder, run, phase)
    return folder


@query("S11_write_run_log", f"WITH {LOG_SQL} SELECT run_id, phase, query, iter, elapsed_ms FROM log")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_event_logs(spark, sf_dir)
    paths = [f"{folder}/{log_name(run, phase)}" for run in LOG_RUNS for phase in PHASES]
    return doubles(spark.read.schema(RUN_LOG).option("header", True).csv(paths))


@query(
    "S13_read_run_logs",
    f"""WITH {LOG_SQL}, both_kinds AS (
          SELECT run_id, phase, query, iter, elapsed_ms FROM log
          UNION ALL SELECT 'old_' || run_id, phase, query, iter, elapsed_ms FROM log)
        SELECT run_id, phase, query, count(*) AS n, CAST(sum(CAST(elapsed_ms AS DECIMAL(18,3))) AS DOUBLE) AS total_ms
        FROM both_kinds GROUP BY 1, 2, 3""",
)
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_event_logs(spark, sf_dir)
    log = event_log(spark, sf_dir)
    for run in LOG_RUNS:
        for phase in PHASES:
            rows = log.where((F.col("run_id") == run) & (F.col("phase") == phase)).drop("run_id")
            rows.write.option("header", True).csv(f"{folder}/benchmarks_{phase}_old_{run}.csv")
    read = read_run_logs(spark, folder)
    return doubles(
        read.groupBy("run_id", "phase", "query").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_ms").alias("total_ms"))
    )


