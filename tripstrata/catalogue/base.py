"""Registration, the trips the queries run on, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripstrata.operators.batches import load_source
from tripstrata.operators.staging import clean_trips, stage
from tripstrata.plans.builds import build_clean, build_marts, build_quarantine
from tripstrata.session import scratch_dir, settings
from tripstrata.sources.tables import event_trips, line_trips, line_trips_yearly, nation_zones
from tripstrata.sources.trips import raw_from_batched
from tripstrata.sources.zones import load_zones
from tripstrata.storage.files import Files
from tripstrata.storage.warehouse import ALL, CODEC, Warehouse, side_by_side

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# One load time, so that results do not depend on when a query runs.
LOADED_AT = datetime(2024, 6, 1, tzinfo=timezone.utc)

Q1_START, Q1_END = datetime(2024, 1, 15), datetime(2024, 1, 16)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# ---------------------------------------------------------------- trips

SOURCES = {"ev": event_trips, "li": line_trips, "yr": line_trips_yearly}


def raw(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return raw_from_batched(SOURCES[kind](spark, sf_dir), LOADED_AT)


def staged(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return stage(raw(spark, sf_dir, kind))


def clean(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return clean_trips(staged(spark, sf_dir, kind))


def new_warehouse(spark: SparkSession, label: str) -> Warehouse:
    return Warehouse(spark, scratch_dir(spark, label))


_built: dict[tuple, Warehouse] = {}
READ_TABLES = ("events", "lineitem", "orders", "nation", "region")


def built_warehouse(spark: SparkSession, sf_dir: str, kind: str = "yr") -> Warehouse:
    """A warehouse with all layers of one mapping, shared by the queries that only read it while the input files stay the same."""
    seen = tuple(Files(spark).stamp(f"{sf_dir}/{name}.parquet") for name in READ_TABLES)
    key = (spark.sparkContext.applicationId, sf_dir, kind, seen)
    if key not in _built:
        warehouse = new_warehouse(spark, f"built-{kind}")
        load_zones(warehouse, nation_zones(spark, sf_dir))
        load_source(warehouse, SOURCES[kind](spark, sf_dir), LOADED_AT, ALL)
        build_clean(warehouse)
        build_quarantine(warehouse)
        build_marts(warehouse, full=True)
        _built[key] = warehouse
    return _built[key]


def month_files(spark: SparkSession, sf_dir: str, kind: str) -> dict[str, str]:
    """Source-shaped trip files, one folder per batch, written by one job."""
    root = scratch_dir(spark, f"files-{kind}")
    with settings(spark, side_by_side()):
        SOURCES[kind](spark, sf_dir).write.mode("overwrite").options(**CODEC).partitionBy("batch_id").parquet(root)
    names = Files(spark).folders(root)
    return {name.split("=", 1)[1]: f"{root}/{name}" for name in names}


def source_rows(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The mapping's trips, joined once and written, for queries that load all of them again."""
    root = f"{scratch_dir(spark, f'rows-{kind}')}/rows"
    rows = SOURCES[kind](spark, sf_dir)
    rows.write.options(**CODEC).parquet(root)
    return spark.read.schema(rows.schema).parquet(root)


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the one number type both engines hand over alike."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c).cast("double").alias(c) if kinds[c].startswith("decimal") else F.col(c) for c in df.columns])


def with_place(report: DataFrame, *order: Column | str) -> DataFrame:
    """Position in a report of a few aggregated rows."""
    return report.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


# ---------------------------------------------------------------- SQL
# Reasons, their order, code sets and fingerprint columns are those of ``rules``
# and ``scalars``, written again so that a fault there shows.

_EV_RAW = """
ev_raw AS (
  SELECT strftime(ts, '%Y-%m') AS batch_id, event_id AS vendor_id, ts AS pickup_ts,
    CASE WHEN event_id % 101 = 0 THEN NULL
         WHEN event_id % 89 = 0 THEN ts - INTERVAL 60 SECOND
         ELSE ts + to_seconds(CAST(floor(value * 10) AS BIGINT)) END AS dropoff_ts,
    CASE WHEN event_id % 103 <> 0 THEN user_id % 25 END AS pu_location_id,
    (user_id * 7) % 25 AS do_location_id,
    CAST((event_id % 97) / 4.0 AS DECIMAL(18,2)) AS trip_distance,
    CAST(CAST(value AS DECIMAL(18,2)) - 1 AS DECIMAL(18,2)) AS total_amount,
    CAST((event_id % 13) / 4.0 AS DECIMAL(18,2)) AS tip_amount,
    CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 0
         WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 9 ELSE 4 END END AS BIGINT) AS payment_type,
    CASE WHEN event_id % 53 = 0 THEN 7 ELSE 1 + event_id % 6 END AS rate_code_id
  FROM events)"""

_LINE_RAW = """
{kind}_raw AS (
  SELECT strftime(o_orderdate, '{batch}') AS batch_id, l_orderkey AS vendor_id, o_orderdate AS pickup_ts,
    l_shipdate AS dropoff_ts, l_suppkey % 25 AS pu_location_id, l_partkey % 25 AS do_location_id,
    CAST(l_discount * 100 AS DECIMAL(18,2)) AS trip_distance,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount,
    CAST(l_quantity AS DECIMAL(18,2)) AS tip_amount,
    CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS payment_type,
    CAST(1 + l_linenumber AS BIGINT) AS rate_code_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_LAYERS = """
{kind}_stg AS (
  SELECT *, date_diff('microsecond', pickup_ts, dropoff_ts) / 1e6 AS trip_duration_sec,
    CASE WHEN dropoff_ts > pickup_ts
         THEN CAST(trip_distance AS DOUBLE) / ((date_diff('microsecond', pickup_ts, dropoff_ts) / 1e6) / 3600.0)
         END AS avg_speed_kmh
  FROM {kind}_raw),
{kind}_clean AS (
  SELECT *, strftime(pickup_ts, '%Y%m') AS month_key,
    md5(coalesce(CAST(vendor_id AS VARCHAR), '') || '|' || coalesce(CAST(pickup_ts AS VARCHAR), '') || '|' ||
        coalesce(CAST(dropoff_ts AS VARCHAR), '') || '|' || coalesce(CAST(pu_location_id AS VARCHAR), '') || '|' ||
        coalesce(CAST(do_location_id AS VARCHAR), '') || '|' || coalesce(regexp_replace(CAST(trip_distance AS VARCHAR), '\\.?0+$', ''), '') || '|' ||
        coalesce(regexp_replace(CAST(total_amount AS VARCHAR), '\\.?0+$', ''), '')) AS row_fingerprint
  FROM {kind}_stg
  WHERE pickup_ts IS NOT NULL AND dropoff_ts IS NOT NULL AND dropoff_ts >= pickup_ts
    AND pu_location_id IS NOT NULL AND do_location_id IS NOT NULL
    AND trip_distance > 0 AND total_amount >= 0
    AND (payment_type IS NULL OR payment_type BETWEEN 0 AND 6)
    AND (rate_code_id IS NULL OR rate_code_id BETWEEN 1 AND 6 OR rate_code_id = 99)),
{kind}_reason AS (
  SELECT *, CASE
    WHEN pickup_ts IS NULL OR dropoff_ts IS NULL THEN 'missing_datetime'
    WHEN dropoff_ts < pickup_ts THEN 'negative_duration'
    WHEN pu_location_id IS NULL OR do_location_id IS NULL THEN 'missing_location'
    WHEN trip_distance IS NULL OR trip_distance <= 0 THEN 'invalid_distance'
    WHEN total_amount IS NULL OR total_amount < 0 THEN 'invalid_total_amount'
    WHEN payment_type NOT BETWEEN 0 AND 6 THEN 'invalid_payment_type'
    WHEN NOT (rate_code_id BETWEEN 1 AND 6 OR rate_code_id = 99) THEN 'invalid_rate_code'
    WHEN avg_speed_kmh > 200 THEN 'unrealistic_speed' END AS reason_code
  FROM {kind}_stg)"""

_ZONES = """
zones AS (
  SELECT n_nationkey AS locationid, r_name AS borough, n_name AS zone
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

_RAW_SQL = {
    "ev": _EV_RAW,
    "li": _LINE_RAW.format(kind="li", batch="%Y-%m"),
    "yr": _LINE_RAW.format(kind="yr", batch="%Y-01"),
}


def sql(kind: str, body: str, zones: bool = False) -> str:
    """``body`` over ``<kind>_raw/_stg/_clean/_reason`` (and ``zones``)."""
    parts = [_RAW_SQL[kind], _LAYERS.format(kind=kind)] + ([_ZONES] if zones else [])
    return "WITH" + ",".join(parts) + "\n" + body


def exact_sum_sql(column: str) -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


def exact_avg_sql(column: str, kind: str = "DECIMAL(18,2)") -> str:
    return f"CAST(sum(CAST({column} AS {kind})) AS DOUBLE) / nullif(count({column}), 0)"
