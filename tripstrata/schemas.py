"""Column names, types and stored layers. All lists are in table order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# wide enough for the shortest text of a double, so that nothing is rounded on load
AMOUNT = T.DecimalType(38, 18)
TS = T.TimestampNTZType()

# Names of the monthly trip files' columns.
TIME_COLUMNS = ("tpep_pickup_datetime", "tpep_dropoff_datetime")
CODE_COLUMNS = ("vendorid", "ratecodeid", "pulocationid", "dolocationid", "payment_type")
SOURCE_TYPES: dict[str, T.DataType] = {
    "vendorid": T.LongType(),
    "tpep_pickup_datetime": TS,
    "tpep_dropoff_datetime": TS,
    "passenger_count": AMOUNT,
    "trip_distance": AMOUNT,
    "ratecodeid": T.LongType(),
    "store_and_fwd_flag": T.StringType(),
    "pulocationid": T.LongType(),
    "dolocationid": T.LongType(),
    "payment_type": T.LongType(),
    "fare_amount": AMOUNT,
    "extra": AMOUNT,
    "mta_tax": AMOUNT,
    "tip_amount": AMOUNT,
    "tolls_amount": AMOUNT,
    "improvement_surcharge": AMOUNT,
    "total_amount": AMOUNT,
    "congestion_surcharge": AMOUNT,
    "airport_fee": AMOUNT,
    "cbd_congestion_fee": AMOUNT,
}

AMOUNT_COLUMNS = tuple(name for name, kind in SOURCE_TYPES.items() if kind is AMOUNT)

# Staged name -> raw name. The four raw columns missing here
# (extra, mta_tax, tolls_amount, improvement_surcharge) stop at the raw layer.
STAGE_COLUMNS = {
    "batch_id": "batch_id",
    "vendor_id": "vendorid",
    "pickup_ts": "tpep_pickup_datetime",
    "dropoff_ts": "tpep_dropoff_datetime",
    "passenger_count": "passenger_count",
    "trip_distance": "trip_distance",
    "rate_code_id": "ratecodeid",
    "store_and_fwd_flag": "store_and_fwd_flag",
    "pu_location_id": "pulocationid",
    "do_location_id": "dolocationid",
    "payment_type": "payment_type",
    "fare_amount": "fare_amount",
    "tip_amount": "tip_amount",
    "total_amount": "total_amount",
    "congestion_surcharge": "congestion_surcharge",
    "airport_fee": "airport_fee",
    "cbd_congestion_fee": "cbd_congestion_fee",
    "ingested_at": "ingested_at",
}

ZONE_COLUMNS = ("locationid", "borough", "zone", "service_zone")


def _struct(columns: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


RAW = _struct({"batch_id": T.StringType(), **SOURCE_TYPES, "ingested_at": T.TimestampType()})
_RAW_TYPES = {field.name: field.dataType for field in RAW.fields}

STAGE = _struct(
    {
        **{name: _RAW_TYPES[raw] for name, raw in STAGE_COLUMNS.items()},
        "trip_duration_sec": T.DecimalType(18, 6),
        "avg_speed_kmh": T.DoubleType(),
    }
)
CLEAN = T.StructType(STAGE.fields + [T.StructField("row_fingerprint", T.StringType(), True)])
CLEAN_STORED = T.StructType(CLEAN.fields + [T.StructField("pickup_month", T.StringType(), True)])
QUARANTINE = T.StructType(STAGE.fields + [T.StructField("reason_code", T.StringType(), True)])

ZONES = _struct(dict.fromkeys(ZONE_COLUMNS, T.StringType()) | {"locationid": T.IntegerType()})
INGEST_ERRORS = _struct(
    {
        "batch_id": T.StringType(),
        "source_file": T.StringType(),
        "error_reason": T.StringType(),
        "raw_payload": T.StringType(),
        "created_at": T.TimestampType(),
    }
)

DAILY_REVENUE = _struct(
    {
        "trip_date": T.DateType(),
        "trips": T.LongType(),
        "revenue": AMOUNT,
        "trip_month": T.StringType(),
    }
)
HOURLY_PEAK = _struct(
    {
        "pickup_hour": TS,
        "hr": T.IntegerType(),
        "trips": T.LongType(),
        "trip_month": T.StringType(),
    }
)
DAILY_ZONE = _struct(
    {
        "trip_date": T.DateType(),
        "pu_location_id": T.LongType(),
        "trips": T.LongType(),
        "avg_total_amount": T.DoubleType(),
        "avg_tip_amount": T.DoubleType(),
        "avg_distance": T.DoubleType(),
        "avg_duration_sec": T.DoubleType(),
        "trip_month": T.StringType(),
    }
)

# What a batch adds to the marts, per day and zone, and per hour: sums and counts, which add up over batches.
ZONE_STATE = _struct(
    {
        "batch_id": T.StringType(),
        "trip_date": T.DateType(),
        "pu_location_id": T.LongType(),
        "trips": T.LongType(),
        **{
            f"{name}_{part}": (T.DecimalType(38, 18) if kind is AMOUNT else T.DecimalType(28, 6)) if part == "sum" else T.LongType()
            for name, kind in (("total_amount", AMOUNT), ("tip_amount", AMOUNT), ("trip_distance", AMOUNT), ("trip_duration_sec", None))
            for part in ("sum", "count")
        },
    }
)
HOUR_STATE = _struct({"batch_id": T.StringType(), "pickup_hour": TS, "hr": T.IntegerType(), "trips": T.LongType()})

RUN_LOG = _struct(
    {
        "run_id": T.StringType(),
        "phase": T.StringType(),
        "query": T.StringType(),
        "iter": T.IntegerType(),
        "elapsed_ms": T.DecimalType(18, 6),
    }
)
RUN_LOG_OLD = T.StructType(RUN_LOG.fields[1:])


# A quality run as one document: suites, their results, and in each the values that broke it.
RUN_RESULT = _struct(
    {
        "position": T.IntegerType(),
        **dict.fromkeys(("expectation_type", "domain", "rationale", "column_name"), T.StringType()),
        **dict.fromkeys(("min_value", "max_value"), T.DoubleType()),
        "value_set": T.StringType(),
        "mostly": T.DoubleType(),
        **dict.fromkeys(("element_count", "missing_count", "unexpected_count"), T.LongType()),
        **dict.fromkeys(("missing_percent", "unexpected_percent", "unexpected_percent_total"), T.DoubleType()),
        "success": T.BooleanType(),
        "unexpected": T.ArrayType(_struct({"value": T.StringType(), "sample_count": T.LongType()})),
    }
)
RUN_SUITE = _struct(
    {
        **dict.fromkeys(("severity", "suite", "suite_version"), T.StringType()),
        **dict.fromkeys(("evaluated_expectations", "failed_expectations"), T.LongType()),
        **dict.fromkeys(("success", "blocks_run"), T.BooleanType()),
        "results": T.ArrayType(RUN_RESULT),
    }
)
RUN_DOCUMENT = _struct(
    {
        **dict.fromkeys(("run_time", "table_name"), T.StringType()),
        **dict.fromkeys(("fail_on_critical", "fail_on_warning", "success", "blocked"), T.BooleanType()),
        "suites": T.ArrayType(RUN_SUITE),
    }
)


@dataclass(frozen=True)
class Layer:
    """A stored table: its relation name, schema, directory partition columns, the time its files are chosen by, and are rows sorted within files?"""

    relation: str
    schema: T.StructType
    partition_by: tuple[str, ...] = ()
    time: str | None = None
    ordered: bool = False


# The relation names queries use.
LAYERS = {
    "raw": Layer("raw.yellow_trips", RAW, ("batch_id",), "tpep_pickup_datetime"),
    "zones": Layer("raw.taxi_zone_lookup", ZONES),
    "ingest_errors": Layer("raw.ingest_errors", INGEST_ERRORS, ("batch_id",)),
    "clean": Layer("clean.clean_yellow_trips", CLEAN_STORED, ("batch_id", "pickup_month"), "pickup_ts", ordered=True),
    "quarantine": Layer("quarantine.quarantine_yellow_trips", QUARANTINE, ("batch_id",), "pickup_ts"),
    "daily_revenue": Layer("marts.marts_daily_revenue", DAILY_REVENUE),
    "hourly_peak": Layer("marts.marts_hourly_peak", HOURLY_PEAK),
    "daily_zone": Layer("marts.daily_zone_metrics", DAILY_ZONE),
    "zone_state": Layer("state.batch_day_zone", ZONE_STATE),
    "hour_state": Layer("state.batch_hour", HOUR_STATE),
}
STAGE_RELATION = "stg.stg_yellow_trips"
