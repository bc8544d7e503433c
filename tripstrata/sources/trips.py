"""Monthly trip files to the raw layer's columns."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripstrata.schemas import AMOUNT, AMOUNT_COLUMNS, CODE_COLUMNS, RAW, SOURCE_TYPES
from tripstrata.storage.files import Files

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def read_trip_file(spark: SparkSession, path: str) -> DataFrame:
    """One month's Parquet file or folder, as it is."""
    return spark.read.parquet(path)


# what a source frame of several files carries beside the files' own columns
BATCH, FILE = "batch_id", "_source_file"


def read_by_schema(spark: SparkSession, paths: Mapping[str, str]) -> list[DataFrame]:
    """The months' files as one frame per schema, each row with its ``batch_id`` and ``_source_file``.

    Only footers are looked at to sort the files by schema, several at a time.
    """
    files = Files(spark)
    with ThreadPoolExecutor(16) as pool:
        schemas = list(pool.map(files.parquet_schema, paths.values()))
    alike: dict[tuple[str, int], dict[str, str]] = {}
    for (batch, path), schema in zip(paths.items(), schemas, strict=True):
        # a file given for several months is read for each
        again = sum(path in group.values() for (other, _), group in alike.items() if other == schema)
        alike.setdefault((schema, again), {})[batch] = path
    return [_read_alike(spark, group) for group in alike.values()]


def _read_alike(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    files = Files(spark)
    rows = spark.read.parquet(*paths.values())
    # a path is a file, or a folder of files
    owners = [F.lit(x) for batch, path in paths.items() for x in (files.encoded_path(path), batch)]
    given = [F.lit(x) for path in paths.values() for x in (files.encoded_path(path), path)]
    file = F.regexp_replace("_metadata.file_path", "^[^/]*:(//[^/]*)?(?=/)", "")
    folder = F.regexp_replace(file, "/[^/]*$", "")
    find = lambda pairs: F.coalesce(F.try_element_at(F.create_map(*pairs), file), F.try_element_at(F.create_map(*pairs), folder))
    # the batch is the file's, whatever the file says about itself
    own = [F.col(f"`{c}`") for c in rows.columns if c.strip().lower() not in (BATCH, FILE)]
    return rows.select(*own, find(owners).alias(BATCH), find(given).alias(FILE))


def known_columns(df: DataFrame) -> dict[str, str]:
    """Known column -> its spelling in ``df``; names match without regard to case and padding."""
    spelled = {name.strip().lower(): name for name in df.columns}
    return {name: spelled[name] for name in SOURCE_TYPES if name in spelled}


def _source(df: DataFrame, spelling: str) -> tuple[Column, T.DataType]:
    return F.col(f"`{spelling}`"), df.schema[spelling].dataType


def _present(value: Column, kind: T.DataType) -> Column:
    """The value, with the source's ways of writing "nothing" turned to NULL."""
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    return value


def _whole_number(value: Column, kind: T.DataType) -> Column:
    """64-bit code; NULL for anything that is not a whole number."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return value.cast("bigint")
    if isinstance(kind, T.StringType):
        trimmed = F.trim(value)
        number = F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))
        return F.coalesce(trimmed.try_cast("bigint"), _whole_number(number, T.DoubleType()))
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return F.when(value % 1 == 0, value.try_cast("bigint"))
    return F.lit(None).cast("bigint")


def _amount(value: Column, kind: T.DataType) -> Column:
    """The value as it is written, exactly; NULL when its digits do not fit the amount type.

    Doubles go through their shortest text, so 0.1 is a tenth. Text that is no number fails.
    """
    if isinstance(kind, (T.StringType, T.FloatType, T.DoubleType)):
        written = F.trim(value.cast("string"))
        number = value.cast("double")
        exact = written.try_cast(AMOUNT.simpleString())
        # a text with more digits than fit is rounded by the cast, which its own text gives away
        digits = F.length(F.regexp_replace(F.regexp_extract(written, r"\.([0-9]*)", 1), "0+$", ""))
        power = F.coalesce(F.regexp_extract(written, "[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        return F.when(number.isNotNull() & (digits - power <= AMOUNT.scale), exact)
    if isinstance(kind, T.DecimalType) and (kind.scale > AMOUNT.scale or kind.precision - kind.scale > AMOUNT.precision - AMOUNT.scale):
        exact = value.try_cast(AMOUNT.simpleString())
        return F.when(exact == value, exact)
    return value.cast(AMOUNT)


def _moment(value: Column, kind: T.DataType) -> Column:
    """Wall-clock time; instants are read as UTC whatever the session zone."""
    if isinstance(kind, T.TimestampType):
        return F.to_utc_timestamp(value, F.current_timezone()).cast("timestamp_ntz")
    return value.cast("timestamp_ntz")


def _conformed(df: DataFrame, name: str, spelling: str | None) -> Column:
    target = SOURCE_TYPES[name]
    if spelling is None:
        return F.lit(None).cast(target)
    value, kind = _source(df, spelling)
    present = _present(value, kind)
    if name in CODE_COLUMNS:
        return _whole_number(present, kind)
    if isinstance(target, T.TimestampNTZType):
        return _moment(present, kind)
    if name in AMOUNT_COLUMNS:
        return _amount(present, kind)
    return present.cast(target)


def conform(df: DataFrame) -> DataFrame:
    """All known columns in fixed order and type; missing ones are NULL, others dropped."""
    spelled = known_columns(df)
    return df.select(*[_conformed(df, name, spelled.get(name)).alias(name) for name in SOURCE_TYPES])


def _always_kept(name: str, kind: T.DataType) -> bool:
    """Does every value of this type fit the column? Then no row need be looked at."""
    if name in CODE_COLUMNS:
        return isinstance(kind, (T.IntegralType, T.BooleanType))
    return isinstance(kind, T.DecimalType) and kind.scale <= AMOUNT.scale and kind.precision - kind.scale <= AMOUNT.precision - AMOUNT.scale


def _lost(df: DataFrame, names: tuple[str, ...], convert) -> Column:
    """Those of ``names`` whose value is present in the source but not kept by ``convert``."""
    spelled = known_columns(df)
    flags = []
    for name in names:
        if name in spelled:
            value, kind = _source(df, spelled[name])
            if _always_kept(name, kind):
                continue
            present = _present(value, kind)
            flags.append(F.when(present.isNotNull() & convert(present, kind).isNull(), F.lit(name)))
    return F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")


def rejected_codes(df: DataFrame) -> Column:
    """Names of the code columns whose value is present but not a whole number."""
    return _lost(df, CODE_COLUMNS, _whole_number)


def rejected_amounts(df: DataFrame) -> Column:
    """Names of the amount columns whose value has more digits than an amount holds."""
    return _lost(df, AMOUNT_COLUMNS, _amount)


def may_reject(df: DataFrame) -> bool:
    """Has ``df`` a column of a type whose values may be lost?"""
    return any(not _always_kept(name, df.schema[spelling].dataType) for name, spelling in known_columns(df).items() if name in CODE_COLUMNS + AMOUNT_COLUMNS)


def rejected(df: DataFrame) -> Column:
    """True for source rows that lose a value."""
    return (F.size(rejected_codes(df)) > 0) | (F.size(rejected_amounts(df)) > 0)


def ingest_errors(df: DataFrame, created_at: datetime) -> DataFrame:
    """One row per source row that lost a value, with the whole source row as JSON; ``df`` comes from :func:`read_by_schema`."""
    reason = lambda what, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{what}: "), F.array_join(names, ", ")))
    reasons = F.concat_ws("; ", reason("not a whole number", rejected_codes(df)), reason("too many digits", rejected_amounts(df)))
    return df.where(rejected(df)).select(
        BATCH,
        F.col(FILE).alias("source_file"),
        reasons.alias("error_reason"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (BATCH, FILE)])).alias("raw_payload"),
        F.lit(created_at).alias("created_at"),
    )


def run_moment() -> datetime:
    return datetime.now(timezone.utc)


def tag(conformed: DataFrame, batch_id: Column, ingested_at: datetime) -> DataFrame:
    """Raw rows: the batch and one load time for the whole run."""
    return conformed.select(
        batch_id.alias("batch_id"),
        *SOURCE_TYPES,
        F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
    )


def raw_from_batched(df: DataFrame, ingested_at: datetime | None = None) -> DataFrame:
    """Raw rows of a source frame that already carries ``batch_id``."""
    spelled = known_columns(df)
    data = [_conformed(df, name, spelled.get(name)).alias(name) for name in SOURCE_TYPES]
    moment = F.lit(ingested_at or run_moment()).cast("timestamp")
    return df.select(F.col("batch_id"), *data, moment.alias("ingested_at")).select(*RAW.fieldNames())
