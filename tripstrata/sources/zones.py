"""The zone lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.operators.checks import duplicate_keys
from tripstrata.schemas import ZONE_COLUMNS, ZONES
from tripstrata.storage.warehouse import Warehouse


def conform_zones(df: DataFrame) -> DataFrame:
    """Trim and lower-case the header, demand the four columns, keep NULL names NULL."""
    renamed = df.toDF(*[name.strip().lower() for name in df.columns])
    missing = sorted(set(ZONE_COLUMNS) - set(renamed.columns))
    if missing:
        raise ValueError(f"zone lookup lacks columns: {missing}")
    return renamed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ZONES.fields])


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    return conform_zones(spark.read.option("header", True).option("nullValue", "").csv(path))


def load_zones(warehouse: Warehouse, df: DataFrame) -> None:
    """Full replace. The id must be unique; there is no key constraint to rely on."""
    if not duplicate_keys(df, ["locationid"]).isEmpty():
        raise ValueError("zone lookup has repeated locationid values")
    warehouse.publish_whole("zones", df)
