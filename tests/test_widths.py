"""What the shuffles and sorts of the layer builds carry."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from helpers import FIRST_LOAD, raw_trips, source, trip
from tripstrata.catalogue.base import source_rows
from tripstrata.operators import layout
from tripstrata.operators.batches import load_files, load_frame, load_source
from tripstrata.operators.layout import arranged
from tripstrata.operators.staging import clean_trips, enriched, quarantined_by_batch, quarantined_trips, stage, typed
from tripstrata.plans.builds import build_clean, build_quarantine
from tripstrata.session import size_in_bytes
from tripstrata.sources.tables import line_trips_yearly
from tripstrata.sources.trips import may_reject, read_by_schema
from tripstrata.storage import warehouse as storage
from tripstrata.storage.warehouse import ALL

TRIPS = [
    trip("2024-01", 1, "2024-01-05 10:00:00"),
    trip("2024-01", 2, "2024-01-04 10:00:00", total_amount=-1.0),
    trip("2024-01", 3, "2024-01-04 10:00:00", minutes=1, trip_distance=90.0),
    trip("2024-02", 4, "2024-02-04 10:00:00", minutes=None),
    trip("2024-02", 4, "2024-02-04 10:00:00", minutes=None),
]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def below_rebalance(df) -> str:
    """The plan below the rebalancing shuffle."""
    return re.split(r"RebalancePartitions", plan(df), maxsplit=1)[1]


def rows(df) -> list:
    return sorted(df.collect(), key=str)


@pytest.fixture()
def written(monkeypatch):
    """The frames that are written, with the settings they are written under."""
    seen = []
    plain = storage.settings

    def watch(spark, wanted):
        seen.append(dict(wanted))
        return plain(spark, wanted)

    monkeypatch.setattr(storage, "settings", watch)
    return seen


def test_source_is_conformed_after_the_shuffle(spark, warehouse, monkeypatch):
    plans = []
    monkeypatch.setattr(type(warehouse), "publish", lambda self, layer, df, *_, **__: plans.append(below_rebalance(df)))
    load_source(warehouse, source(spark, TRIPS), FIRST_LOAD, ALL)
    assert "decimal(38,18)" not in plans[0] and "ingested_at" not in plans[0]


def test_source_gives_the_rows_of_the_frame(spark, warehouse):
    load_frame(warehouse, raw_trips(spark, TRIPS), ALL)
    before = rows(warehouse.read("raw"))
    load_source(warehouse, source(spark, TRIPS), FIRST_LOAD, ALL)
    assert rows(warehouse.read("raw")) == before


def test_a_batch_without_name_is_kept(spark, warehouse):
    load_source(warehouse, source(spark, [*TRIPS, trip(None, 9, "2024-01-05 10:00:00")]), FIRST_LOAD, ALL)
    assert warehouse.read("raw").where("batch_id IS NULL").count() == 1


def test_quarantine_is_derived_after_the_shuffle(spark):
    trips = typed(raw_trips(spark, TRIPS))
    found = quarantined_by_batch(trips)
    assert rows(found) == rows(quarantined_trips(enriched(trips)))
    top = plan(found).split("RebalancePartitions")[0]
    assert "trip_duration_sec" in top and "reason_code" in top
    assert "AS trip_duration_sec" not in below_rebalance(found) and "AS reason_code" not in below_rebalance(found)


def test_fingerprints_are_made_after_the_shuffle(spark, warehouse, monkeypatch):
    load_source(warehouse, source(spark, TRIPS), FIRST_LOAD, ALL)
    plans, plain = [], layout.Warehouse.publish

    def publish(self, layer, df, *args, **named):
        plans.append(below_rebalance(df))
        return plain(self, layer, df, *args, **named)

    monkeypatch.setattr(layout.Warehouse, "publish", publish)
    build_clean(warehouse)
    assert len(plans) == 1 and "md5" not in plans[0]
    names = clean_trips(stage(warehouse.read("raw"))).columns
    assert rows(warehouse.read("clean").select(*names)) == rows(clean_trips(stage(warehouse.read("raw"))))


def test_the_writer_need_not_sort_arranged_rows(spark):
    trips = typed(raw_trips(spark, TRIPS)).selectExpr("*", "CAST(NULL AS STRING) AS pickup_month")
    # a nullable folder column is replaced by another expression before the write, and the order is lost
    assert [arranged(trips).schema[c].nullable for c in ("batch_id", "pickup_month")] == [False, False]


def test_raw_and_quarantine_are_written_unsorted_and_clean_in_bounded_parts(spark, warehouse, written):
    load_source(warehouse, source(spark, TRIPS), FIRST_LOAD, ALL)
    build_clean(warehouse)
    build_quarantine(warehouse)
    raw, clean, quarantine = written
    assert raw == quarantine == {"spark.sql.maxConcurrentOutputFileWriters": "32"}
    assert size_in_bytes(clean["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) <= 32 << 20
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_more_folders_than_open_files(spark, warehouse):
    months = [f"{2000 + i // 12}-{i % 12 + 1:02d}" for i in range(50)]
    trips = [trip(m, i, f"{m}-03 10:00:00") for i, m in enumerate(months * 2)]
    load_source(warehouse, source(spark, trips), FIRST_LOAD + timedelta(days=1), ALL)
    assert warehouse.values("raw") == months
    assert {facts["rows"] for facts in warehouse.batches("raw").values()} == {2}


def test_sizes():
    assert [size_in_bytes(x) for x in ("64MB", "256m", "8388608b", "12", "1g", "16k")] == [64 << 20, 256 << 20, 8 << 20, 12, 1 << 30, 16 << 10]


def test_trips_are_made_before_lines_meet_orders(spark, sf_dir):
    above = plan(line_trips_yearly(spark, sf_dir)).split("Join")[0]
    assert "l_extendedprice" not in above and "l_partkey" not in above


def test_rows_for_two_loads_are_joined_once(spark, sf_dir):
    found = source_rows(spark, sf_dir, "yr")
    assert "Join" not in plan(found)
    assert rows(found) == rows(line_trips_yearly(spark, sf_dir))


def test_layers_are_written_compact(spark, warehouse):
    load_source(warehouse, source(spark, TRIPS), FIRST_LOAD, ALL)
    build_clean(warehouse)
    names = [name for layer in ("raw", "clean") for name in warehouse.read(layer).inputFiles()]
    assert names and all(name.endswith(".zstd.parquet") for name in names)


def test_types_that_lose_nothing_are_not_watched(spark, warehouse, tmp_path, monkeypatch):
    columns = "VendorID bigint, tpep_pickup_datetime timestamp_ntz, trip_distance decimal(18,2), tip_amount {}, payment_type {}"
    row = (1, datetime(2024, 1, 5), Decimal("1.25"))
    paths = {}
    for batch, tip, code in (("2024-01", ("decimal(18,2)", Decimal("0.5")), ("int", 2)), ("2024-02", ("double", 0.5), ("double", 2.5)), ("2024-03", ("decimal(38,2)", Decimal(10**30)), ("int", 2))):
        paths[batch] = f"{tmp_path}/{batch}"
        spark.createDataFrame([(*row, tip[1], code[1])], columns.format(tip[0], code[0])).write.parquet(paths[batch])
    frames = {batch: read_by_schema(spark, {batch: path})[0] for batch, path in paths.items()}
    assert {batch: may_reject(frame) for batch, frame in frames.items()} == {"2024-01": False, "2024-02": True, "2024-03": True}
    plans, publish = [], type(warehouse).publish

    def watch(self, layer, df, *args, **named):
        plans.append((layer, plan(df)))
        return publish(self, layer, df, *args, **named)

    monkeypatch.setattr(type(warehouse), "publish", watch)
    load_files(warehouse, {"2024-01": paths["2024-01"]})
    assert "CollectMetrics" not in plans[0][1]
    found = load_files(warehouse, paths, replace=True)
    assert {r.batch_id: r.rejected for r in found} == {"2024-01": 0, "2024-02": 1, "2024-03": 1}
    assert {r.batch_id: r.rows for r in found} == dict.fromkeys(paths, 1)
