"""Expressions against plain Python, and independence from the session time zone."""

from __future__ import annotations

import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tripstrata.functions import temporal as TS
from tripstrata.functions.order_stats import median, order_statistics, percentile_nearest
from tripstrata.operators.timings import compare, compare_runs, latest_complete_run, resolve_runs, summarize
from tripstrata.sources.runlog import phase_of, run_id_of


@pytest.fixture(params=["UTC", "America/New_York", "Pacific/Apia"])
def zone(request, spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_time_expressions_ignore_the_zone(spark, zone):
    # 02:30 does not exist in New York on this day
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:59.5' as a, timestamp_ntz'2024-03-10 05:30:00.25' as b")
    row = df.select(
        TS.seconds_between("a", "b").alias("s"),
        TS.hour_start("a").alias("h"),
        TS.month_start("a").alias("m"),
        TS.month_key("a").alias("k"),
        TS.plus_months("a", -1).alias("p"),
        TS.batch_month(F.lit("2024-03")).alias("bm"),
        (F.col("a") >= TS.ts_literal(datetime(2024, 3, 10, 2, 30, 59, 500000))).alias("same"),
        F.hour("a").alias("hr"),
    ).first()
    assert row.s == Decimal("10740.750000")
    assert row.h == datetime(2024, 3, 10, 2)
    assert row.m == row.bm == datetime(2024, 3, 1)
    assert row.k == "202403" and row.hr == 2 and row.same
    assert row.p == datetime(2024, 2, 10, 2, 30, 59, 500000)


@pytest.mark.parametrize(
    ("batch", "month"),
    [("2024-01", datetime(2024, 1, 1)), ("2024-13", None), ("2024-00", None), ("test", None), ("2024-1", None), ("2024-011", None), (None, None)],
)
def test_batch_month(spark, batch, month):
    assert spark.createDataFrame([(batch,)], "b string").select(TS.batch_month("b")).first()[0] == month


def nearest(values: list[int], p: float) -> int:
    ordered = sorted(values)
    return ordered[int(round((len(ordered) - 1) * p))]


def middle(values: list[int]) -> float:
    ordered = sorted(values)
    n = len(ordered)
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


@pytest.mark.parametrize("seed", range(4))
def test_order_statistics_against_sorting(spark, seed):
    random.seed(seed)
    spread = random.choice([5, 1000, 10**9, 10**13])
    groups = {g: [random.randint(-spread, spread) for _ in range(random.randint(1, 60))] for g in ("a", "b", None)}
    groups["same"] = [7] * 500
    rows = [(g, Decimal(v).scaleb(-3)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows + [("a", None)], "g string, v decimal(18,3)")
    for p in (0.0, 0.5, 0.95, 1.0):
        found = {r.g: r.x for r in percentile_nearest(df, ["g"], "v", p, "x").collect()}
        assert found == {g: nearest(values, p) / 1000 for g, values in groups.items()}
    found = {r.g: r.x for r in median(df, ["g"], "v", "x").collect()}
    assert found == {g: pytest.approx(middle(values) / 1000, rel=1e-15) for g, values in groups.items()}


def test_order_statistics_needs_a_group(spark):
    with pytest.raises(ValueError):
        order_statistics(spark.range(1), [], "id", {"x": F.lit(0)})


# ---------------------------------------------------------------- timing logs


def log(spark, rows):
    return spark.createDataFrame(rows, "run_id string, phase string, query string, iter int, elapsed_ms double").withColumn(
        "elapsed_ms", F.col("elapsed_ms").cast("decimal(18,3)")
    )


ROWS = [
    ("r1", "before", "q1", 1, 100.0), ("r1", "before", "q1", 2, 110.0), ("r1", "before", "q1", 3, 400.0),
    ("r1", "after", "q1", 1, 40.0), ("r1", "after", "q1", 2, 60.0),
    ("r1", "before", "q2", 1, 10.0), ("r1", "after", "q3", 1, 10.0),
    ("r2", "before", "q1", 1, 5.0),
]


def test_comparison(spark):
    found = [tuple(r) for r in compare_runs(log(spark, ROWS)).collect()]
    assert found == [("q1", 110.0, 50.0, 2.2, 54.5), ("q2", 10.0, None, None, None), ("q3", None, 10.0, None, None)]


def test_comparison_by_zero(spark):
    one = spark.createDataFrame([("q", 0.0)], "query string, before_ms double")
    assert compare(one, one.withColumnRenamed("before_ms", "after_ms")).first().speedup_x is None


def test_which_runs(spark):
    rows = log(spark, ROWS)
    assert latest_complete_run(rows) == "r1"
    assert resolve_runs(rows, run_id=" r1 ") == ("r1", "r1")
    with pytest.raises(FileNotFoundError):
        resolve_runs(rows, run_id="r2")
    with pytest.raises(FileNotFoundError):
        latest_complete_run(rows.where("phase = 'before'"))
    with pytest.raises(ValueError, match="both"):
        resolve_runs(rows, before_run="r1")
    with pytest.raises(ValueError, match="different runs"):
        resolve_runs(rows, before_run="r2", after_run="r1")
    with pytest.raises(ValueError, match="requested run"):
        resolve_runs(rows, run_id="r1", after_run="r2")
    assert resolve_runs(rows, before_run="r2", after_run="r1", allow_mismatched=True) == ("r2", "r1")


def test_summary(spark):
    found = {(r.run_id, r.phase, r.query): r for r in summarize(log(spark, ROWS)).collect()}
    row = found[("r1", "before", "q1")]
    assert (row["count"], row["min"], row["max"], row["median"]) == (3, 100.0, 400.0, 110.0)
    assert row["mean"] == pytest.approx(610 / 3)


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("/d/benchmarks_a_b_before.csv", ("a_b", "before")),
        ("/d/benchmarks_x_after.csv/part-0.csv", ("x", "after")),
        ("benchmarks_before_20260110_134736.csv", ("20260110_134736", "before")),
        ("benchmarks_during.csv", (None, None)),
        ("other_x_before.csv", (None, None)),
    ],
)
def test_log_names(spark, path, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert tuple(df.select(run_id_of(F.col("p")), phase_of(F.col("p"))).first()) == expected
