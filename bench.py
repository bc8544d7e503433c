"""Timings of the headline queries, as one JSON line.

Clean trips and marts are built once from ``$BENCH_SF_DIR`` (their build times are
reported too; ``one_row_floor`` is what an aggregate and a sort of one row take). Then each query runs one warm-up and seven timed iterations over the
stored layers, with all result rows fetched, and its median counts. ``ev`` trips carry
times of day (q1 to q5); ``li`` trips spread over 80 months (partition pruning).
"""

from __future__ import annotations

import json
import os
import statistics
import time
from datetime import datetime

from tripstrata.catalogue.base import Q1_END, Q1_START, new_warehouse, raw
from tripstrata.operators.batches import load_frame
from tripstrata.plans import workload as W
from tripstrata.plans.builds import (
    audit,
    build_clean,
    build_mart,
    build_marts,
    build_quarantine,
    check_clean,
    rolling_window,
    trips_between,
)
from tripstrata.session import build_session
from tripstrata.sources.tables import nation_zones
from tripstrata.sources.zones import load_zones
from tripstrata.storage.warehouse import ALL

ITERATIONS, WARMUPS = 7, 1


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return time.perf_counter() - start


def median_of(run) -> float:
    for _ in range(WARMUPS):
        run()
    return statistics.median(timed(run) for _ in range(ITERATIONS))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    stores = {}
    for kind in ("ev", "li"):
        store = stores[kind] = new_warehouse(spark, f"bench-{kind}")
        load_zones(store, nation_zones(spark, sf_dir))
        seconds[f"load_raw_{kind}"] = timed(lambda: load_frame(store, raw(spark, sf_dir, kind), ALL))
        seconds[f"build_clean_{kind}"] = timed(lambda: build_clean(store))
        seconds[f"build_quarantine_{kind}"] = timed(lambda: build_quarantine(store))
        seconds[f"build_marts_{kind}"] = timed(lambda: build_marts(store, full=True))
    ev, li = stores["ev"], stores["li"]
    window = rolling_window(li)
    seconds["rebuild_window_mart_li"] = timed(lambda: build_mart(li, "daily_revenue", window))

    clean, zones = ev.read("clean"), ev.read("zones")
    days, hours = ev.read("daily_revenue"), ev.read("hourly_peak")
    spread = li.read("clean")
    two_months, one_day = (datetime(1998, 3, 1), datetime(1998, 5, 1)), (datetime(1998, 3, 3), datetime(1998, 3, 4))
    # like the whole layers above, the files of a window are chosen once; ``choose_files`` is what that takes
    q1_day, months, day = trips_between(ev, Q1_START, Q1_END), trips_between(li, *two_months), trips_between(li, *one_day)
    queries = {
        "q1_top_pickup_zones_day": lambda: W.top_pickup_zones(q1_day, Q1_START, Q1_END).collect(),
        "q2_revenue_by_day": lambda: W.revenue_by_day(clean).collect(),
        "q2_mart_daily_revenue": lambda: W.revenue_by_day_from_mart(days).collect(),
        "q3_join_zone_lookup_top20": lambda: W.top_zones(clean, zones).collect(),
        "q4_payment_type_stats": lambda: W.payment_stats(clean).collect(),
        "q5_hourly_peak": lambda: W.hourly_ranking(clean).collect(),
        "q5_mart_hourly_peak": lambda: W.hourly_ranking_from_mart(hours).collect(),
        "window_revenue_pruned": lambda: W.window_revenue(months, *two_months).collect(),
        "day_zones_pruned": lambda: W.top_pickup_zones(day, *one_day).collect(),
        "full_revenue": lambda: W.revenue_by_day(spread).collect(),
        "one_row_floor": lambda: spark.range(1).groupBy("id").count().orderBy("id").collect(),
        "choose_files": lambda: trips_between(li, *one_day),
        "quality_suites": lambda: check_clean(ev)[0].collect(),
        "batch_audit": lambda: audit(ev).collect(),
    }
    timings = {name: median_of(run) for name, run in queries.items()}
    headline = sum(v for name, v in timings.items() if name.startswith("q") and name[1].isdigit())
    print(
        json.dumps(
            {
                "metric": "sum of q1-q5 medians",
                "value": round(headline, 4),
                "unit": "sec",
                "queries": {name: round(v, 4) for name, v in timings.items()},
                "builds": {name: round(v, 3) for name, v in seconds.items()},
                "rows": {"ev_clean": clean.count(), "li_clean": spread.count()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
