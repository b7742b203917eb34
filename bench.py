"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from pacegrid.queries import REGISTRY
from pacegrid.session import local_session

HEADLINES = [
    "gapfilled_series",
    "sector_clock",
    "wide_features",
    "time_bucket_join",
    "multi_key_inner_join",
    "lookup_left_join",
    "lag_lead",
    "running_total",
    "fill_updown",
    "impute_group_mean",
    "repeat_ordinal",
    "unpivot_measures",
    "pivot_multi",
    "zscore_global",
    "column_summary",
    "rmsle_by_group",
    "trend_line",
    "position_timeline",
    "top_k",
    "duration_seconds",
    "parse_timestamp",
    "range_rescale",
    "ols_fit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="bench")
    spark.sparkContext.setLogLevel("OFF")
    REGISTRY["lag_lead"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        begun = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    line = {
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
