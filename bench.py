"""Benchmark: headline queries over the test tables, median of warm runs, one JSON line.

Each run starts from the Parquet files and ends in a sink that takes every row. Settings:
``BENCH_SF_DIR`` (data directory), ``BENCH_CPUS`` (local threads), ``BENCH_RUNS`` (warm runs).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixtures.catalog import CATALOG  # noqa: E402
from trapline.session import local_session  # noqa: E402

HEADLINE = [
    "site_density_by_region",
    "points_in_regions",
    "habitat_counts",
    "assays_per_microbe",
    "host_pathogen_table",
    "tested_per_country",
    "detection_layer",
    "detection_clusters",
    "species_choices",
    "studies_per_country_year",
    "first_assay_per_coordinate",
    "median_samples_per_microbe",
]


def timed(spark, name: str, directory: str) -> float:
    start = time.perf_counter()
    CATALOG[name][0](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cpus, "trapline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        timed(spark, name, directory)
        seconds[name] = round(statistics.median(timed(spark, name, directory) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": f"total of median warm runs, {len(seconds)} queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(directory).name.removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
