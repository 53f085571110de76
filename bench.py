"""Benchmark of the headline queries.

Runs each query at $BENCH_SF_DIR on local[$BENCH_CPUS]: once to warm up, then up to three
timed runs (fewer for slow queries), and reports the median. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pathlib import Path

from tilewright.plans import load
from tilewright.session import local_session

HEADLINE = [
    "change_by_site", "f06_area_intersects", "a01_tile_summary", "a03_band_statistics", "a07_cut_points", "a08_pair_report",
    "a12_water_extent", "w02_consecutive_pairs", "w05_mosaic", "t01_search_candidates", "t02_similar_tiles", "t09_image_search",
    "j02_tiles_in_areas", "j09_as_of", "j14_exact_neighbours", "n01_shadows", "n03_trimap", "n04_regions", "t07_consolidated_boxes",
    "u02_region_union", "cloud_removal", "g04_pixels_by_window", "a21_cluster_profile", "k01_upsert", "v01_registry_rules",
]


def dealt(spark, sf_dir: str, files: int) -> str:
    """The sample tables, the two that pixels and tiles are computed from in several files: each
    sample file has one row group, which a scan can't share out."""
    folder = tempfile.mkdtemp(prefix="spark-bench-", dir="/tmp")
    for path in Path(sf_dir).iterdir():
        if path.stem in ("orders", "events"):
            spark.read.parquet(str(path)).repartition(files).write.parquet(f"{folder}/{path.name}")
        else:
            os.symlink(path, f"{folder}/{path.name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES
    sf_dir = dealt(spark, sf_dir, int(cpus))
    times: dict[str, float] = {}
    for name in wanted:
        runs = []
        for attempt in range(4):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            spark.catalog.clearCache()
            if attempt or spent > 20:  # the first run warms up
                runs.append(spent)
            if sum(runs) > 10:
                break
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
