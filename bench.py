"""Headline queries on local Spark; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(Path(__file__).resolve().parent), os.environ.get("PYTHONPATH")]))

#: Whole-file decode, region, keys, flag fetch, QC and selection: the workloads of the published baselines.
HEADLINE = ["store_full_read", "projection_read", "region_read", "key_read", "row_read", "flag_then_fetch", "qc_reason_counts", "qc_kept_rows", "core_plus", "pvalue_regions_merged", "batch_two_studies", "harmonise_align", "liftover_blocks"]


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from locusforge.plans import catalogue, queries, view

    began = time.time()
    n = view.prepared(spark, sf_dir).count()  # the study is ingested, checked and written once
    for name in ("store", "exact", "exact2"):
        queries._store(spark, sf_dir, name, shift=name == "exact2", **({} if name == "store" else {"profile": "exact"}))
    queries._numbered(spark, sf_dir).count()
    setup, times = time.time() - began, {}
    for name in HEADLINE:
        best = None
        for _ in range(3):
            t = time.time()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total of headline queries, best of 3", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "rows": n, "setup_sec": round(setup, 3), "store_rows_per_sec": round(n / times["store_full_read"])}))
    spark.stop()


if __name__ == "__main__":
    main()
