"""Times the headline queries once each after a warm-up scan; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

HEADLINE = [
    "qc_masked_pixel_mean", "iqr_temporal", "asof_nearest", "asof_forward_by_key", "bilinear_sample", "line_in_cell_km",
    "polygon_cover_fraction", "zone_totals_multi", "flux_divergence_map", "divergence_totals_ci", "rotated_bins", "bootstrap_ci",
    "profile_fit_grid", "seasonal_emissions", "label_with_sd", "feature_assembly", "season_features", "region_totals", "temporal_factor_F",
    "summary_by_group", "spearman_matrix", "skill_scores", "paired_block_bootstrap", "semivariogram", "balanced_folds", "oof_ridge",
    "spin_maps", "permutation_test_rows", "kernel_smooth", "uncertainty_draws", "plume_regression", "incremental_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("skylattice-bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from skylattice.plans import CATALOGUE

    names = sys.argv[1:] or HEADLINE
    for t in ("events", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        CATALOGUE[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
