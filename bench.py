"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "flagship_track_audit",
    "sc05_consecutive_speed",
    "dr09_ttff_cessation",
    "qc02_segments",
    "qc07_qc08_qc09_confirmed_cures",
    "rg04_resample_track",
    "gr01_start_arrays",
    "pr04_pr05_pair_observations",
    "cs02_cs03_geometry",
    "ep05_ep06_separation_bins",
    "fs03_first_passages",
    "pj02_dispersion",
    "af04_affine_fits",
    "cm05_jump_runs",
)


def main() -> None:
    from fleetwake.catalog import load
    from fleetwake.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["gr01_start_arrays"](spark, sf).count()  # start the workers once
    took = {}
    for name in HEADLINE:
        start = time.time()
        # The noop sink computes every column without moving rows to the driver.
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
