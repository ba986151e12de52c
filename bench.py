"""Time the headline queries: ``BENCH_SF_DIR=… BENCH_CPUS=… python bench.py [name …]``.

Prints one JSON line. Each query runs three times into a sink that computes every
row and keeps none: the first one warms the JVM, the median of the others counts,
and ``spread`` tells how far they lie apart.
"""

import json
import os
import statistics
import sys
import time

from veilcraft.plans.catalog import QUERIES
from veilcraft.session import build_session

HEADLINES = [
    "replace_documents", "replace_cells_total", "paragraph_replace", "discover_columns", "scrub_counts", "scrub_roundtrip",
    "encrypt_roundtrip", "encrypt_line_refs", "encrypt_documents_roundtrip", "encrypt_group_counts", "encrypt_join", "dictionary_remap",
    "pivot_encrypt_roundtrip", "overlay_style", "pdf_hits", "package_gate", "output_names", "first_redemption", "package_cells",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("veilcraft-bench", os.environ.get("BENCH_CPUS", "8"))
    times, spread = {}, {}
    for name in sys.argv[1:] or HEADLINES:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name], spread[name] = round(statistics.median(runs[1:]), 3), round(max(runs[1:]) - min(runs[1:]), 3)
    result = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "spread": spread,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
