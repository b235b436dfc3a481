"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores.
Each query is written to a sink that drops the rows, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from boxlake.queries import QUERIES
from boxlake.session import local_session, scratch

HEADLINE = [
    "nms_by_class",
    "preprocessed_detections",
    "tag_duplicates",
    "overlap_pairs",
    "tile_grid",
    "tiles_to_page",
    "detection_statistics",
    "spans_near_boxes",
    "nearest_symbol",
    "fused_texts",
    "tagged_texts",
    "extraction_statistics",
    "offset_statistics",
    "calibrated_texts",
    "sequenced_regions",
    "tag_rows",
    "region_summary",
    "text_clusters",
    "grid_areas",
    "detection_documents",
    "extracted_texts",
    "calibrated_extraction",
    "cluster_areas",
    "overlay_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench")
    QUERIES["class_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        with scratch(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
