"""Time headline queries: one JSON line with seconds per query. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from swathline.catalog import load
from swathline.session import local_session

HEADLINE = [
    "R3_percentile_levels", "R3_percentile_levels_big", "R4_stretch_preview", "R10_band_covariance",
    "M1_line_change_signal", "M1_line_change_signal_big", "M5_inflexion_intensity", "G5_poses_to_ecef",
    "T1_time_at_line", "T5_pose_manifold", "T9_pps_clock_fix", "P2_rays", "P4_project_to_terrain", "P7_view_angles",
    "O6_splat", "O8_inpaint_nearest", "O10_bilinear_sample", "H1_shift_ncc", "H4_shift_likelihood", "H7_line_cost_band",
    "H9_rectify_horizontal", "L4_nearest_observation", "L6_triangulate", "L13_ray_pairs",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    queries = load().queries
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before the first timing
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if name in queries:
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
