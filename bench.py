"""Time the headline queries: one warm-up, then the median of three runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "diff_frame_report", "diff_drill_down", "diff_worst_pixel", "diff_origin_block", "diff_tracked_errors", "diff_content_equal",
    "container_samples", "container_samples_per_chunk", "container_units", "container_file_summary",
    "motion_outcome_counts", "motion_shape_census", "motion_margins", "motion_reference_groups", "motion_display_order",
    "profile_steady_state", "profile_phase_breakdown", "profile_cpu_share", "profile_inter_arrival",
    "trace_packets", "trace_findings", "trace_last_state", "trace_gate", "trace_programs", "trace_sessions",
    "blocks_inverse_transform", "blocks_half_pel", "blocks_motion_compensate", "blocks_edge_strength", "blocks_smooth_edge",
    "sink_ppm_images", "stream_budget_monitor",
]


def main() -> None:
    from mediaframe.plans import REGISTRY
    from tests.session import session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS"))
    times: dict[str, float] = {}
    for name in wanted:
        runs = []
        for i in range(repeats + 1):
            t0 = time.perf_counter()
            REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 4)
    total = round(sum(times.values()), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
