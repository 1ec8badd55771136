"""Time the headline queries: one warm-up and the median of three runs, written to a no-op sink.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path
from urllib.parse import urlparse

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldloom.acceptance import CASES  # noqa: E402
from fieldloom.session import local_session, shared_folder  # noqa: E402

HEADLINE = [
    "q_two_stage_mean", "q_filter_null_safe", "q_unpivot", "q_pivot", "q_cross_complete", "q_join_null_keys", "q_site_enrich",
    "q_impute_self", "q_agg_na_small_groups", "q_window_group", "q_keep_groups", "q_lag_transition", "q_first_last_row",
    "q_running_sum", "q_monthly_extremes", "q_zone_fill", "q_pet", "q_spei1", "q_spei3", "q_climatology_anomaly", "q_gap_fill",
    "q_time_to_event", "q_coded_recruits", "q_rounds_recruits", "q_community", "q_zscore", "q_reg_origin", "q_trend_quadratic",
    "q_poisson_coef", "q_draw_intervals", "q_quantiles", "q_ecdf", "q_trait_fill", "q_bootstrap", "q_combined_recruits",
    "q_scaled_recruits", "q_merge_biomass", "q_biomass_coefficients", "q_cover_rows", "q_drought_table", "q_delimited_schema",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, cores, "bench", "16g")

    def written() -> int:
        """Bytes of intermediate tables in the shared folder so far."""
        return sum(f.stat().st_size for f in Path(urlparse(shared_folder(spark)).path).rglob("*") if f.is_file())

    def once(name: str) -> tuple[float, float, int]:
        """Seconds to build the DataFrame, seconds of the action, bytes written on the way."""
        before, start = written(), time.perf_counter()
        df = CASES[name].run(spark, folder)
        built = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return built - start, time.perf_counter() - built, written() - before

    seconds, build, kept = {}, {}, {}
    for name in names:
        once(name)
        runs = [once(name) for _ in range(repeats)]
        seconds[name] = round(statistics.median(a + b for a, b, _ in runs), 3)
        build[name] = round(statistics.median(a for a, _, _ in runs), 3)
        kept[name] = runs[-1][2]
        print(f"{name} {seconds[name]} (build {build[name]}, written {kept[name]} bytes)", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm median", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cores": cores, "shuffle_partitions": cores,
        "repeats": repeats, "build": build, "bytes_written": kept}))
    spark.stop()


if __name__ == "__main__":
    main()
