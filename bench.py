"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the local cores. Each query runs on cold
caches after one small warm-up query; a run includes its planning.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spotweave.plans import catalogue  # noqa: E402
from spotweave.session import build_session  # noqa: E402

HEADLINE = [
    "shared_features",
    "lognorm_all",
    "cluster_aggregates",
    "state_profiles_all_k",
    "agglomeration_cuts",
    "nearest_centroid",
    "cossim_per_gene",
    "cossim_medians",
    "knn_ref",
    "knn_query",
    "wann_vote",
    "wann_suppliers",
    "onehot_summary",
    "spatial_knn",
    "local_purity",
    "spatial_organisation",
    "reconstruction_null",
    "modularity",
    "merged_coherence",
    "pareto_front",
    "validate_counts",
    "grid_split",
    "renumber_ids",
    "hvg_topn",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    names = sys.argv[1:] or HEADLINE
    queries["next_id"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
