"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and is then timed to full materialisation. The total is
the sum of the timed runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "d2_block_contrasts",
    "d4_confidence_signal",
    "d9_auc_line_items",
    "d15_patch_summary",
    "d17_control_summary",
    "d18_condition_table",
    "c1_partner_pairs",
    "c3_crossed_donors",
    "c6_sweep_grid",
    "d14_mean_vectors",
    "e2_shuffle_rank",
    "e5_exact_terciles",
    "h2_normalize_entity",
    "h9_positions",
    "l1_split_exact",
    "l2_build_cells",
    "l3_measured_behavior",
    "v2_block_rules",
    "v3_split_leaks",
]


def main() -> None:
    from crossblock.plans.queries import REGISTRY
    from crossblock.session import session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = session(
        f"local[{cpus}]",
        "bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf.rsplit("sf", 1)[-1].strip("/"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
