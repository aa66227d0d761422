"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tagloom.queries import queries  # noqa: E402

HEADLINE = (
    "customer_profile",
    "user_profile",
    "basic_items_shared_scan",
    "basic_item_latest",
    "sql_item",
    "staging_shared",
    "method_grouped",
    "formula_chain",
    "formula_sum_mixed",
    "post_long_round",
    "save_update_existing",
    "two_pass_incremental",
    "code_decode_lines",
    "normalize_types",
    "row_positions",
    "runlog_messages",
    "category_preorder",
    "model_run",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="tagloom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tagloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("customer_profile")
    run("method_grouped")
    seconds = {name: round(min(run(name), run(name)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
