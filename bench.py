"""Time the headline queries on the provided tables; print one JSON line.

BENCH_SF_DIR names the folder, BENCH_CPUS the local cores, BENCH_QUERIES an
optional comma-separated list of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "dense_topk", "bm25_topk", "hybrid_topk", "mmr_select", "rerank_order", "search",
    "ranking_metrics", "eval_report", "sanitize_chunk", "token_estimate", "strip_markup",
    "prep_docs", "license_findings", "license_summary", "chunk_segments", "chunk_markdown",
    "page_reassemble", "content_sha256", "latency_summary", "suite_composition",
    "chunk_contract_violations", "docset_updates",
)


def main() -> None:
    from quillsift.plans.registry import QUERIES
    from quillsift.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = tuple(n for n in wanted.split(",") if n) or HEADLINE
    spark = build_session(
        "quillsift-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.log.level": "ERROR",
        },
    )
    # Start the JVM's and the Python workers' code paths before timing.
    QUERIES["row_count"](spark, folder).collect()
    spark.range(8).mapInArrow(lambda batches: batches, "id long").collect()
    times: dict[str, float] = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
