"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores of the local session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailbench.catalog import fixtures as fx
from mailbench.catalog.queries import QUERIES
from mailbench.session import build_session

HEADLINE = (
    "model_metrics", "detailed_results", "score_all_documents", "score_batch_udf", "benchmark_detailed",
    "vote_counts", "sample_rows", "limit_first", "head_by_class", "softmax_decide",
    "validate_llm", "llm_bulk_v1", "llm_bulk_v2", "benchmark_llm", "compare",
    "read_csv_roundtrip", "read_json_roundtrip", "stream_scoring", "benchmark_archive",
)
# Queries that read other rows than the labelled e-mails.
READS = {"score_all_documents": "documents", "validate_llm": "documents", "benchmark_archive": "documents",
         "model_metrics": "documents", "detailed_results": "documents", "benchmark_detailed": "documents",
         "softmax_decide": "embeddings"}
ROUNDS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "mailbench-bench",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__log__level="ERROR",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query's cost
    # Best of several rounds over all queries: the first one mostly compiles.
    seconds: dict[str, float] = {}
    for _ in range(ROUNDS):
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = round(time.perf_counter() - start, 3)
            seconds[name] = min(took, seconds.get(name, took))
    rows = {name: fx.table(spark, sf_dir, name).count() for name in ("documents", "embeddings")}
    rows["emails"] = fx.emails(spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "rows": rows,
        "rows_per_sec": {name: round(rows[READS.get(name, "emails")] / took) for name, took in seconds.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
