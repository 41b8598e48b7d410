"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores.  Each query is fully evaluated into
the ``noop`` sink: one warm-up, then the median of three runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowloom.plans.catalog import QUERIES  # noqa: E402
from flowloom.session import local_session  # noqa: E402

HEADLINE = {
    "flow_features": "events",
    "flow_features_bidirectional": "events",
    "packet_gaps": "events",
    "record_dead_letter": "events",
    "scaler_apply": "lineitem",
    "class_probabilities": "events",
    "first_n_anomalies": "events",
    "row_ids": "events",
    "topk_search": "embeddings",
    "explain_anomaly": "events",
}
RUNS = 3


def shuffle_bytes(spark) -> int:
    """Bytes written to shuffles so far, as the session's own status store counts them."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(
        None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None
    )
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cpus, **{"spark.driver.memory": "8g"})
    times, detail = {}, {}
    for name, source in HEADLINE.items():
        rows = spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
        runs, written = [], 0
        for attempt in range(RUNS + 1):
            before = shuffle_bytes(spark)
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            written = shuffle_bytes(spark) - before
        median = statistics.median(runs[1:])
        times[name] = round(median, 3)
        detail[name] = {
            "rows_in": rows,
            "rows_per_sec": round(rows / median),
            "shuffle_bytes": written,
        }
    print(
        json.dumps(
            {
                "metric": "headline query time, median of 3 after warm-up, summed",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus) if cpus.isdigit() else cpus,
                "detail": detail,
            }
        )
    )


if __name__ == "__main__":
    main()
