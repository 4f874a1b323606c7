"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line. Each query is executed in full through the ``noop``
sink (no collect), once to warm up and then ``BENCH_RUNS`` times; the median is
reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["brick", "sub_buckets", "dominant_flow", "vote_hitters", "vote_merged_majority", "top_hitters",
            "dense_brick", "decode_frames", "interval_rates"]
# run and reported beside the headline, outside its total (so that the total stays comparable)
MORE = ["vote_top_hitters", "read_captures", "offline_summary", "stream_bricks", "stream_vote"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from trafficbrick.session import get_session
    from trafficbrick.plans.catalog import QUERIES

    spark = get_session(f"local[{cpus}]", app="trafficbrick-bench", shuffle_partitions=max(8, cpus),
                        extra={"spark.driver.memory": "16g"})
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE + MORE)).split(",") if n]
    times, samples_all = {}, {}
    for name in names:
        samples = []
        for i in range(runs + 1 if name not in MORE else 2):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i:
                samples.append(dt)
        times[name] = round(statistics.median(samples), 3)
        samples_all[name] = [round(x, 2) for x in samples]
    packets = spark.read.parquet(os.path.join(sf_dir, "lineitem.parquet")).count()
    e2e = times.get("dense_brick")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_sec",
        "value": round(sum(t for n, t in times.items() if n not in MORE), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
        "packets": packets,
        "summary_packets_per_sec": round(packets / e2e, 1) if e2e else None,
        "spark": spark.version,
        "samples": samples_all,
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
