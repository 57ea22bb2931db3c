"""Benchmark: wall time of the headline queries at $BENCH_SF_DIR.

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is fully executed through the no-op sink (every column of every
row is computed; nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans.catalog import load_all  # noqa: E402
from tessera.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = build_session(f"local[{cpus}]", app="tessera-bench", shuffle_partitions=int(cpus) * 2)
    entries = load_all()
    names = [n for n, e in sorted(entries.items()) if e.bench]
    if os.environ.get("BENCH_ALL"):
        names = sorted(entries)
    # warm-up: JVM, parquet footers, Python workers
    entries[names[0]].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings, failed = {}, {}
    for n in names:
        t0 = time.perf_counter()
        try:
            entries[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings[n] = round(time.perf_counter() - t0, 3)
        except Exception as ex:  # noqa: BLE001
            failed[n] = str(ex)[:200]
    out = {"metric": "headline_queries_total_wall", "value": round(sum(timings.values()), 3),
           "unit": "sec", "queries": timings, "sf": sf, "cpus": int(cpus)}
    # model-quality figures comparable with the published ranking metrics
    # (computed after timing; small result: one row per model)
    try:
        q = {}
        for r in entries["v7_rank_metrics_als"].fn(spark, sf_dir).collect():
            for k in ("mrr", "hit_rate_at_10", "ndcg_at_10", "hit_rate_at_50", "hit_rate_at_100"):
                q[f"{r['model']}_{k}"] = round(r[k], 4)
        out["quality"] = q
    except Exception as ex:  # noqa: BLE001
        out["quality_error"] = str(ex)[:200]
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
