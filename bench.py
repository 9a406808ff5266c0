"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

One warm-up run of every query first, then three timed runs per query; the result is forced with a
``noop`` write (every row computed, nothing collected). Prints one JSON
line: {"metric", "value" (sum of medians), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pnlbook.plans.catalog import QUERIES  # noqa: E402
from pnlbook.session import get_spark  # noqa: E402

HEADLINE = ["ingest_trades", "monthly_summary", "daily_summary", "stat_card", "account_stats",
            "month_stats", "equity_curve", "calendar_grid", "consistency", "csv_lines",
            "change_outcomes", "live_ledger", "stream_ledger"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                      extra={"spark.driver.memory": "8g"})
    def once(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in only:            # warm-up: every query once, before any timing
        once(name)
    times = {}
    for name in only:
        times[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    spark.stop()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
