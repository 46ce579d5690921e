"""Time the headline queries; prints one JSON line.

Each query is run to its last row into a sink that discards it: once to warm up,
then ``BENCH_RUNS`` times, of which the median counts. Building the plan, with the
small jobs that check facet and lexicon sizes, is part of the time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lumenfold.catalog.queries import QUERIES  # noqa: E402
from lumenfold.session import build_session  # noqa: E402

HEADLINE = [
    "tx_clean",
    "tx_polarity",
    "swot_articles",
    "pestle_articles",
    "swot_posts",
    "swot_tweets",
    "em_plot_table",
    "tweets_hashtag_table",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
