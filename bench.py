"""Times the headline queries and prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Every query
runs whole: all rows and columns are computed and thrown away by the noop sink. The
first run of each warms the JVM; the best of the next two counts.
"""

from __future__ import annotations

import json
import os
import time

from checks.queries import QUERIES
from pulse import build_session

HEADLINE = [
    "ingest_events",
    "enrich_gkg",
    "country_topics",
    "top_countries_latest",
    "news_embeddings",
    "top_entities",
    "top_entities_from_feeds",
    "vector_topk",
    "similar_to_day_post",
    "analogs_flat",
    "theme_clean",
    "response_normalise",
    "score_parse",
    "daily_mood",
    "full_run",
    "country_day_stream",
]


def timed(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "pulse-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, sf_dir, name)
        seconds[name] = round(min(timed(spark, sf_dir, name) for _ in range(2)), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
