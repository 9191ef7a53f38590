"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Every query is planned
and run in full; its rows go to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postpulse.plans.catalog import QUERIES  # noqa: E402
from postpulse.session import build_session  # noqa: E402

HEADLINE = (
    "agg_crisis_score", "agg_kpi_row", "agg_hourly_volume", "agg_sentiment_share",
    "top_hashtags", "agg_top_users", "agg_influencers", "agg_word_freq", "agg_word_bigrams",
    "agg_entity_counts", "jn_geocode", "jn_latest_run", "win_topic_runs", "win_dedupe_user",
    "src_api_filter", "snk_report_json", "st_hourly_volume",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    for name in ("agg_kpi_row", "win_topic_runs"):  # start JVM and Python workers; not counted
        run(name)
    times = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
