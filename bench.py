"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402

HEADLINES = [
    "normalized_vendor_lines", "filtered_events", "text_search", "event_timeline", "shipment_timeline", "event_sentences",
    "node_aggregate", "link_aggregate", "node_risk", "merged_links", "node_roles", "node_neighborhood", "kill_chain_levels",
    "node_communities", "tool_sightings", "behaviour_hits", "stage_ladder", "group_attribution", "report_narrative",
    "entity_story", "indicators", "trade_links", "trade_degrees", "trade_communities",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    chosen = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in chosen:
        begin = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale[1]) if scale else sf_dir}))


if __name__ == "__main__":
    main()
