"""Time the registered queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES, a comma list of names (default: the headline queries; `all` for every one).
Each query is planned and run once to the end, after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from metframe.catalog import all_queries
from metframe.session import build_session, drop_stages

HEADLINE = [
    "pair_filter_all", "pair_filter_pressure_gt", "pair_filter_mixed", "grouped_view", "export_grouped",
    "facet_system_subdivisions", "system_level_subdivisions", "legacy_with_systems", "export_wide",
    "clause_split", "bulletin_dates", "levels_and_heights", "parse_sentence", "context_carry", "mentions",
    "bulletin_entities", "region_to_subdivisions", "resolve_regions", "dedup_merge", "enriched_rows",
    "star_systems", "star_system_subdivisions", "flat_reload_strict", "update_by_id", "bulletin_extract",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    queries = all_queries()
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "metframe-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__driver__host="127.0.0.1", spark__driver__bindAddress="127.0.0.1",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries["pair_filter_single"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "total wall-clock of the headline queries" if not chosen else "total wall-clock",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    drop_stages(spark)
    spark.stop()


if __name__ == "__main__":
    main()
