"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from clearcharge.registry import all_queries
from clearcharge.session import build_session

HEADLINE = (
    "S1_F1_W4_read_csv_wide", "S2_W5_read_csv_tall", "S3_read_json", "J2_J3_F4_charge_lines", "D1_summarise", "D2_J6_pairs",
    "J7_W1_nearest_hospitals", "D4_D5_resolve", "D6_J8_W6_match_entry", "J4_W3_latest_extraction", "D11_W8_scan_plan",
    "J14_Q2_A12_fidelity", "S10_W7_parse_index", "S19_F13_F14_extract_links", "A18_price_relations", "R9_progress_rates",
    "D14_D13_D15_prices",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else None, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        all_queries()[0][name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
