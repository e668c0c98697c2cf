"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query runs once to
warm up, then its best of two runs counts; results go to Spark's no-op sink in full.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larder import plans  # noqa: E402
from larder.session import build_session  # noqa: E402

HEADLINES = [
    "recommend_batch", "recommend_qualify", "render_recipe_cards", "pivot_eav", "unpivot_nutrients",
    "incremental_append", "cap_per_group", "cap_per_group_exact", "alert_daily_summary",
    "alert_weekly_digest", "alert_critical_low", "dash_suggestions", "dash_consistency_matrix",
    "remaining_kcal", "user_tdee", "signup_validate", "chunk_documents", "truncate_budget",
    "concat_ordered", "vector_topk", "vector_topk_per_condition", "build_context",
    "facility_text_search", "facility_radius", "facility_with_fallback", "render_report",
    "news_latest", "drug_card", "chat_scratchpad", "stream_daily_summary",
]


def timed(function, spark, sf_dir) -> float:
    start = time.perf_counter()
    function(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.all_queries()
    seconds = {}
    for name in HEADLINES:
        first = timed(queries[name], spark, sf_dir)
        seconds[name] = round(min(timed(queries[name], spark, sf_dir) for _ in range(2)), 3)
        print(f"{name:32} cold {first:7.3f}  warm {seconds[name]:7.3f}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
