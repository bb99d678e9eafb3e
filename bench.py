"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.catalog import QUERIES  # noqa: E402
from millrace.session import get_session  # noqa: E402

HEADLINE = [
    "map01_fields", "fil17_all_of", "enr02_lookup", "joi01_recent_executions", "joi02_tolerance", "joi04_inner",
    "joi06_denormalize", "agg01_rules_by_group", "agg07_median", "agg16_task_rollup", "agg17_top_k", "agg20_latest_per_key",
    "win01_row_number", "win03_keep_last", "win05_trailing_points", "win05_trailing_seconds", "win06_average_rank",
    "ded01_exact", "ded02_fuzzy", "ded04_composite", "cln02_remove_duplicates", "val07_report", "val09_schema_check",
    "pro09_numeric_stats", "pro10_percentiles", "pro17_outliers_iqr", "pro22_correlations", "pro24_recommendations",
    "smp01_random", "smp02_systematic", "nrm02_z_score", "nrm06_robust_scale", "qua08_score", "qua11_builtin_rules",
    "qua13_feature_row", "qua18_column_entropy", "tsa07_window_avg_alerts", "tsa09_alert_episodes", "tsa16_baseline",
    "tsa20_ema_baseline", "tsa29_forecast_linear", "tsa33_autocorrelation", "sta01_describe_groups", "sta02_mann_whitney",
    "prv02_redact", "prv03_detect_leaks", "prv21_mutual_information", "lin02_downstream", "vec01_knn", "sql01_query",
    "pip03_generic_rules", "snk05_upsert", "str14_tumbling", "str16_sessions", "str05_drain",
    "str09_stream_ema", "str10_stream_episodes", "lin08_find_cycles", "tsa21_ema_anomaly", "sta13_ratio_matrix", "nrm07_tfidf",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="millrace-bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["agg03_sum"](spark, folder).collect()  # start-up is not part of any query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
