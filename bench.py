"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query's whole result is computed; nothing is cached between queries but the landed
loan table, which is timed on its own as ``land_loans``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom.plans import QUERIES  # noqa: E402
from riskloom.session import local_session  # noqa: E402
from riskloom.sources.tables import loans, loans_dirty  # noqa: E402

HEADLINE = [
    "e19_portfolio_by_purpose", "e7_approval_terms", "e18_risk_score", "a1_csv_scan", "a2_bundle_round_trip",
    "b6_classify_lineitem", "c9_valid_rows", "c9_row_violations", "c11_upload_report", "c14_zero_audit_lineitem",
    "c16_impute", "d2_safe_divide_zero", "d8_polynomial_lineitem", "d10_one_hot_loans", "d12_types_lineitem",
    "d17_fit_train_transform_all", "f1_describe_lineitem", "f4_pearson_loans", "f5_spearman_lineitem",
    "f6_association_auto", "f8_profile_loans", "f9_frequent_part", "f10_duplicate_rows", "f11_histogram_scores",
    "g1_train_test", "g4_sample_rows", "g7_split_stats", "m5_metrics_by_segment", "m7_qq_line", "m10_rank_models",
    "m21_what_if_debt", "m17_batch_scoring", "s1_stream_scoring", "s2_stream_quality",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.time()
        run()
        seconds[name] = round(time.time() - start, 3)

    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start-up is not a query
    timed("land_loans", lambda: (loans(spark, sf_dir), loans_dirty(spark, sf_dir)))
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf_dir.rsplit("sf", 1)[-1]),
            }
        )
    )


if __name__ == "__main__":
    main()
