"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from voxfare.plans import catalog
from voxfare.session import build_session

HEADLINE = (
    "yearly_rating_story", "year_cabin_pivot", "seasonality_quarter_pivot", "cabin_scorecard", "band_scores",
    "segment_vs_rest", "mix_share_by_year", "market_stats_having", "route_top_bottom", "top_aircraft_pivot",
    "sentinel_sparsity", "kpi_row", "sentiment_index", "advocacy_gap", "yoy_change", "dedupe_keep_first",
    "keyword_explode_rank", "keyword_combined", "top_complaints", "theme_summary_sets", "monthly_summary",
    "word_weights", "cluster_terms", "json_extract_flatten", "stratified_sample", "html_cards",
    "five_number", "ecdf_open_metric", "kde_grid", "corr_matrix", "linreg",
    "ab_ttest", "ab_subgroups", "ab_mannwhitney", "ab_mannwhitney_open", "ab_chi2_yates", "ab_balance",
    "cluster_summary", "stratified_split", "roc_auc", "confusion", "stream_daily",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans = catalog.queries()
    only = sys.argv[1:] or HEADLINE
    plans["year_frequency"](spark, sf_dir).collect()  # start the workers of the session
    times: dict[str, float] = {}
    for name in only:
        start = time.perf_counter()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total seconds over the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
