"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query runs once to warm up and then twice; the better run counts (the
median of the timed runs is kept beside it). Rows go to the noop sink, so the
time is the query's own. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from loomstat.registry import all_queries
from loomstat.session import build_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "A01_topical_word_count",
    "A01_group_sum",
    "A09_rollup_events",
    "A10_rollup_levels",
    "A12_ordered_group_reducer",
    "A13_collocation_counts",
    "A18_percentile",
    "J01_cogroup_in_order",
    "J02_url_resolution",
    "J03_fan_out_with_array",
    "J10_co_rated_pairs",
    "J11_regex_rules",
    "J12_overlap_join",
    "M02_naive_bayes_classify",
    "M05_bm25_scores_ranked",
    "M06_nearest_years",
    "M07_dictionary",
    "M13_collocations",
    "M14_document_classifier",
    "M19_item_similarity",
    "M19_similar_to_asked_items",
    "S01_delimited_lines_to_rows",
    "S14_delimited_write_and_read",
    "W01_moving_average",
    "W02_share_of_group_total",
    "W03_top_hashtags",
    "W06_rank_with_ties",
    "C02_many_checks",
    "F04_rollup_reducer",
    "A20_trend",
    "J01_cogroup_reducer",
    "J01_cogroup_states",
]


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    best, median = {}, {}
    for name in names:
        times = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        best[name], median[name] = round(min(times), 3), round(statistics.median(times), 3)
        print(name, best[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, best warm run, summed",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "median": median,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
