"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagestream.session import build_session  # noqa: E402
from workload.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "parse_views top_resource view_window_sum top_resource_sliding event_top_categories "
    "event_wikitype event_wikitype_distinct change_event_parse json_concat_scan category_enrich "
    "edit_lines result_top_n result_share latest_events page_main_category view_enrich "
    "expand_views expand_views_sorted csv_roundtrip gzip_scan tail_lines "
    "top_resource_stream top_resource_bounded_stream top_resource_sliding_stream "
    "top_resource_sliding_bounded_stream top_resource_latest_windows "
    "event_top_categories_stream event_wikitype_stream edit_lines_stream result_view_stream "
    "result_view_latest_stream "
    "latest_events_stream replay_stream"
).split()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
