"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pressmark.plans import model_queries, queries as q  # noqa: E402
from pressmark.plans.staging import release  # noqa: E402
from pressmark.session import build_session  # noqa: E402

HEADLINE = [
    "clean_ocr", "style_basic", "stop_words", "labelled_line_parse", "duplicate_texts", "label_by_year",
    "kfold", "term_df", "tfidf_weights", "tfidf_scaled", "linguistic", "sentiment", "cache_misses",
    "nb_predict", "nb_cv_metrics", "bulk_score", "pipeline_metrics", "agreement_sets", "majority_vote",
    "nb_grid", "nb_cv_scaled", "text_svm_predict",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    registered = {**q.registered(), **model_queries.registered()}
    chosen = sys.argv[1:] or HEADLINE
    registered["corpus_size"](spark, sf).collect()  # start the executors' threads
    times = {}
    for name in chosen:
        start = time.time()
        registered[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        release()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
