"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (8).
Every query runs to completion into the no-op sink, after one untimed start-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexiloom.plans import catalog  # noqa: E402
from lexiloom.session import local_session  # noqa: E402

HEADLINE = (
    "prepared_dataset", "split_exact_groups", "sample_per_category", "hash_sample_job",
    "term_frequencies", "tfidf_weights", "keywords_per_category", "mean_pooled_documents",
    "nearest_vectors", "purity_of_all_rows", "retrieval_scores", "centroid_similarity",
    "classification_scores", "unified_comparison", "first_of_duplicates", "numeric_description",
    "kmeans_on_vectors", "isolation_outliers", "logistic_probe",
)
# Timed too, but not part of the total, which stays comparable from round to round.
FURTHER = ("nearest_vectors_partitioned", "mean_pooled_documents_by_join")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, partitions)
    queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("value_counts")
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    further = {name: round(run(name), 3) for name in FURTHER}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds | further, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
