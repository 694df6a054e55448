"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

import query_catalog
from themeloom.session import local_session
from themeloom.staging import drop_staged

HEADLINE = (
    "content_tokens",
    "lemma_stop_words",
    "text_chunks",
    "top_tokens",
    "document_frequency",
    "dictionary",
    "bag_of_words",
    "phrase_scores",
    "merged_trigrams",
    "prepared_documents",
    "corpus_dictionary",
    "prepared_chunks",
    "index_map",
    "wide_assignments",
    "silhouette",
    "davies_bouldin",
    "calinski_harabasz",
    "topic_coherence",
    "relevant_terms",
    "topic_distances",
    "model_fit",
    "model_saved",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    n_docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    query_catalog.QUERIES["top_tokens"](spark, folder).collect()  # warm the JVM once
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        query_catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    drop_staged(spark)
    total = sum(seconds.values())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "docs_per_sec_prepared": round(n_docs / seconds["prepared_documents"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
