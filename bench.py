"""Headline timings: builds and queries over one data folder, as one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factloom.plans import catalog  # noqa: E402
from factloom.session import local_session  # noqa: E402

# Shared tables are timed on their own, in the order they are needed.
BUILDS = ("documents", "graph", "flat_index", "guided_index", "seeds", "facts", "signals", "search")
QUERIES = (
    "sentence_split",
    "content_term_freq",
    "char_chunks",
    "entity_links_documents",
    "entity_links_sentences",
    "cooccurrence_edges",
    "simple_graph",
    "star_walk",
    "star_components",
    "triple_graph_edges",
    "tfidf_vectors",
    "flat_topk",
    "nearest_vectors",
    "doc_relevance",
    "source_votes",
    "graph_evidence",
    "benchmark_compare",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus)) if cpus != "*" else 8)
    bed = catalog.bed(spark, folder)
    bed.table("region").count()
    times: dict[str, float] = {}
    for name in BUILDS:
        started = time.perf_counter()
        getattr(bed, name)
        times[f"build_{name}"] = round(time.perf_counter() - started, 3)
    for name in QUERIES:
        started = time.perf_counter()
        catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
