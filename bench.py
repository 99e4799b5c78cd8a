"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from cardmill.plans import catalog
from cardmill.session import build_session

HEADLINE = [
    "index_postings",
    "lexical_bm25_topk",
    "vector_cosine_topk",
    "token_mean_vectors",
    "hybrid_search",
    "utility_rank",
    "phone_extract",
    "email_extract",
    "website_extract",
    "contact_validate",
    "classify_cues",
    "attribute_cues",
    "field_prf1",
    "engine_report",
    "first_of_key_pivot",
    "people_list",
    "person_subtitles",
    "undo_window_purge",
    "quantize_int8",
    "spatial_block_dedupe",
    "same_name_people",
    "extract_card_fields",
    "resolve_orgs",
    "resolve_people",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "cardmill-bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = catalog.queries()
    # One throw-away scan so that the first query does not pay for JVM start.
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        todo[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()
