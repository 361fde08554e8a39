"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
The documents are written anew as part files first, outside the timing, so that all cores have work.
Results go to the noop sink, so every output column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dotloom.plans import catalog  # noqa: E402
from dotloom.session import local_session  # noqa: E402

HEADLINE = [
    "brf_volume_by_language", "braille_strict", "braille_lenient", "converted_texts", "fix_encoding", "repair_documents",
    "top_keywords", "detected_languages", "readability", "block_structure_types", "typed_blocks",
    "pages_by_lines", "line_regions", "layout_blocks", "aligned_paragraphs", "equation_features",
    "dashboard_counts", "recent_documents", "search_library", "upsert_profiles",
]


def in_parts(spark, given: str, parts: int) -> str:
    """A folder like the given one, with documents as part files: one row group can only be read by one task."""
    folder = tempfile.mkdtemp(prefix="bench-", dir="/tmp")
    for table in Path(given).glob("*.parquet"):
        if table.name != "documents.parquet":
            os.symlink(table, f"{folder}/{table.name}")
    spark.read.parquet(f"{given}/documents.parquet").repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return folder


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    sf_dir = in_parts(spark, given, 4 * int(cpus))
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the executors
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if name not in catalog.queries:
            continue
        t0 = time.perf_counter()
        catalog.queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": given.rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
