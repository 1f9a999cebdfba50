"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (runs per query, the
fastest counts). The tables of a scale factor are single files of one row group, which one task would
read; before timing they are written once as one file per core, as a large table would be stored.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from corpuslens.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "preview_corpus detect_kind registry_report text_or_hex strip_tags html_to_text xml_text_nodes "
    "truncate_chars split_pages notebook_cells join_slides printable_runs email_fields number_lines "
    "sanitize wrap_lines paginate hex_dump json_canonical ini_rows md_lines md_headings "
    "md_code_blocks md_tables md_lists md_inline_text head_rows stringify tsv_lines head_per_group "
    "schema_report build_nodes list_limit preorder render_tree read_lines read_delimited "
    "archive_manifest docx_paragraphs write_previews"
).split()


def spread_tables(spark: SparkSession, sf_dir: str, files: int) -> str:
    """A copy of the tables in ``files`` files each."""
    copy = tempfile.mkdtemp(prefix="corpuslens-bench-")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        spark.read.parquet(str(path)).repartition(files).write.parquet(f"{copy}/{path.name}")
    return copy


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("corpuslens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = spread_tables(spark, sf_dir, spark.sparkContext.defaultParallelism)
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
