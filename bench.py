"""Time the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from functools import reduce
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

QUERIES = (
    "filter_predicate", "sort_topk", "skip_take", "unique_first", "duplicate_rows", "normalize_zscore", "fill_forward", "text_scores", "column_profile", "quartiles_outliers", "imbalance_metrics", "oversample", "split_positional", "drift_ks", "drift_psi", "ddsketch_quantiles", "contamination", "prepare_corpus", "sample_fraction_rows", "tdigest_ranks", "chunked_rows", "chunk_scan", "ipc_round_trip", "loader_parallel",
)


COPIES = 40


def main() -> None:
    from pyspark.sql import DataFrame, SparkSession

    from sparkprep.operators import rows
    from sparkprep.plans import catalogue

    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("filter_predicate", "mapped_batches"):  # the session and its Python workers warm up
        catalogue.QUERIES[name](spark, folder).count()
    times, rates = {}, {}
    # A table that is long enough for a rate: copies of lineitem, written once; a warm scan, then the median of three, of compressed bytes, all columns.
    with tempfile.TemporaryDirectory() as scratch:
        items = spark.read.parquet(f"{folder}/lineitem.parquet")
        reduce(DataFrame.unionByName, [items] * COPIES).write.parquet(f"file://{scratch}/wide")
        size, scans = sum(f.stat().st_size for f in Path(scratch).rglob("*.parquet")), []
        for _ in range(4):
            began = time.perf_counter()
            spark.read.parquet(f"file://{scratch}/wide").write.format("noop").mode("overwrite").save()
            scans.append(time.perf_counter() - began)
        rates["parquet_scan_gb_s"], rates["parquet_scan_gb"] = round(size / 1e9 / statistics.median(scans[1:]), 3), round(size / 1e9, 3)
    began = time.perf_counter()
    rows.shuffle(7, "id")(spark.range(1_000_000)).write.format("noop").mode("overwrite").save()
    times["shuffle_1m_rows"] = round(time.perf_counter() - began, 3)
    for name in QUERIES:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rates": rates, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
