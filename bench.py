"""Times headline queries and three micro-benchmarks; prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8); BENCH_RUNS: runs of the
micro-benchmarks (default 5); BENCH_QUERIES: names, comma-separated.

`queries`: seconds of one run each, table building included, in a warm session. `micro`: medians of warm runs, the first
run apart as cold. Nothing is compared with another engine: no figures for one exist.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = [
    "append_basic",
    "append_parallel",
    "partitioned_write",
    "filter_range",
    "filter_range_multi",
    "time_travel_version",
    "delete_where",
    "upsert",
    "merge_conditional",
    "optimize_compact",
    "zorder_preserves_rows",
    "checkpoint_equivalence",
    "evolve_rename",
    "evolve_drop",
    "incremental_append",
    "stream_available_now",
    "sql_view_join",
    "sql_view_agg",
    "sql_view_window",
]


def seconds(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def cold_and_warm(f, runs: int) -> dict[str, float]:
    first = seconds(f)
    return {"cold_sec": round(first, 4), "warm_sec": round(statistics.median(seconds(f) for _ in range(runs)), 4)}


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def micro(spark: SparkSession, runs: int, folder: str) -> dict:
    """Metadata discovery, data skipping and Z-ordering, over a table of 100 files with 1,000 rows each."""
    from lakewright import VersionedTable

    table = VersionedTable(spark, f"{folder}/skipping")
    rows = spark.range(100_000).select("id", (F.col("id") * 0.5).alias("value"), (F.col("id") % 10).cast("int").alias("bucket"))
    generation = seconds(lambda: table.append(rows.repartitionByRange(100, "id")))
    fresh = lambda: VersionedTable(spark, f"{folder}/skipping")
    active, hit = table.snapshot().file_count, len(table.candidates({"id": (0, 9)}))
    out = {
        "generation_sec": round(generation, 3),
        "metadata_discovery": {
            "directory_listing": cold_and_warm(lambda: table.storage.files("data"), runs),
            "snapshot_reopened": cold_and_warm(lambda: fresh().snapshot(), runs),
        },
        "data_skipping": {
            "full_scan": cold_and_warm(lambda: noop(fresh().read(filter="id BETWEEN 0 AND 9")), runs),
            "skipping": cold_and_warm(lambda: noop(fresh().read(where={"id": (0, 9)})), runs),
            "files_read": hit,
            "files_active": active,
            "files_skipped_pct": round(100 * (1 - hit / active), 2),
        },
    }
    seed = 20260905
    flows = spark.range(100_000).select(
        (F.rand(seed) * (2**32)).cast("long").alias("source_ip"),
        (F.rand(seed + 1) * 65536).cast("int").alias("source_port"),
        (F.rand(seed + 2) * (2**32)).cast("long").alias("dest_ip"),
        (F.rand(seed + 3) * 65536).cast("int").alias("dest_port"),
        "id",
    )
    columns = flows.columns[:4]
    skipped = {}
    for layout in ("global_sort", "z_order"):
        t = VersionedTable(spark, f"{folder}/{layout}")
        if layout == "global_sort":
            t.append(flows.repartitionByRange(100, *columns).sortWithinPartitions(*columns))
        else:
            t.append(flows.repartition(100))
            t.optimize_z_order(*columns)
        probe = flows.where("id = 0").first()
        pct = {c: 100 * (1 - len(t.candidates({c: (probe[c], probe[c])})) / t.snapshot().file_count) for c in columns}
        skipped[layout] = {c: round(v, 2) for c, v in pct.items()} | {"average": round(sum(pct.values()) / 4, 2)}
    return out | {"z_ordering_skipped_pct": skipped}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "5")))
    sys.path.insert(0, str(Path(__file__).resolve().parent))
    from lakewright.queries import QUERIES

    with tempfile.TemporaryDirectory(prefix="lakewright-bench-") as folder:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .appName("lakewright-bench")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
            .config("spark.checkpoint.dir", f"file://{folder}/shared")
            .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        noop(QUERIES["scan_current"](spark, sf_dir))  # starts Python workers and compiles what all queries share
        times, failed = {}, {}
        for name in [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE:
            try:
                times[name] = round(seconds(lambda n=name: noop(QUERIES[n](spark, sf_dir))), 3)
            except Exception as e:  # noqa: BLE001 one query must not hide the others
                failed[name] = str(e)[:200]
        try:
            small = micro(spark, runs, f"{folder}/micro")
        except Exception as e:  # noqa: BLE001
            small, failed["micro"] = {}, str(e)[:200]
        spark.stop()
    line = {"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "micro": small}
    print(json.dumps(line | ({"failed": failed} if failed else {})), flush=True)


if __name__ == "__main__":
    main()
