"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

With BENCH_DUCKDB=1 also duckdb: seconds of the same SQL in DuckDB with as many threads, median of two warm runs, results fetched as
Arrow; null where a query has no SQL, or where its three runs take more than DUCKDB_LIMIT seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "object_measures", "main_table", "nearest_row", "overlapping_crops", "neighbors_in_radius", "local_ripleys_k", "nearest_path_node", "mutual_nearest", "octave_mean_mouse", "sliding_density",
    "arc_length", "moving_average", "band_labels", "crop_thresholds", "consensus_scores", "label_overlap", "downsample_mean", "dilation", "block_percentiles", "density_counts",
]

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DUCKDB_LIMIT = 8.0


def duckdb_seconds(sql: dict[str, str], names: list[str], sf_dir: str, cpus: str) -> dict[str, float | None]:
    import duckdb

    con, out = duckdb.connect(), {}
    if cpus.isdigit():
        con.execute(f"SET threads = {cpus}")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in names:
        each = []
        stop = threading.Timer(DUCKDB_LIMIT, con.interrupt)
        stop.start()
        try:
            for _ in range(3 if name in sql else 0):
                began = time.perf_counter()
                con.execute(sql[name]).to_arrow_table()
                each.append(time.perf_counter() - began)
        except duckdb.InterruptException:
            pass
        finally:
            stop.cancel()
        out[name] = round(statistics.median(each[1:]), 3) if len(each) == 3 else None
    return out


def main() -> None:
    from orbweave.plans import catalog
    from orbweave.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(os.environ.get("BENCH_PARTITIONS", cpus if cpus.isdigit() else 8)), "12g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        each = []
        for _ in range(3):  # the first one compiles and is not counted
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(each[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    line = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}
    if os.environ.get("BENCH_DUCKDB") == "1":
        line["duckdb"] = duckdb_seconds(catalog.oracle_sql(), list(seconds), sf_dir, cpus)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
