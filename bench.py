"""Times the headline queries, and beside them the same SQL in DuckDB; prints one JSON line."""

import glob
import json
import os
import statistics
import threading
import time

import duckdb

from skytally.plans import registry
from skytally.session import local_session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "a01_a02_class_confidence", "p14_p15_gsd_and_utm", "p21_detection_gps", "f07_coco_reasons", "j01_j04_k08_coco_rows", "j07_p37_f13_tile_annotations", "j08_overlap_edges", "j10_w03_match", "w01_flight_path", "w02_nms", "w06_first_of_equal_boxes",
    "w09_c12_rebalance", "g01_s09_tile_grid", "c04_c06_group_split", "u02_w06_merge_datasets", "a13_a36_dataset_info", "a33_label_pivot",
]


def in_duckdb(cpus: int, most: float = 60.0) -> dict[str, float | None]:
    """Seconds of the same queries' SQL in DuckDB over the same files with as many threads; none where it takes longer than most."""
    con = duckdb.connect()
    con.sql(f"SET threads = {cpus}")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    took: dict[str, float | None] = {}
    for name in HEADLINE:
        stop = threading.Timer(most, con.interrupt)
        stop.start()
        began = time.time()
        try:
            con.execute(registry.SQL[name]).fetch_arrow_table()
            took[name] = round(time.time() - began, 3)
        except duckdb.InterruptException:
            took[name] = None
        finally:
            stop.cancel()
    return took


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, 2 * cpus, "16g")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES[HEADLINE[0]](spark, SF).write.format("noop").mode("overwrite").save()  # starts the session
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            began = time.time()
            registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "median": round(statistics.median(took.values()), 3), "duckdb": in_duckdb(cpus) if os.environ.get("BENCH_DUCKDB", "1") == "1" else {}, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
