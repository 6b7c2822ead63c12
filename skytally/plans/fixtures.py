"""The domain relations over the driver's tables, for Spark and, in the same words, for the SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables and relations it reads, SQL that both engines run)
RELATIONS = {
    "images": (
        ["orders"],
        """SELECT o_orderkey AS image_id, concat('img_', cast(o_orderkey AS string), '.jpg') AS file_name,
       CASE WHEN o_custkey % 3 = 0 THEN 4000 WHEN o_custkey % 3 = 1 THEN 5472 ELSE 8192 END AS width,
       CASE WHEN o_custkey % 3 = 0 THEN 3000 WHEN o_custkey % 3 = 1 THEN 3648 ELSE 5460 END AS height,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE -24e0 + cast(o_orderkey % 211 AS double) * 0.0004e0 END AS latitude,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 31.5e0 + cast((o_orderkey * 7) % 223 AS double) * 0.0004e0 END AS longitude,
       CASE WHEN o_orderkey % 13 = 0 THEN 0e0 ELSE 120e0 + cast(o_custkey % 80 AS double) END AS altitude,
       o_orderpriority AS camp_id, o_orderstatus AS dataset, o_orderdate AS ts FROM orders""",
    ),
    "detections": (
        ["lineitem", "part"],
        """SELECT image_id, image_id * 100 + pos AS det_key, pos, x1, y1, x1 + bw AS x2, y1 + bh AS y2, confidence, class_name, supercategory
FROM (SELECT l_orderkey AS image_id,
             cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS bigint) AS pos,
             (l_partkey * 37 + l_linenumber * 101) % 3600 AS x1, (l_suppkey * 53 + l_linenumber * 67) % 2700 AS y1,
             16 + cast(l_quantity AS bigint) * 4 AS bw, 16 + cast(l_quantity AS bigint) * 3 AS bh,
             round(1e0 - l_discount * 5e0, 4) AS confidence, p_type AS class_name, p_brand AS supercategory
      FROM lineitem JOIN part ON l_partkey = p_partkey) s""",
    ),
    "annotations": (
        ["detections"],
        "SELECT det_key AS id, image_id, class_name, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area, CASE WHEN pos % 5 = 0 THEN 2 ELSE 0 END AS iscrowd FROM detections",
    ),
    "gt_pred": (
        ["detections"],
        """SELECT 'gt' AS role, image_id, det_key, x1, y1, x2, y2, 1e0 AS score, class_name FROM detections WHERE image_id % 11 <> 0
UNION ALL
SELECT 'pred', image_id, det_key, x1 + (pos * 7) % 11 - 5, y1 + (pos * 5) % 9 - 4, x2 + (pos * 7) % 11 - 5, y2 + (pos * 5) % 9 - 4, confidence, class_name
FROM detections WHERE (image_id + pos) % 6 <> 0""",
    ),
    "dense": (
        ["detections"],
        "SELECT image_id, det_key, pos, x1 % 240 AS x1, y1 % 180 AS y1, x1 % 240 + (x2 - x1) AS x2, y1 % 180 + (y2 - y1) AS y2, confidence, class_name, supercategory FROM detections",
    ),
    "categories": (["part"], "SELECT cast(row_number() OVER (ORDER BY p_type) AS bigint) AS category_id, p_type AS class_name FROM (SELECT DISTINCT p_type FROM part) s"),
}


def needed(*names: str) -> list[str]:
    """The relations that names rest on, in an order in which each follows what it reads."""
    out: list[str] = []
    for name in names:
        for x in [*needed(*[r for r in RELATIONS[name][0] if r in RELATIONS]), name]:
            if x not in out:
                out.append(x)
    return out


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain relation, or a driver table."""
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, sql = RELATIONS[name]
    return spark.sql(sql.replace("FROM lineitem JOIN part", "FROM {lineitem} JOIN {part}") if "lineitem" in reads else sql.replace(f"FROM {reads[0]}", "FROM {" + reads[0] + "}"), **{r: relation(spark, sf_dir, r) for r in reads})


def oracle(sql: str, *names: str) -> str:
    """sql with the relations it reads before it."""
    parts = [f"{n} AS ({RELATIONS[n][1]})" for n in needed(*names)]
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*parts, sql[15:]])
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*parts, sql[5:]])
    return "WITH " + ",\n".join(parts) + "\n" + sql
