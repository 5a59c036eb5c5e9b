"""Survey tables stated as views over the star-schema tables, in SQL that Spark and DuckDB both read."""

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "cloud": """
        SELECT CASE WHEN l_linestatus='F' THEN 'ref' ELSE 'mobile' END AS cloud_id,
               l_orderkey*10 + l_linenumber AS pid,
               ((l_orderkey*7919 + l_linenumber*104729) % 100000)/1000.0e0 + 0.0005e0 AS s,
               1.5e0 + (CAST(round(l_extendedprice*100) AS BIGINT) % 100000)/200000.0e0 AS r,
               ((l_partkey*137 + l_suppkey*61 + l_linenumber*29 + CAST(l_quantity AS INT)*71) % 3600)/10.0e0 - 180.0e0 + 0.05e0 AS theta
        FROM {lineitem}""",
    "cloud_gappy": """
        SELECT * FROM {cloud}
        WHERE NOT (cloud_id='mobile' AND theta >= 80.0e0 AND theta < 130.0e0 AND s >= 20.0e0)
          AND NOT (s >= 50.0e0 AND s < 53.0e0 AND r < 1.99e0)""",
    "traj": """
        SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
               value/10.0e0 AS x, ((event_id*37) % 1000)/100.0e0 AS y, ((event_id*17) % 500)/100.0e0 AS z
        FROM {events}""",
    "reps": """
        SELECT o_custkey AS trial_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rep,
               CASE WHEN o_orderstatus='F' THEN NULL ELSE o_totalprice/10000.0e0 END AS error_m,
               o_orderstatus='F' AS failed, CASE WHEN o_orderstatus='F' THEN o_orderpriority ELSE '' END AS failure_reason
        FROM {orders}""",
    "runs": """
        SELECT concat('ds', CAST(l_suppkey % 4 AS VARCHAR(9))) AS dataset, concat('rep0', CAST(l_linenumber AS VARCHAR(9))) AS rep,
               l_shipdate AS stamp, l_orderkey AS run_no, CASE WHEN l_linestatus='F' THEN 'ref' ELSE 'mobile' END AS cloud_id,
               CASE l_returnflag WHEN 'A' THEN 'profiles' WHEN 'N' THEN 'surface_mesh' ELSE 'hull_bound' END AS method,
               1000.0e0 + l_extendedprice/1000.0e0 AS volume
        FROM {lineitem}""",
    "targets": """
        SELECT CAST(floor(vec_id/8.0e0) AS BIGINT) AS net, c.cloud_id, CAST(vec_id % 8 AS INT) AS idx, CAST(embedding[{zero}] AS DOUBLE)*100.0e0*c.k AS x,
               CAST(embedding[{zero}+1] AS DOUBLE)*100.0e0*c.k + c.o*label AS y, CAST(embedding[{zero}+2] AS DOUBLE)*100.0e0*c.k AS z
        FROM {embeddings} CROSS JOIN (SELECT 'ref' AS cloud_id, 1.0e0 AS k, 0.0e0 AS o UNION ALL SELECT 'mobile', 1.002e0, 0.01e0) c""",
}
_FROM = {"cloud": "lineitem", "cloud_gappy": "cloud", "traj": "events", "reps": "orders", "runs": "lineitem", "targets": "embeddings"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of sf_dir."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source = _FROM[name]
    return spark.sql(VIEWS[name].replace("{zero}", "0"), **{source: view(spark, sf_dir, source)})


def duckdb_with(*names: str) -> str:
    """The views as WITH items for DuckDB."""
    every = [n for n in VIEWS if n in names or (n == "cloud" and "cloud_gappy" in names)]
    return ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n].replace('{zero}', '1').replace('{' + _FROM[n] + '}', _FROM[n])})" for n in every)
