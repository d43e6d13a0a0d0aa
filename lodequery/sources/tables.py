"""Reading tables and what the queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a telemetry log: operations by event type, counters from the properties."""
    k = F.get_json_object("props", "$.k").cast("long")
    names = {"view": "retrieve", "error": "embeddings_error", "purchase": "embeddings", "signup": "index", "click": "embeddings_cache"}
    operation = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", operation.alias("operation"), F.col("value").alias("elapsed_ms"), (k % 10).alias("hits"), (k % 7).alias("misses"),
        F.when(k % 11 != 0, k).alias("tokens"), (k % 5 + 1).alias("texts"), F.concat(F.lit("p"), k % 3).alias("provider"), k.alias("documents"), (3 * k).alias("chunks"),
    )


TELEMETRY_SQL = """
ev AS (SELECT event_id, ts, value AS elapsed_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CASE event_type WHEN 'view' THEN 'retrieve' WHEN 'error' THEN 'embeddings_error' WHEN 'purchase' THEN 'embeddings'
  WHEN 'signup' THEN 'index' WHEN 'click' THEN 'embeddings_cache' END AS operation FROM events),
tel AS (SELECT event_id, ts, operation, elapsed_ms, k % 10 AS hits, k % 7 AS misses, CASE WHEN k % 11 <> 0 THEN k END AS tokens,
  k % 5 + 1 AS texts, 'p' || (k % 3) AS provider, k AS documents, 3 * k AS chunks FROM ev)
"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers and parts as symbols of a graph, regions and nations as modules around them, documents beside it."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, id_, kind, name, path: df.select(id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), F.lit(1).alias("line"), name.alias("qualname"))
    c = F.col
    nodes = node(t("nation"), F.concat(F.lit("n"), c("n_nationkey")), "class", c("n_name"), F.concat(F.lit("r/"), c("n_regionkey")))
    nodes = nodes.unionByName(node(t("supplier"), F.concat(F.lit("s"), c("s_suppkey")), "function", c("s_name"), F.concat(F.lit("n/"), c("s_nationkey"))))
    nodes = nodes.unionByName(node(t("part"), F.concat(F.lit("p"), c("p_partkey")), "method", c("p_name"), F.concat(F.lit("b/"), c("p_brand"))))
    calls = t("lineitem").select(F.concat(F.lit("s"), c("l_suppkey")).alias("source"), F.concat(F.lit("p"), c("l_partkey")).alias("target"), F.lit("calls").alias("type")).distinct()
    contains = t("supplier").select(F.concat(F.lit("n"), c("s_nationkey")).alias("source"), F.concat(F.lit("s"), c("s_suppkey")).alias("target"), F.lit("contains").alias("type"))
    return nodes, calls.unionByName(contains)


GRAPH_SQL = """
nodes AS (SELECT 'n' || n_nationkey AS id, 'class' AS kind, n_name AS name, 'r/' || n_regionkey AS path, 1 AS line FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'function', s_name, 'n/' || s_nationkey, 1 FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'method', p_name, 'b/' || p_brand, 1 FROM part),
edges AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, 'calls' AS type FROM lineitem
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'contains' FROM supplier)
"""
