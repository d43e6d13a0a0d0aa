"""An agent's context for a question: two flows of passages, what the code graph says of the symbols it names, and what supports what.

The three branches are told apart: each has a status, and an empty or missing one leaves the others as they are. Rows of all branches come back as one table:
query_id, branch (docs, code, graph), section, place, id, detail. docs and code are the k best passages each; graph has, for every entry point
of the question, the sections of its symbol. A passage of a file that defines one of the shown symbols is corroborated: its detail names them.

A question without words has no passages and no entry point; a graph that is None is unavailable; empty tables give empty results; extra columns are
ignored; repeated questions of one id count as one text each and share their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.operators import graph, lexical, retrieve


def flows(index: lexical.Index, entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, flow, rank, id, path: the k best entries (id, path, doc_type) of each type, by one scoring of all."""
    flow = F.when(F.col("doc_type") == "code", "code").otherwise("docs")
    own = entries.select("id", "path", flow.alias("flow"))
    rows = lexical.best(index, queries, k, own.select("id", "flow").distinct()).join(own, ["id", "flow"])
    return retrieve.per_flow(rows, F.col("flow"), k).select("query_id", "flow", "rank", "id", "path")


def context(index: lexical.Index, entries: DataFrame, queries: DataFrame, nodes: DataFrame | None, edges: DataFrame | None, k: int = 5, most: int = 3, least: int = 2) -> DataFrame:
    """query_id, branch, section, place, id, detail of questions (query_id, query) over entries (id, path, doc_type) and a graph (None: not there)."""
    spark = queries.sparkSession
    found = flows(index, entries, queries, k)
    if nodes is None or edges is None:
        sections = spark.createDataFrame([], "query_id long, symbol string, entry int, section string, place int, ref string, total long")
        names = spark.createDataFrame([], "query_id long, path string, name string")
    else:
        symbols = nodes.where("qualname is not null")
        points = graph.entry_points(queries, symbols.select("name"), most, least).select("query_id", F.col("place").alias("entry"), F.col("name").alias("symbol"))
        told = graph.context(nodes, edges, points.select(F.col("symbol").alias("name")).distinct()).withColumnRenamed("name", "symbol")
        sections = points.join(told, "symbol").select("query_id", "symbol", "entry", "section", "place", "ref", "total")
        names = points.join(symbols.select(F.col("name").alias("symbol"), "path"), "symbol").select("query_id", "path", F.col("symbol").alias("name"))
    support = names.groupBy("query_id", "path").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    passages = found.join(support, ["query_id", "path"], "left").select("query_id", F.col("flow").alias("branch"), F.lit("passages").alias("section"), F.col("rank").alias("place"), F.col("id").cast("string").alias("id"), F.coalesce("names", F.lit("")).alias("detail"))
    said = sections.select("query_id", F.lit("graph").alias("branch"), F.concat_ws(":", "symbol", "section").alias("section"), "place", F.col("ref").alias("id"), F.col("total").cast("string").alias("detail"))
    return passages.unionByName(said)


def status(queries: DataFrame, rows: DataFrame, points: DataFrame | None) -> DataFrame:
    """query_id, branch and status of the three branches: ok or empty; of the graph also unavailable (no graph, points None) and not_attempted (no entry point)."""
    every = queries.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, ("docs", "code", "graph")))).alias("branch"))
    n = rows.groupBy("query_id", "branch").agg(F.count("*").alias("n"))
    out = every.join(n, ["query_id", "branch"], "left").withColumn("plain", F.when(F.col("n") > 0, "ok").otherwise("empty"))
    if points is None:
        return out.select("query_id", "branch", F.when(F.col("branch") == "graph", "unavailable").otherwise(F.col("plain")).alias("status"))
    entered = points.select("query_id").distinct().withColumn("entered", F.lit(True))
    missing = (F.col("branch") == "graph") & F.col("entered").isNull()
    return out.join(entered, "query_id", "left").select("query_id", "branch", F.when(missing, "not_attempted").otherwise(F.col("plain")).alias("status"))
