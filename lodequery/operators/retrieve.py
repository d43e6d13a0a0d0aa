"""Dense retrieval, rank fusion, thresholds, near-duplicate removal and the hybrid pipeline, for batches of queries.

Ranked rows are (query_id, id, score, rank); equal scores fall to the smaller id; a query without rows is not in a result; null ids are ids like others;
empty tables give empty results; extra columns are ignored unless said.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.text import containment, shingles
from lodequery.operators.lexical import ranked


def dense(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", query_block: int = 1024, page: int = 8192, digits: int = 9, most_tasks: int = 10_000) -> DataFrame:
    """query_id, id, score (cosine), rank: the k rows nearest to each query (query_id, vector), for any number of queries.

    Queries are dealt into blocks of about `query_block` and vectors into pages of about `page`, both by
    hash; each task compares one block with one page and keeps its k best rows a query, so at most
    pages * k rows a query are shuffled. Only the two row counts reach the driver.

    Vectors and queries that are null or hold null or non-finite components take no part; a query meets the vectors of its own length;
    a vector of zeros scores 0; equal scores fall to the smaller id; rows that repeat an id are hits each.
    """
    kinds = {n: dict(df.dtypes)[c] for n, df, c in (("query_id", queries, "query_id"), ("id", vectors, id_))}
    kinds = {n: "long" if kind in ("tinyint", "smallint", "int", "bigint") else kind for n, kind in kinds.items()}
    out = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], f"{out}, rank int")
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = queries.select(F.col("query_id").cast(kinds["query_id"]), F.col("vector").cast("array<double>").alias("q")).where(whole("q")).withColumn("d", F.size("q"))
    rows = vectors.select(F.col(id_).cast(kinds["id"]).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(whole("v")).withColumn("d", F.size("v"))
    n_blocks, n_pages = (max(1, -(-df.count() // most)) for df, most in ((asked, query_block), (rows, page)))
    deal = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.withColumn("block", deal(n_blocks, "query_id", "q")).withColumn("page", every(n_pages))
    rows = rows.withColumn("page", deal(n_pages, "id", "v")).withColumn("block", every(n_blocks))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": a["query_id"][:0], "id": b["id"][:0], "score": np.zeros(0)})]
        if len(a) and len(b):
            b = b.sort_values("id", kind="stable")  # a stable sort by score then leaves ties by id
            x, own = np.array(b["v"].tolist(), np.float64), b["id"].to_numpy()
            q, ids = np.array(a["q"].tolist(), np.float64), a["query_id"].to_numpy()
            norms, length = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
            for begin in range(0, len(q), 128):
                step = slice(begin, begin + 128)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.nan_to_num((q[step] @ x.T) / (norms[step, None] * length[None, :]), nan=0.0, posinf=0.0, neginf=0.0).round(digits)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                parts.append(pd.DataFrame({"query_id": np.repeat(ids[step], top.shape[1]), "id": own[top.ravel()], "score": np.take_along_axis(s, top, axis=1).ravel()}))
        return pd.concat(parts)

    tasks, by = min(n_blocks * n_pages, most_tasks), ("block", "page", "d")
    asked, rows = asked.repartition(tasks, *by), rows.repartition(tasks, *by)
    part = asked.groupBy(*by).cogroup(rows.groupBy(*by)).applyInPandas(best, out)
    return ranked(part, k)


def together(legs: list[DataFrame]) -> DataFrame:
    """The rows of several legs, dealt anew by query and id.

    A union of legs that are dealt alike counts as dealt so itself, and what is grouped or joined above it isn't shuffled again; where the
    engine deals one of the legs otherwise while it runs, that no longer holds.
    """
    return reduce(DataFrame.unionByName, legs).repartition("query_id", "id")


def fused(legs: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (query_id, id, rank): query_id, id, score, rank."""
    rows = together([x.select("query_id", "id", "rank") for x in legs])
    return ranked(rows.groupBy("query_id", "id").agg(F.round(F.sum(1 / (c + F.col("rank"))), 12).alias("score")), k)


def above(rows: DataFrame, least: float | None) -> DataFrame:
    """Rows whose score reaches `least`, and for every query whether it abstained: it had rows and none is left."""
    if least is None:
        return rows.withColumn("abstained", F.lit(False))
    return rows.where(F.col("score") >= least).withColumn("abstained", F.lit(False))


def abstentions(rows: DataFrame, least: float) -> DataFrame:
    """query_id, candidates, kept, best and abstained for every query with rows."""
    return rows.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(F.col("score") >= least).alias("kept"), F.max("score").alias("best")).withColumn("abstained", F.col("kept") == 0)


def deduplicated(rows: DataFrame, text: str = "text", at_least: float = 0.8) -> DataFrame:
    """Ranked rows (query_id, id, rank, text) without those near a better kept one, ranked anew.

    A row goes if its shingles' containment with any row kept before it reaches `at_least`. Lists are
    the few candidates of one query, so the scan in rank order is a fold over them.
    """
    item = F.struct("rank", "id", "score", F.col(text).alias("text"), shingles(F.col(text)).alias("s"))
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("l"))
    near = lambda kept, x: F.exists(kept, lambda y: containment(y["s"], x["s"]) >= at_least)
    kept = F.aggregate("l", F.slice("l", 1, 0), lambda kept, x: F.when(near(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    return lists.select("query_id", F.posexplode(kept).alias("pos", "x")).select("query_id", F.col("x.id").alias("id"), F.col("x.score").alias("score"), (F.col("pos") + 1).alias("rank"), F.col("x.text").alias("text"))


def materialised(rows: DataFrame, dense_rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Fused rows with their text: that of the dense row, else of the lexical entry (id, text); rows without either go."""
    own = dense_rows.select("query_id", "id", F.col("text").alias("dense_text"))
    other = entries.select("id", F.col("text").alias("entry_text"))
    return rows.join(own, ["query_id", "id"], "left").join(other, "id", "left").withColumn("text", F.coalesce("dense_text", "entry_text")).where("text is not null").drop("dense_text", "entry_text")


def hybrid(lexical_leg: DataFrame, dense_leg: DataFrame, entries: DataFrame, k: int, pool: int = 30, rerank_pool: int = 15, least: float | None = None, dedup: bool = True, c: int = 60) -> DataFrame:
    """Both legs cut at `pool`, the threshold on the dense one, fusion, texts, removal of near duplicates, the cut.

    A query whose dense rows all fall under the threshold abstains: none of its rows comes back.
    """
    dense_leg = dense_leg.where(F.col("rank") <= pool)
    kept = above(dense_leg, least)
    if least is not None:
        silent = abstentions(dense_leg, least).where("abstained").select("query_id")
        lexical_leg = lexical_leg.join(silent, "query_id", "left_anti")
    rows = fused([kept, lexical_leg.where(F.col("rank") <= pool)], max(k, rerank_pool) if dedup else k, c)
    rows = rows.join(entries.select("id", "text"), "id").select("query_id", "id", "score", "rank", "text")
    return (deduplicated(rows) if dedup else rows).where(F.col("rank") <= k)


def interleaved(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked flows as one: first[1], second[1], first[2], ...; what is left of the longer follows."""
    rows = together([first.withColumn("flow", F.lit(0)), second.withColumn("flow", F.lit(1))])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "flow")))


def per_flow(rows: DataFrame, flow: Column, k: int) -> DataFrame:
    """The k best rows of each query in each flow, never merged by score."""
    order = Window.partitionBy("query_id", "flow").orderBy(F.desc("score"), "id")
    return rows.withColumn("flow", flow).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fan_out(collections: list[DataFrame], k: int, least: float | None = None, texts: DataFrame | None = None) -> DataFrame:
    """The k best over several collections' own k best, by score, then id; the threshold comes after the cut.

    With texts (id, text), rows near a better one go before the cut.
    """
    rows = together([x.where(F.col("rank") <= k).drop("rank") for x in collections])
    if texts is None:
        return above(ranked(rows, k), least)
    every = ranked(rows, 2**31 - 1).join(texts.select("id", "text"), "id").select("query_id", "id", "score", "rank", "text")
    return above(deduplicated(every).drop("text").where(F.col("rank") <= k), least)
