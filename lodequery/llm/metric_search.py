"""Exact top-k by inner product with M-trees searched best first.

Vectors are dealt into pages by the nearest of at most `most_pivots` sampled pivots and, where a pivot
has more than a page of rows, by a hash of the id, so that one common vector fills many pages. Each page
becomes an M-tree: nodes with a routing vector, a covering radius, the distance to the parent's routing
vector and the largest norm below. A query first searches its own page, which gives it a least score;
it then goes only to pages whose bound reaches that score, in blocks of queries, and inside a page to
nodes by falling bound. The triangle inequality on stored parent distances rules out nodes and vectors
before their distance to the query is computed. Each page returns at most k rows a query.

Distances are Euclidean. From d(q, x) >= lower follows q.x <= (|q|^2 + |x|^2 - lower^2) / 2, and from a
covering radius r around c follows q.x <= q.c + |q| r; bounds get a little slack for rounding, scores
are exact integers.

Cases: rows without id, and vectors that are null, empty or hold null or non-finite components, take no
part; rows that repeat a vec_id are candidates each, and as queries they share one ranking under their id;
a query's candidates are the rows of other ids; vectors are compared with those of their own length; equal
scores rank by vec_id; extra columns are ignored; an empty table gives an empty result. Scores must fit in a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.llm.common import cut

SCHEMA = "query_id long, rank int, vec_id long, score long"


class MTree:
    """A bulk-loaded M-tree over the rows of x (integers); leaves hold up to `leaf` rows, nodes up to `fan` children."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = 1024, fan: int = 16):
        self.ids, self.x, self.leaf, self.fan = ids, x, leaf, fan
        self.f = x.astype(np.float64)
        self.norm2 = (self.f**2).sum(axis=1)
        self.top = self.grow(np.arange(len(ids)), None)

    def grow(self, rows: np.ndarray, parent: np.ndarray | None) -> dict:
        mean = self.f[rows].mean(axis=0)
        away = ((self.f[rows] - mean) ** 2).sum(axis=1)
        center = self.f[rows[int(np.argmin(away))]]
        far = np.sqrt(((self.f[rows] - center) ** 2).sum(axis=1))
        node = {
            "center": center, "radius": float(far.max()), "norm2": float(self.norm2[rows].max()),
            "to_parent": 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum())),
        }
        if len(rows) <= self.leaf or far.max() == 0:
            if len(rows) > self.leaf:  # equal vectors: pages of them
                node["children"] = [self.grow(rows[i : i + self.leaf], center) for i in range(0, len(rows), self.leaf)]
                return self.packed(node)
            # side by side; products of doubles are exact while no score can reach 2**53
            return node | {"rows": self.f[rows], "exact": self.x[rows], "ids": self.ids[rows], "half": (self.norm2[rows]) / 2, "far": far}
        n = min(self.fan, -(-len(rows) // self.leaf) + 1)
        pivots = [int(np.argmax(far))]
        near = None
        owner = np.zeros(len(rows), np.int64)
        for i in range(n):  # farthest-point pivots
            d = ((self.f[rows] - self.f[rows[pivots[i]]]) ** 2).sum(axis=1)
            owner = owner if near is None else np.where(d < near, i, owner)
            near = d if near is None else np.minimum(near, d)
            pivots.append(int(np.argmax(near)))
        parts = [rows[owner == i] for i in range(n) if (owner == i).any()]
        node["children"] = [self.grow(p, center) for p in parts]
        return self.packed(node)

    @staticmethod
    def packed(node: dict) -> dict:
        """Children's fields side by side, so that one step tests all of them."""
        for name in ("center", "radius", "norm2", "to_parent"):
            node[f"of_{name}"] = np.array([c[name] for c in node["children"]])
        return node

    def search(self, q: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows whose score reaches `least`, the row `own` left out."""
        f = q.astype(np.float64)
        q2 = float(f @ f)
        qn, slack = np.sqrt(q2), 1e-9
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        root = float(np.sqrt(((f - self.top["center"]) ** 2).sum()))
        heap, made = [(-np.inf, 0, self.top, root)], 0
        while heap:
            bound, _, node, to_center = heapq.heappop(heap)
            if -bound < least:
                break
            if "rows" in node:
                lower = np.abs(to_center - node["far"]) * (1 - slack)
                at = np.flatnonzero((q2 / 2 + node["half"] - lower**2 / 2) * (1 + slack) + 1e-6 * (1 + q2) >= least)
                if not len(at):
                    continue
                if q2 * node["norm2"] < 2.0**100:
                    new = (node["rows"] @ f if 2 * len(at) > len(lower) else node["rows"][at] @ f).astype(np.int64)
                    new = new[at] if len(new) > len(at) else new
                else:
                    new = node["exact"][at] @ q
                good = np.flatnonzero((new >= least) & (node["ids"][at] != own))
                scores, ids = np.concatenate([scores, new[good]]), np.concatenate([ids, node["ids"][at[good]]])
                if len(scores) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[best], ids[best]
                if len(scores) == k:
                    least = max(least, float(scores.min()))
                continue
            apart = np.maximum(0, np.abs(to_center - node["of_to_parent"]) - node["of_radius"]) * (1 - slack)
            open_ = np.flatnonzero((q2 + node["of_norm2"] - apart**2) / 2 * (1 + slack) + 1e-6 * (1 + q2) >= least)
            centers = node["of_center"][open_]
            far = np.sqrt(((centers - f) ** 2).sum(axis=1))
            gap = np.maximum(0, far - node["of_radius"][open_]) * (1 - slack)
            bounds = np.minimum(centers @ f + qn * node["of_radius"][open_], (q2 + node["of_norm2"][open_] - gap**2) / 2)
            bounds = bounds + slack * np.abs(bounds) + 1e-6 * (1 + q2)
            for i, b, d in zip(open_.tolist(), bounds.tolist(), far.tolist(), strict=True):
                if b >= least:
                    made += 1
                    heapq.heappush(heap, (-b, made, node["children"][i], d))
        order = np.lexsort((ids, -scores))
        return scores[order], ids[order]


def vectors(table: DataFrame) -> DataFrame:
    """vec_id and v, the components as floor(64 * x), of the rows that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", fine))
    return rows.select("vec_id", F.transform("e", lambda x: F.floor(x * 64).cast("long")).alias("v"))


def matrix(column) -> np.ndarray:
    return np.array(list(column), np.int64)


def top_k(table: DataFrame, is_query: Column, k: int = 20, page: int = 8192, query_block: int = 2048, most_pivots: int = 1024, most_pages: int = 100_000) -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k best rows for each row that is_query (a condition on vec_id) holds for.

    Pivots are the first rows by a hash of the id, one for each page of rows, `most_pivots` at most. Up to `most_pages` page sizes are broadcast, more are joined by a shuffle.
    """
    rows = cut(vectors(table))
    spark = table.sparkSession
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, min(most_pivots, -(-n // page)))).collect()
    pivots: dict[int, np.ndarray] = {}
    for r in sample:
        pivots.setdefault(len(r["v"]), []).append(r["v"])
    held = spark.sparkContext.broadcast({d: np.array(v, np.float64) for d, v in pivots.items()})

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            sizes = np.diff(np.asarray(v.offsets))
            flat = np.asarray(v.flatten()).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            pivot, far, norm = np.full(len(sizes), -1), np.zeros(len(sizes)), np.zeros(len(sizes))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = flat[starts[at][:, None] + np.arange(d)]
                norm[at] = (x**2).sum(axis=1)
                if int(d) in held.value:
                    p = held.value[int(d)]
                    pivot[at] = np.argmin((p**2).sum(axis=1) - 2 * x @ p.T, axis=1)
                    far[at] = np.sqrt(((x - p[pivot[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes.astype(np.int32)), pa.array(pivot.astype(np.int32)), pa.array(far), pa.array(norm)], ["vec_id", "v", "d", "pivot", "far", "norm2"])

    dealt = cut(rows.mapInArrow(assign, "vec_id long, v array<long>, d int, pivot int, far double, norm2 double"))
    cells = dealt.groupBy("d", "pivot").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max("norm2").alias("norm2")).collect()  # a row for each pivot, or length without one
    salts = {(c["d"], c["pivot"]): -(-c["n"] // page) for c in cells}
    sizes = spark.createDataFrame([(*key, s) for key, s in salts.items()] or [(0, 0, 1)], "d int, pivot int, salts int")
    paged = dealt.join(F.broadcast(sizes), ["d", "pivot"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")).cast("int")).drop("salts", "far", "norm2")
    paged = cut(paged)
    bounds = spark.sparkContext.broadcast([(c["d"], c["pivot"], c["radius"], c["norm2"], salts[c["d"], c["pivot"]]) for c in cells])

    def searched(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(data):
            tree = MTree(data["vec_id"].to_numpy(), matrix(data["v"]))
            for own, v, least in zip(queries["vec_id"], queries["v"], queries["least"], strict=True):
                scores, ids = tree.search(np.array(v, np.int64), own, k, least)
                out.extend((own, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    key = ["d", "pivot", "salt", "block"]

    def run(queries: DataFrame) -> DataFrame:
        """Searches each query (vec_id, v, least, d, pivot, salt) in that page; a page's queries are dealt into blocks by hash."""
        queries = cut(queries)
        many = queries.groupBy("d", "pivot", "salt").agg(F.ceil(F.count("*") / query_block).alias("blocks")).where("blocks > 1")
        dealt_ = queries.join(F.broadcast(many) if len(salts) <= most_pages else many, ["d", "pivot", "salt"], "left")
        blocked = cut(dealt_.withColumn("block", F.coalesce(F.pmod(F.xxhash64("vec_id"), F.col("blocks")), F.lit(0)).cast("int")).drop("blocks"))
        needed = blocked.select(*key).distinct()
        data = paged.select("vec_id", "v", "d", "pivot", "salt").join(needed, ["d", "pivot", "salt"])
        data = data.select(*(F.col(c).alias(c) for c in data.columns))  # columns of its own, apart from those of the queries
        return blocked.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(searched, "query_id long, vec_id long, score long")

    asked = paged.where(is_query)
    first = cut(run(asked.withColumn("least", F.lit(float("-inf")))))
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each query the other pages whose bound reaches its least score."""
        for b in batches:
            rows = []
            for r in b.to_pylist():
                q, least = np.array(r["v"], np.float64), -np.inf if r["least"] is None else r["least"]
                q2 = q @ q
                for d, pivot, radius, norm2, salts in bounds.value:
                    if d != r["d"]:
                        continue
                    bound = np.sqrt(q2 * norm2)
                    if pivot >= 0:
                        c = held.value[d][pivot]
                        gap = max(0.0, np.sqrt(((q - c) ** 2).sum()) - radius) * (1 - 1e-9)
                        bound = min(bound, q @ c + np.sqrt(q2) * radius, (q2 + norm2 - gap**2) / 2)
                    if bound + 1e-9 * abs(bound) + 1e-6 * (1 + q2) >= least:
                        rows.extend({"vec_id": r["vec_id"], "v": r["v"], "least": least, "d": d, "pivot": pivot, "salt": s} for s in range(salts) if (pivot, s) != (r["pivot"], r["salt"]))
            yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("least", pa.float64()), ("d", pa.int32()), ("pivot", pa.int32()), ("salt", pa.int32())])
    known = asked.join(least.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", "d", "pivot", "salt", "least")
    others = run(known.mapInArrow(reach, "vec_id long, v array<long>, least double, d int, pivot int, salt int"))
    ranked = first.unionByName(others).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
