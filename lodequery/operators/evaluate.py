"""Retrieval quality: hit rate, reciprocal rank, set metrics, and verdicts against a baseline.

A query that has expected ids and no hit counts with a first rank of null; repeated expected ids count once; empty tables give one row of n = 0 where a
report has one row, else none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.operators import graph, retrieve
from lodequery.operators.lexical import blocks


def first_relevant(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id and first (the best rank of an expected id, null if none) of every query in truth (query_id, id)."""
    hits = results.join(truth, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    return truth.select("query_id").distinct().join(hits, "query_id", "left")


def _keys(kind: str) -> Column:
    """Hashes of all runs of characters of a text."""
    n, of = int(kind.removeprefix("chars")), F.length("text")
    return F.when(of >= n, F.transform(F.sequence(F.lit(1), of - n + 1), lambda i: F.xxhash64(F.lit(kind), F.substring("text", i, F.lit(n))))).otherwise(F.array().cast("array<long>"))


def _runs_of_words(lengths: tuple[int, ...]):
    """A function of batches (id, text as bytes): id and the hashes of all runs of so many words, parted at spaces, of each text, by length of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in (b.columns for batch in batches for b in blocks(batch)):
            words = pc.split_pattern(texts, b" ")
            size = pc.list_value_length(words).to_numpy()
            coded = words.flatten().dictionary_encode()
            known, code = coded.dictionary, coded.indices.to_numpy()
            length = pc.binary_length(known).to_numpy().astype(np.int64)
            ends = np.cumsum(length)
            place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length)
            powers = np.cumprod(np.full(int(length.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
            data = np.frombuffer(b"".join(known.to_pylist()), np.uint8)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[place], dtype=np.uint64)])
            h = sums[ends] - sums[ends - length]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = h ^ (h >> np.uint64(32))
            last = np.cumsum(size)
            for n in lengths:
                found = np.full(max(len(code) - n + 1, 0), n, np.uint64)
                for i in range(n):
                    found = found * np.uint64(0x94D049BB133111EB) + h[code[i : i + len(found)]]
                own = np.maximum(size - n + 1, 0)
                begin = np.repeat(last - size, own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(own)).astype(np.int32)), pa.array(found[begin].view(np.int64)))], ["id", "keys"])

    return run


def word_keys(rows: DataFrame, id_: str, text: str, *lengths: int) -> DataFrame:
    """id and keys, the hashes of all runs of n words of a text, for each length n."""
    rows = rows.select(F.col(id_).alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_runs_of_words(lengths), f"id {rows.schema['id'].dataType.simpleString()}, keys array<long>")


def holding(docs: DataFrame, items: DataFrame, inner: int = 3, most_broadcast: int = 100_000) -> DataFrame:
    """query_id, id of documents (id, text) that hold an item's (query_id, text) whole text.

    An item's words but its first and last stand whole in every text that holds it, so items and texts meet on
    the hash of `inner` of those, parted at spaces; items of fewer words meet on their longest inner word, and those without one on their
    first three characters or fewer. Keys of words are hashed a block of texts at a time. Texts send the keys that some item has, not themselves; the texts of the pairs that meet are fetched and compared.
    Null and empty items are held by none.
    """
    words = F.split("text", " ")
    keyed = items.where("text <> ''").withColumn("_w", words).withColumn("_n", F.size("_w"))
    inside = F.slice("_w", F.lit(2), F.col("_n") - 2)
    longest = F.element_at(F.array_sort(F.transform(inside, lambda w: F.struct(F.length(w), w.alias("w")))), -1)["w"]
    kind = F.when(F.col("_n") >= inner + 2, "run").when(F.col("_n") > 2, "word").otherwise(F.concat(F.lit("chars"), F.least(F.lit(3), F.length("text"))))
    value = F.when(kind == "run", F.array_join(F.slice("_w", 2, inner), " ")).when(kind == "word", longest).otherwise(F.substring("text", 1, 3))
    asked = keyed.select("query_id", F.col("text").alias("item"), kind.alias("kind"), value.alias("value"))
    held = {r["kind"] for r in asked.select("kind").distinct().collect()}  # five kinds at most
    texts, found = docs.where("text is not null"), []
    small = F.broadcast if asked.count() <= most_broadcast else (lambda df: df)
    lengths = {"run": inner, "word": 1}
    if kinds := [k for k in lengths if k in held]:
        own = [word_keys(asked.where(F.col("kind") == k).select(F.struct("query_id", "item").alias("x"), "value"), "x", "value", lengths[k]) for k in kinds]
        own = reduce(DataFrame.unionByName, own).select("id.*", F.element_at("keys", 1).alias("key"))
        keys = word_keys(texts, "id", "text", *(lengths[k] for k in kinds)).select("id", F.explode("keys").alias("key"))
        found.append(keys.join(small(own), "key").select("query_id", "item", "id"))
    for k in sorted(held - set(lengths)):
        keys = texts.select("id", F.explode(F.array_distinct(_keys(k))).alias("key"))
        own = asked.where(F.col("kind") == k).select("query_id", "item", F.xxhash64("kind", "value").alias("key"))
        found.append(keys.join(small(own), "key").select("query_id", "item", "id"))
    if not found:
        return items.select("query_id").join(docs.select("id"), F.lit(False)).select("query_id", "id")
    pairs = reduce(DataFrame.unionByName, found).distinct()
    return pairs.join(docs.select("id", "text"), "id").where(F.contains("text", "item")).select("query_id", "id").distinct()


def report(results: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """n, hit_k for each k, and mrr over the first ten ranks; by: columns of truth to report apart."""
    rows = first_relevant(results, truth.select("query_id", "id").distinct())
    if by:
        rows = rows.join(truth.select("query_id", *by).distinct(), "query_id")
    hit = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 9).alias(f"hit_{k}")
    mrr = F.round(F.avg(F.when(F.col("first") <= 10, 1 / F.col("first")).otherwise(0.0)), 9)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(hit(k) for k in ks), mrr.alias("mrr"))


def union_hit_rate(flows: list[DataFrame], truth: DataFrame, k: int) -> DataFrame:
    """Share of queries for which any flow has an expected id among its first k."""
    found = retrieve.together([flow.where(F.col("rank") <= k).select("query_id", "id") for flow in flows])
    hits = found.join(truth, ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1.0))
    rows = truth.select("query_id").distinct().join(hits, "query_id", "left")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 9).alias("union_hit_rate"))


def set_metrics(got: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """precision, recall and f1 of each case (case_id): nothing got is precision 1, nothing expected is recall 1."""
    shared = got.distinct().withColumn("g", F.lit(1)).join(expected.distinct().withColumn("e", F.lit(1)), ["case_id", "ref"], "full_outer")
    counts = shared.groupBy("case_id").agg(F.count("g").alias("got"), F.count("e").alias("expected"), F.count(F.col("g") + F.col("e")).alias("shared"))
    rows = cases.select("case_id").distinct().join(counts, "case_id", "left").fillna(0)
    p = F.when(F.col("got") == 0, 1.0).otherwise(F.try_divide("shared", "got"))
    r = F.when(F.col("expected") == 0, 1.0).otherwise(F.try_divide("shared", "expected"))
    rows = rows.withColumns({"precision": F.round(p, 9), "recall": F.round(r, 9)})
    return rows.withColumn("f1", F.round(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)), 9))


def suite_means(metrics: DataFrame, relations: DataFrame) -> DataFrame:
    """Means of set metrics over all cases (relation null), and mean f1 by relation."""
    rows = metrics.join(relations, "case_id")
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return rows.groupingSets([["relation"], []], "relation").agg(mean("precision"), mean("recall"), mean("f1"), F.count("*").alias("n"))


def regression(current: DataFrame, baseline: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per metric (name, value) the delta and whether it fell by more than the tolerance; metrics without baseline pass."""
    rows = current.join(baseline.withColumnRenamed("value", "baseline"), "name", "left")
    delta = F.round(F.col("value") - F.col("baseline"), 9)
    status = F.when(F.col("baseline").isNull(), "no-baseline").when(delta < -tolerance, "regressed").otherwise("ok")
    return rows.select("name", "value", "baseline", delta.alias("delta"), status.alias("status"))


def missing(expected: DataFrame, known: DataFrame, by: str = "path") -> DataFrame:
    """Expected values that the index doesn't have."""
    return expected.select(by).distinct().join(known.select(by), by, "left_anti")


def graph_answers(nodes: DataFrame, edges: DataFrame, cases: DataFrame) -> DataFrame:
    """relation, target, ref: what the graph answers to cases (relation, target): who_calls the callers of a name, defines its definitions."""
    asked = lambda relation: cases.where(F.col("relation") == relation).select(F.col("target").alias("name")).distinct()
    row = lambda rows, relation: rows.select(F.lit(relation).alias("relation"), F.col("name").alias("target"), "ref").distinct()
    return row(graph.related(nodes, edges, asked("who_calls"), "calls"), "who_calls").unionByName(row(graph.find_symbol(nodes, asked("defines")), "defines"))


def graph_metrics(answers: DataFrame, expected: DataFrame, cases: DataFrame) -> DataFrame:
    """Set metrics of each case (relation, target)."""
    key = lambda df: df.withColumn("case_id", F.struct("relation", "target"))
    rows = set_metrics(key(answers).select("case_id", "ref"), key(expected).select("case_id", "ref"), key(cases))
    return rows.select("case_id.relation", "case_id.target", "got", "expected", "precision", "recall", "f1")


def unknown_refs(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """References of cases (relation, target, ref) that the graph doesn't answer."""
    return wanted.join(answers.select("relation", "target", "ref"), ["relation", "target", "ref"], "left_anti")
