"""Incremental index: file classification, deltas, keyed upserts and the content-hash cache.

Paths and keys are unique where a state is kept; null keys match nothing in joins and so count as new; null hashes and times count as changed; of rows that
repeat a key inserted_or_ignored() takes any one (sources/store.py orders them); empty tables give empty results, counters() one row of zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classified(state: DataFrame, current: DataFrame) -> DataFrame:
    """Each path as new, deleted, unchanged or modified.

    state and current have path, mtime, content_hash and logic_version. A new logic version is a
    modification; else an equal mtime is unchanged without looking at the hash, and else the hash decides.
    """
    a, b = state.alias("a"), current.alias("b")
    verdict = (
        F.when(F.col("a.path").isNull(), "new").when(F.col("b.path").isNull(), "deleted")
        .when(F.col("a.logic_version") != F.col("b.logic_version"), "modified")
        .when(F.col("a.mtime") == F.col("b.mtime"), "unchanged")
        .when(F.col("a.content_hash") == F.col("b.content_hash"), "unchanged").otherwise("modified")
    )
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), verdict.alias("class"))


def upserted(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal key."""
    return old.join(new.select(*by), by, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(gone.select(*by), by, "left_anti")


def inserted_or_ignored(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """old with the rows of new whose key it doesn't have; of new rows of one key, one."""
    return old.unionByName(new.dropDuplicates(by).join(old.select(*by), by, "left_anti"))


def counters(classes: DataFrame) -> DataFrame:
    """One row: how many paths of each class."""
    return classes.agg(*(F.count_if(F.col("class") == c).alias(c) for c in ("new", "modified", "deleted", "unchanged")))


def stale(state: DataFrame, stats: DataFrame) -> DataFrame:
    """Paths that vanished, or whose mtime and hash both changed."""
    rows = state.alias("a").join(stats.alias("b"), "path", "left")
    gone = F.col("b.mtime").isNull()
    return rows.where(gone | (F.col("a.mtime") != F.col("b.mtime")) & (F.col("a.content_hash") != F.col("b.content_hash"))).select("path", F.when(gone, "vanished").otherwise("changed").alias("reason"))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct hashes of texts that the cache (model, content_hash) lacks, with one text each."""
    rows = texts.select("model", F.sha2("text", 256).alias("content_hash"), "text").groupBy("model", "content_hash").agg(F.min("text").alias("text"))
    return rows.join(cache.select("model", "content_hash"), ["model", "content_hash"], "left_anti")


def units(docs: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks (doc_id, ordinal, ...) of the wanted documents with their documents' columns, in order."""
    own = wanted.select("doc_id").distinct()
    return docs.join(own, "doc_id", "left_semi").join(chunks, "doc_id").orderBy("doc_id", "ordinal")


def cached(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """Vectors of the cache for the wanted (model, content_hash)."""
    return cache.join(wanted.select("model", "content_hash").distinct(), ["model", "content_hash"])


def in_order(entries: DataFrame, ids: DataFrame, by: str) -> DataFrame:
    """Entries of the given ids (place, id) in the order asked for; unknown ids are skipped."""
    return ids.join(entries, by).orderBy("place")


def collections(vectors: DataFrame) -> DataFrame:
    """Each collection that has rows, and how many; a collection without rows doesn't exist."""
    return vectors.groupBy("collection").agg(F.count("*").alias("n"))


def delta(rows: DataFrame, fresh: DataFrame, updated: DataFrame, removed: DataFrame, by: str) -> DataFrame:
    """rows without those of updated and removed keys, and with the fresh ones."""
    return rows.join(updated.select(by).union(removed.select(by)).distinct(), by, "left_anti").unionByName(fresh)


def build_mode(forced: Column, known: Column, runs: Column, every: Column) -> Column:
    """full when asked for, without a usable manifest, or at the last of every `every` runs (0: never); else incremental."""
    return F.when(forced | ~known | ((every > 0) & (runs >= every)), "full").otherwise("incremental")


def brought_up(state: DataFrame, current: DataFrame) -> DataFrame:
    """The manifest after an incremental run: changed and new paths as they are now, others as they were, vanished ones gone."""
    classes = classified(state, current)
    changed = current.join(classes.where("class in ('new', 'modified')"), "path", "left_semi")
    gone = classes.where("class in ('modified', 'deleted')").select("path")
    return state.join(gone, "path", "left_anti").unionByName(changed)
