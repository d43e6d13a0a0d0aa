"""Checks of many collections at once: settings, provider, index and server, and one status for each.

Problems are rows (collection, area, code, severity, fields). Every check takes the collections (collection) and gives problems for those alone. Collections that
repeat count once; null and blank values are as if not there; empty tables give no problem but what is missing by that; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Areas in their order, and the flags by which a server leaves its folder.
AREAS = ("config", "provider", "index", "mcp")
MOVING = ("--directory", "-C")


def _problem(area: str, code: Column | str, severity: str, fields: Column | None = None) -> list[Column]:
    code = F.lit(code) if isinstance(code, str) else code
    fields = F.array().cast("array<string>") if fields is None else fields
    return [F.col("collection"), F.lit(area).alias("area"), code.alias("code"), F.lit(severity).alias("severity"), fields.alias("fields")]


def missing_keys(collections: DataFrame, required: DataFrame, settings: DataFrame) -> DataFrame:
    """The required (collection, key) that settings (collection, key, value) lack or leave blank."""
    full = settings.where(F.trim(F.coalesce("value", F.lit(""))) != "").select("collection", "key")
    return required.select("collection", "key").distinct().join(collections.select("collection"), "collection", "left_semi").join(full, ["collection", "key"], "left_anti")


def config(collections: DataFrame, required: DataFrame, settings: DataFrame) -> DataFrame:
    """A failure for each missing key."""
    return missing_keys(collections, required, settings).select(*_problem("config", "env_missing_key", "fail", F.array("key")))


def provider(collections: DataFrame, required: DataFrame, settings: DataFrame, probes: DataFrame) -> DataFrame:
    """One failure where keys of the provider are missing, which it names; else a warning where the probe (collection, status) didn't reach it."""
    lacking = missing_keys(collections, required, settings).groupBy("collection").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    away = probes.where("status = 'unreachable'").select("collection").distinct().join(collections.select("collection"), "collection", "left_semi").join(lacking, "collection", "left_anti")
    return lacking.select(*_problem("provider", "provider_config_incomplete", "fail", F.col("keys"))).unionByName(away.select(*_problem("provider", "provider_unreachable", "warn")))


def manifest_of(manifests: DataFrame, version: str) -> DataFrame:
    """Rows of manifests (collection, version, path, mtime, content_hash) that this version can use; a collection without any has no index."""
    return manifests.where(F.col("version") == version).drop("version")


def freshness(collections: DataFrame, manifests: DataFrame, stats: DataFrame, version: str = "1") -> DataFrame:
    """collection, absent, stale and last (mtime) of each collection.

    stats: the files as they are (collection, path, mtime, content_hash). Stale: a file of the manifest is gone, or its mtime and its hash have both
    changed; files that the manifest doesn't have make nothing stale. Files are compared by key and summed up before they meet the collections.
    """
    kept = manifest_of(manifests, version).select("collection", "path", "mtime", "content_hash")
    now = stats.select("collection", "path", F.col("mtime").alias("_m"), F.col("content_hash").alias("_h"))
    changed = F.col("_m").isNull() | (F.col("mtime") != F.col("_m")) & ~F.col("content_hash").eqNullSafe(F.col("_h"))
    own = kept.join(now, ["collection", "path"], "left").groupBy("collection").agg(F.bool_or(F.coalesce(changed, F.lit(False))).alias("stale"), F.max("mtime").alias("last"))
    rows = collections.select("collection").distinct().join(own, "collection", "left")
    return rows.select("collection", F.col("stale").isNull().alias("absent"), F.coalesce("stale", F.lit(False)).alias("stale"), "last")


def index(fresh: DataFrame) -> DataFrame:
    """A failure where there is no index, a warning where it is stale, of the rows of freshness()."""
    return fresh.where("absent").select(*_problem("index", "index_absent", "fail")).unionByName(fresh.where("stale").select(*_problem("index", "index_stale", "warn")))


def server(fresh: DataFrame, servers: DataFrame) -> DataFrame:
    """At most one warning a collection, of servers (collection, registered, invocation): not registered, started so that it leaves its folder, or older than a stale index."""
    one = servers.groupBy("collection").agg(F.bool_or("registered").alias("registered"), F.max("invocation").alias("invocation"))
    rows = fresh.join(one, "collection", "left").withColumn("registered", F.coalesce("registered", F.lit(False)))
    moves = F.coalesce(F.arrays_overlap("invocation", F.array(*map(F.lit, MOVING))), F.lit(False))
    code = F.when(~F.col("registered"), "mcp_not_registered").when(moves, "mcp_invocation_moves_cwd").when(F.col("stale"), "mcp_stale_after_reindex")
    return rows.withColumn("_code", code).where("_code is not null").select(*_problem("mcp", F.col("_code"), "warn"))


def report(collections: DataFrame, *problems: DataFrame) -> DataFrame:
    """collection, place, area, status, codes (sorted) and overall: the worst of an area's problems, and of all areas; without any it passes."""
    rank = lambda c: F.when(c == "fail", 2).when(c == "warn", 1).otherwise(0)
    name = lambda c: F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), c + 1)
    areas = F.posexplode(F.array(*map(F.lit, AREAS))).alias("place", "area")
    own = reduce(DataFrame.unionByName, problems).groupBy("collection", "area").agg(F.max(rank(F.col("severity"))).alias("r"), F.array_sort(F.collect_set("code")).alias("codes"))
    rows = collections.select("collection").distinct().select("collection", areas).join(own, ["collection", "area"], "left").withColumn("r", F.coalesce("r", F.lit(0)))
    worst = rows.groupBy("collection").agg(F.max("r").alias("o"))
    return rows.join(worst, "collection").select("collection", "place", "area", name(F.col("r")).alias("status"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"), name(F.col("o")).alias("overall"))
