"""Telemetry reports over an event table (event_id, ts, operation, elapsed_ms, fields...).

One pass and one aggregation each; percentiles are exact and nearest-rank. `since` and `until` are
inclusive and reach the scan as filters on ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.functions.text import bucket


def window(events: DataFrame, operation: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Events of an operation in a time window."""
    out = events if operation is None else events.where(F.col("operation") == operation)
    out = out if since is None else out.where(F.col("ts") >= since)
    return out if until is None else out.where(F.col("ts") <= until)


def cache_report(events: DataFrame, granularity: str = "day") -> DataFrame:
    """hits and misses by bucket; the bucket null holds the totals and the tokens saved, hits * tokens / texts rounded half to even."""
    hit, cost = F.col("operation") == "embeddings_cache", F.col("operation") == "embeddings"
    rows = events.where(hit | cost).withColumn("bucket", F.when(hit, bucket(F.col("ts"), granularity)))
    saved = F.bround(F.coalesce(F.sum(F.when(hit, F.col("hits"))), F.lit(0)) * F.coalesce(F.try_divide(F.sum(F.when(cost, F.col("tokens"))), F.sum(F.when(cost, F.col("texts")))), F.lit(0.0)), 0)
    sums = [F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).alias(c) for c in ("hits", "misses")]
    total = rows.agg(*sums, saved.cast("long").alias("tokens_saved")).select(F.lit(None).cast("string").alias("bucket"), "hits", "misses", "tokens_saved")
    series = rows.where(hit).groupBy("bucket").agg(*sums).withColumn("tokens_saved", F.lit(None).cast("long"))
    return series.unionByName(total)


def cost_report(events: DataFrame, granularity: str = "day") -> DataFrame:
    """Tokens in total, by provider and by bucket in one pass over grouping sets; events without tokens don't count."""
    rows = events.where((F.col("operation") == "embeddings") & F.col("tokens").isNotNull())
    rows = rows.select(F.coalesce("provider", F.lit("unknown")).alias("provider"), bucket(F.col("ts"), granularity).alias("bucket"), "tokens")
    return rows.groupingSets([["provider"], ["bucket"], []], "provider", "bucket").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def health_report(events: DataFrame, granularity: str = "day") -> DataFrame:
    """The last index event of each bucket and, with bucket null, of all."""
    rows = events.where(F.col("operation") == "index").withColumn("bucket", bucket(F.col("ts"), granularity))
    last = F.max_by(F.struct("ts", "documents", "chunks"), F.struct("ts", "event_id")).alias("last")
    return rows.groupingSets([["bucket"], []], "bucket").agg(last).select("bucket", "last.ts", "last.documents", "last.chunks").where("ts is not null")


def latency_report(events: DataFrame, operations: tuple[str, ...] = ("index", "retrieve")) -> DataFrame:
    """Nearest-rank p50 and p95 of elapsed_ms and the count, by operation."""
    rows = events.where(F.col("operation").isin(*operations) & F.col("elapsed_ms").isNotNull())
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by elapsed_ms)")
    return rows.groupBy("operation").agg(rank(0.5).alias("p50_ms"), rank(0.95).alias("p95_ms"), F.count("*").alias("n"))


def reliability_report(events: DataFrame) -> DataFrame:
    """Errors, retries, low-confidence and retrieve events, and the share of low confidence."""
    n = lambda op: F.count_if(F.col("operation") == op)
    out = events.agg(n("embeddings_error").alias("errors"), n("embeddings_retry").alias("retries"), n("low_confidence").alias("low_confidence"), n("retrieve").alias("retrieves"))
    return out.withColumn("low_confidence_rate", F.coalesce(F.try_divide("low_confidence", "retrieves"), F.lit(0.0)))


def recent(events: DataFrame, limit: int) -> DataFrame:
    """The last `limit` events; none for 0 or less."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(limit, 0))


def verdict(results: Column, abstained: Column) -> Column:
    """hit, abstained or miss."""
    return F.when(F.coalesce(results, F.lit(0)) > 0, "hit").when(F.coalesce(abstained, F.lit(False)), "abstained").otherwise("miss")


def snapshot(events: DataFrame) -> DataFrame:
    """One row of the headline numbers of all reports."""
    is_ = lambda op: F.col("operation") == op
    return events.agg(
        F.coalesce(F.sum(F.when(is_("embeddings_cache"), F.col("hits"))), F.lit(0)).alias("cache_hits"),
        F.coalesce(F.sum(F.when(is_("embeddings_cache"), F.col("misses"))), F.lit(0)).alias("cache_misses"),
        F.coalesce(F.sum(F.when(is_("embeddings"), F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.max(F.when(is_("index"), F.col("ts"))).alias("last_index_ts"),
        F.count_if(is_("retrieve")).alias("retrieves"),
        F.count_if(is_("retrieve") & (F.col("hits") > 0)).alias("with_hits"),
    ).withColumn("hit_rate", F.coalesce(F.try_divide("with_hits", "retrieves"), F.lit(0.0)))


def time_window(preset: str, now: float) -> tuple[float | None, float | None]:
    """Begin and end of a named window (24h, 7d, anything else: all) that ends now; None is open."""
    days = {"24h": 1, "7d": 7}.get(preset)
    return (None if days is None else now - days * 86_400), None
