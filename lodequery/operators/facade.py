"""What a caller of retrieval sees: checked targets, pools cut after threshold and duplicates, telemetry rows, suites and their runs.

Queries and cases are rows keyed by query_id. Null texts read as empty; empty tables give empty results; repeated rows of a
suite are cases of their own unless stated; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.functions.text import scrubbed
from lodequery.operators import evaluate, retrieve
from lodequery.operators.lexical import ranked

#: Intents and the surface each is measured on, relations a graph case may have, longest snippet in telemetry.
SURFACES, RELATIONS, SNIPPET = {"code": "search_code", "docs": "search_docs"}, ("who_calls", "defines"), 200


def targets(wanted: DataFrame, existing: DataFrame, provider: str) -> DataFrame:
    """corpus, collection and status of each wanted corpus: ok, provider_mismatch (indexed by another provider alone) or no_index."""
    own = wanted.select("corpus", F.concat_ws("__", "corpus", F.lit(provider)).alias("collection"))
    known = existing.select("collection", F.lit(True).alias("_here"), F.regexp_extract("collection", "^(.*?)__", 1).alias("_corpus"))
    others = known.groupBy(F.col("_corpus").alias("corpus")).agg(F.count("*").alias("_n"))
    rows = own.join(known.select("collection", "_here"), "collection", "left").join(others, "corpus", "left")
    return rows.select("corpus", "collection", F.when(F.col("_here"), "ok").when(F.col("_n") > 0, "provider_mismatch").otherwise("no_index").alias("status"))


def searched(pool: DataFrame, entries: DataFrame, k: int, least: float | None = None, dedup: bool = True) -> DataFrame:
    """The k best of a ranked pool: first the threshold, then near duplicates of better rows go, then the cut. query_id, id, score, rank, text."""
    rows = retrieve.above(pool, least).drop("abstained").join(entries.select("id", "text"), "id").select("query_id", "id", "score", "rank", "text")
    return (retrieve.deduplicated(rows) if dedup else rows).where(F.col("rank") <= k)


def low_confidence(pool: DataFrame, least: float) -> DataFrame:
    """An event for each query whose pool the threshold emptied: the threshold, its best score and how many there were."""
    return retrieve.abstentions(pool, least).where("abstained").select("query_id", F.lit(least).alias("threshold"), F.col("best").alias("best_score"), "candidates")


def retrieval_events(queries: DataFrame, lexical: DataFrame, dense: DataFrame, before: DataFrame, results: DataFrame, silent: DataFrame) -> DataFrame:
    """A row for each query: hits of both legs, duplicates removed, results, and whether it abstained."""
    n = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").alias(name))
    out = queries.select("query_id")
    for rows, name in ((lexical, "lexical_hits"), (dense, "dense_hits"), (before, "_before"), (results, "results")):
        out = out.join(n(rows, name), "query_id", "left")
    out = out.fillna(0).join(silent.select("query_id", F.lit(True).alias("abstained")), "query_id", "left")
    return out.select("query_id", "lexical_hits", "dense_hits", "results", F.greatest(F.col("_before") - F.col("results"), F.lit(0)).alias("deduplicated"), F.coalesce("abstained", F.lit(False)).alias("abstained"))


def content_fields(queries: DataFrame, results: DataFrame, k: int, enabled: bool = True) -> DataFrame:
    """query_id and, where enabled, the scrubbed query, path|score of the k best and the first text, scrubbed and cut."""
    none = F.lit(None).cast("string")
    if not enabled:
        return queries.select("query_id", none.alias("query"), none.alias("preview"), none.alias("snippet"))
    top = results.where(F.col("rank") <= k)
    line = F.concat_ws("|", "path", F.round("score", 3).cast("string"))
    rows = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), ",").alias("preview"), F.max(F.when(F.col("rank") == 1, F.coalesce("text", F.lit("")))).alias("text"))
    return queries.join(rows, "query_id", "left").select("query_id", scrubbed(F.col("query")).alias("query"), F.coalesce("preview", F.lit("")).alias("preview"), F.substring(scrubbed(F.col("text")), 1, SNIPPET).alias("snippet"))


def case_fault(query: Column, expected: Column, intent: Column) -> Column:
    """What is wrong with an evaluation case; null for a sound one."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return (
        F.when(blank(query), "query").when(expected.isNull() | (F.size(expected) == 0), "expected").when(F.exists(expected, blank), "path")
        .when(intent.isNotNull() & ~intent.isin(*SURFACES, "both"), "intent")
    )


def graph_case_fault(relation: Column, target: Column, expected: Column) -> Column:
    """What is wrong with a graph case; its expected names may be none, but none of them blank."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(~F.coalesce(relation, F.lit("")).isin(*RELATIONS), "relation").when(blank(target), "target").when(expected.isNull() | F.exists(expected, blank), "expected")


def rebased(cases: DataFrame, prefix: str) -> DataFrame:
    """Cases (expected: paths) seen from a folder: paths below it without it; a case with none of those is left out."""
    base = prefix.rstrip("/") + "/"
    paths = F.transform(F.filter("expected", lambda p: F.startswith(p, F.lit(base))), lambda p: F.substring(p, F.lit(len(base) + 1), F.length(p)))
    return cases.withColumn("expected", paths).where(F.size("expected") > 0)


def ground_truth(cases: DataFrame, intent: str | None = None) -> DataFrame:
    """query_id, path of the cases' expected paths; intent: of those of an intent alone."""
    rows = cases if intent is None else cases.where(F.col("intent") == intent)
    return rows.select("query_id", F.explode("expected").alias("path"))


def by_kind(results: DataFrame, symbols: DataFrame, cases: DataFrame) -> DataFrame:
    """Results of the cases: symbol cases are answered by the graph (symbols: name, ref), others by the engine. query_id, id, rank."""
    kinds = cases.select("query_id", "query", "kind")
    engine = results.join(kinds.where("kind is null or kind <> 'symbol'").select("query_id"), "query_id", "left_semi").select("query_id", "id", "rank")
    found = kinds.where("kind = 'symbol'").join(symbols, F.col("query") == F.col("name")).select("query_id", F.col("ref").alias("id"), F.lit(0.0).alias("score"))
    return engine.unionByName(ranked(found, 2**31 - 1).select("query_id", "id", "rank"))


def compared(runs: dict[str, DataFrame], truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """The report of each engine (label) on one suite."""
    out = None
    for label, results in runs.items():
        part = evaluate.report(results, truth, ks).withColumn("engine", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def fused_evaluation(flows: dict[str, DataFrame], truth: DataFrame, ks: tuple[int, ...], k: int) -> DataFrame:
    """surface, n, hit_k and mrr: each intent's cases (truth: query_id, id, intent) on its surface, and as `union` the share of the
    `both` cases that any surface answers among its first k, in the column of that k."""
    out = None
    for intent, surface in SURFACES.items():
        part = evaluate.report(flows[surface], truth.where(F.col("intent") == intent), ks).withColumn("surface", F.lit(surface))
        out = part if out is None else out.unionByName(part)
    both = evaluate.union_hit_rate(list(flows.values()), truth.where("intent = 'both'").select("query_id", "id"), k)
    none = F.lit(None).cast("double")
    return out.unionByName(both.select("n", *((F.col("union_hit_rate") if x == k else none).alias(f"hit_{x}") for x in ks), none.alias("mrr"), F.lit("union").alias("surface")))


def evaluation_event(report: DataFrame, verdict: DataFrame) -> DataFrame:
    """One telemetry row of a run: metrics and verdict, no query, no path."""
    metrics = [c for c in report.columns if c.startswith("hit_") or c in ("mrr", "n")]
    return report.select(*metrics).join(verdict.agg(F.coalesce(F.bool_or(F.col("status") == "regressed"), F.lit(False)).alias("regressed")))


def worst(problems: DataFrame) -> DataFrame:
    """area and status (fail before warn before pass) of areas with their problems' severities; null severity is no problem."""
    rank = F.max(F.when(F.col("severity") == "fail", 2).when(F.col("severity") == "warn", 1).otherwise(0))
    return problems.groupBy("area").agg(rank.alias("r")).select("area", F.when(F.col("r") == 2, "fail").when(F.col("r") == 1, "warn").otherwise("pass").alias("status"))


def health(problems: DataFrame, areas: tuple[str, ...] = ("config", "provider", "index", "mcp")) -> DataFrame:
    """place, area, status and the overall status of all areas in their fixed order; an area without rows passes."""
    rows = problems.sparkSession.createDataFrame([(i, a) for i, a in enumerate(areas)], "place int, area string").join(worst(problems), "area", "left")
    rows = rows.withColumn("status", F.coalesce("status", F.lit("pass")))
    order = lambda c: F.when(c == "fail", 2).when(c == "warn", 1).otherwise(0)
    overall = rows.agg(F.max(order(F.col("status"))).alias("o")).select(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.col("o") + 1).alias("overall"))
    return rows.join(F.broadcast(overall)).select("place", "area", "status", "overall")


def config_problems(settings: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """A failure for each required key that settings (key, value) lack or leave blank."""
    keys = settings.sparkSession.createDataFrame([(k,) for k in required], "key string")
    full = settings.where(F.trim(F.coalesce("value", F.lit(""))) != "").select("key")
    return keys.join(full, "key", "left_anti").select(F.lit("config").alias("area"), "key", F.lit("fail").alias("severity"))
