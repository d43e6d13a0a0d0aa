"""Queries over what callers of retrieval see, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequery.operators import evaluate, facade, health, lexical, retrieve
from lodequery.plans.common import Registry
from lodequery.plans.retrieval import BM25, DENSE, FUSED, NEAR_BY_RANK, SHINGLES, TRUTH, WORDS, _dense, _docs, _entries, _items, _lexical, _truth
from lodequery.sources import suites
from lodequery.sources.tables import table

REGISTRY = Registry()
QUERIES, ORACLES, query = REGISTRY.queries, REGISTRY.oracles, REGISTRY.query


@query("""WITH c AS (SELECT DISTINCT concat(source, '__', CASE WHEN length(source) = 4 THEN 'hash' ELSE 'glove' END) AS collection FROM documents),
w AS (SELECT DISTINCT source AS corpus FROM documents UNION SELECT 'none') SELECT corpus, concat(corpus, '__hash') AS collection, CASE WHEN concat(corpus, '__hash') IN (SELECT collection FROM c) THEN 'ok' WHEN concat(corpus, '__glove') IN (SELECT collection FROM c) THEN 'provider_mismatch' ELSE 'no_index' END AS status FROM w""")
def ret15_targets(s: SparkSession, d: str) -> DataFrame:
    own = _docs(s, d).select(F.col("source").alias("corpus")).distinct()
    existing = own.select(F.concat_ws("__", "corpus", F.when(F.length("corpus") == 4, "hash").otherwise("glove")).alias("collection"))
    return facade.targets(own.union(s.createDataFrame([("none",)], "corpus string")), existing, "hash")


# the pool: 15 candidates a query, those under the threshold out, near duplicates of better ones out, five left
POOL = f"cand AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, {SHINGLES} AS s FROM (SELECT query_id, id, score, rank, {WORDS.format('text')} AS w FROM den JOIN documents ON doc_id = id WHERE rank <= 15 AND score >= 0.1))"


@query(f"WITH RECURSIVE {DENSE}, {POOL}, {NEAR_BY_RANK} SELECT query_id, id, score, rank FROM dedup WHERE rank <= 5")
def ret11_dense_with_threshold(s: SparkSession, d: str) -> DataFrame:
    return facade.searched(_dense(s, d, 15), _entries(s, d), 5, 0.1).drop("text")


@query(f"WITH RECURSIVE {DENSE}, {POOL}, {NEAR_BY_RANK}, t AS (SELECT d.query_id, rank, id, score, text FROM dedup d JOIN documents ON doc_id = id WHERE rank <= 3) SELECT item_id AS query_id, (SELECT string_agg(concat('d', id, '|', printf('%.2f', score)), ',' ORDER BY rank) FROM t WHERE t.query_id = item_id) AS preview FROM benchmark".replace("printf('%.2f', score)", "round(score, 3)"))
def ret19_content_fields(s: SparkSession, d: str) -> DataFrame:
    results = facade.searched(_dense(s, d, 15), _entries(s, d), 3, 0.1).withColumn("path", F.concat(F.lit("d"), "id"))
    return facade.content_fields(_items(s, d), results, 3).select("query_id", F.nullif("preview", F.lit("")).alias("preview"))


@query(f"WITH {DENSE} SELECT query_id, 0.5::DOUBLE AS threshold, max(score) AS best_score, count(*) AS candidates FROM den WHERE rank <= 30 AND rank > 1 GROUP BY query_id HAVING count_if(score >= 0.5) = 0")
def sub07_low_confidence(s: SparkSession, d: str) -> DataFrame:
    return facade.low_confidence(_dense(s, d).where("rank > 1"), 0.5)


@query(f"WITH RECURSIVE {BM25}, {DENSE}, {FUSED}, cand AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, {SHINGLES} AS s FROM (SELECT query_id, id, score, rank, {WORDS.format('text')} AS w FROM fus JOIN documents ON doc_id = id WHERE rank <= 15)), {NEAR_BY_RANK} SELECT item_id AS query_id, (SELECT count(*) FROM lex WHERE query_id = item_id AND rank <= 30) AS lexical_hits, (SELECT count(*) FROM den WHERE query_id = item_id AND rank <= 30) AS dense_hits, (SELECT count(*) FROM dedup WHERE query_id = item_id) AS results, (SELECT count(*) FROM cand WHERE query_id = item_id) - (SELECT count(*) FROM dedup WHERE query_id = item_id) AS deduplicated, item_id % 9 = 0 AS abstained FROM benchmark")
def sub08_retrieval_events(s: SparkSession, d: str) -> DataFrame:
    lex, den = _lexical(s, d), _dense(s, d)
    before = retrieve.fused([den, lex], 15).join(_entries(s, d), "id").select("query_id", "id", "score", "rank", "text")
    items = _items(s, d)
    return facade.retrieval_events(items, lex, den, before, retrieve.deduplicated(before), items.where("query_id % 9 = 0"))


@query(f"WITH {BM25}, {DENSE}, {TRUTH}, r AS (SELECT 'lexical' AS engine, query_id, id, rank FROM lex WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, id, rank FROM den WHERE rank <= 10), f AS (SELECT engine, q.query_id, min(rank) AS first FROM (SELECT DISTINCT query_id FROM tru) q CROSS JOIN (SELECT unnest(['lexical', 'dense']) AS engine) e LEFT JOIN (SELECT * FROM r WHERE (query_id, id) IN (SELECT query_id, id FROM tru)) h USING (engine, query_id) GROUP BY 1, 2) SELECT engine, count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 9) AS hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0.0 END), 9) AS mrr FROM f GROUP BY 1")
def evl02_compared_engines(s: SparkSession, d: str) -> DataFrame:
    return facade.compared({"lexical": _lexical(s, d, 10), "dense": _dense(s, d, 10)}, _truth(s, d))


INTENT = "CASE query_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'docs' ELSE 'both' END"


@query(f"""WITH {BM25}, {DENSE}, {TRUTH}, t AS (SELECT *, {INTENT} AS intent FROM tru), r AS (SELECT 'search_code' AS surface, 'code' AS intent, query_id, id, rank FROM lex WHERE rank <= 10 UNION ALL SELECT 'search_docs', 'docs', query_id, id, rank FROM den WHERE rank <= 10),
f AS (SELECT x.surface, q.query_id, min(h.rank) AS first FROM (SELECT DISTINCT query_id, intent FROM t WHERE intent <> 'both') q JOIN (SELECT DISTINCT surface, intent FROM (VALUES ('search_code', 'code'), ('search_docs', 'docs')) v(surface, intent)) x ON x.intent = q.intent LEFT JOIN (SELECT * FROM r WHERE (query_id, id) IN (SELECT query_id, id FROM tru)) h ON h.surface = x.surface AND h.query_id = q.query_id GROUP BY 1, 2)
SELECT surface, count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 9) AS hit_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 9) AS hit_5, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0.0 END), 9) AS mrr FROM f GROUP BY 1
UNION ALL SELECT 'union', count(*), NULL, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9), NULL FROM (SELECT query_id, bool_or((query_id, id) IN (SELECT query_id, id FROM r WHERE rank <= 5)) AS hit FROM t WHERE intent = 'both' GROUP BY query_id)""")
def evl03_fused_evaluation(s: SparkSession, d: str) -> DataFrame:
    truth = _truth(s, d).withColumn("intent", F.expr(INTENT))
    return facade.fused_evaluation({"search_code": _lexical(s, d, 10), "search_docs": _dense(s, d, 10)}, truth, (1, 5), 5)


@query(f"WITH {BM25}, sy AS (SELECT item_id AS query_id, concat('s', doc_id) AS id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY concat('s', doc_id)) AS INTEGER) AS rank FROM benchmark JOIN documents ON doc_id % 50 = item_id % 50 WHERE item_id % 2 = 0) SELECT query_id, concat('d', id) AS id, rank FROM lex WHERE rank <= 5 AND query_id % 2 = 1 UNION ALL SELECT query_id, id, rank FROM sy")
def evl01_by_kind(s: SparkSession, d: str) -> DataFrame:
    results = _lexical(s, d, 5).withColumn("id", F.concat(F.lit("d"), "id"))
    c = F.col("query_id")
    cases = _items(s, d).select("query_id", F.concat(F.lit("name"), c % 50).alias("query"), F.when(c % 2 == 0, "symbol").alias("kind"))
    symbols = _docs(s, d).select(F.concat(F.lit("name"), F.col("doc_id") % 50).alias("name"), F.concat(F.lit("s"), "doc_id").alias("ref"))
    return facade.by_kind(results, symbols, cases)


PATHS = "CASE doc_id % 4 WHEN 0 THEN ['src/a', 'lib/b'] WHEN 1 THEN ['lib/b'] WHEN 2 THEN ['src/c/d', 'src/e'] ELSE [] END"


def _cases(s, d):
    c = F.col("doc_id")
    text = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    expected = F.when(c % 4 == 0, text("src/a", "lib/b")).when(c % 4 == 1, text("lib/b")).when(c % 4 == 2, text("src/c/d", "src/e")).otherwise(text())
    return _docs(s, d).select(c.alias("query_id"), F.when(c % 7 == 0, " ").otherwise("q").alias("query"), expected.alias("expected"), F.when(c % 5 == 0, "both").when(c % 5 == 1, "code").when(c % 5 == 2, "other").alias("intent"))


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'c/d,e' END AS expected FROM documents WHERE doc_id % 4 IN (0, 2)")
def evl06_rebased(s: SparkSession, d: str) -> DataFrame:
    return facade.rebased(_cases(s, d), "src/").select("query_id", F.array_join("expected", ",").alias("expected"))


@query(f"SELECT doc_id AS query_id, unnest({PATHS}) AS path FROM documents WHERE doc_id % 5 = 0")
def sub27_ground_truth(s: SparkSession, d: str) -> DataFrame:
    return facade.ground_truth(_cases(s, d), "both")


@query("SELECT doc_id AS query_id, CASE WHEN doc_id % 7 = 0 THEN 'query' WHEN doc_id % 4 = 3 THEN 'expected' WHEN doc_id % 5 = 2 THEN 'intent' END AS fault FROM documents")
def sub28_case_faults(s: SparkSession, d: str) -> DataFrame:
    return _cases(s, d).select("query_id", facade.case_fault(F.col("query"), F.col("expected"), F.col("intent")).alias("fault"))


@query(f"WITH {BM25}, {TRUTH}, f AS (SELECT t.query_id, min(rank) AS first FROM (SELECT DISTINCT query_id FROM tru) t LEFT JOIN (SELECT * FROM lex WHERE rank <= 10 AND (query_id, id) IN (SELECT query_id, id FROM tru)) l USING (query_id) GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 9) AS hit_3, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0.0 END), 9) AS mrr, false AS regressed FROM f")
def sub31_evaluation_event(s: SparkSession, d: str) -> DataFrame:
    report = evaluate.report(_lexical(s, d, 10), _truth(s, d), (3,))
    verdict = evaluate.regression(report.select(F.lit("mrr").alias("name"), F.col("mrr").alias("value")), report.select(F.lit("mrr").alias("name"), F.col("mrr").alias("value")))
    return facade.evaluation_event(report, verdict)


@query("SELECT event_type AS area, CASE WHEN bool_or(event_id % 100 = 7 AND event_type < 'f') THEN 'fail' WHEN bool_or(event_id % 50 = 3 AND event_type < 'q') THEN 'warn' ELSE 'pass' END AS status FROM events GROUP BY 1")
def sub24_worst_of_an_area(s: SparkSession, d: str) -> DataFrame:
    c, t = F.col("event_id"), F.col("event_type")
    severity = F.when((c % 100 == 7) & (t < "f"), "fail").when((c % 50 == 3) & (t < "q"), "warn")
    return facade.worst(table(s, d, "events").select(t.alias("area"), severity.alias("severity")))


@query("""WITH a AS (SELECT CAST(place AS INTEGER) AS place, area, coalesce(max(CASE WHEN event_id % 100 = 7 AND event_type < 'f' THEN 2 WHEN event_id % 50 = 3 THEN 1 ELSE 0 END), 0) AS s
  FROM (SELECT unnest(['config', 'provider', 'index', 'mcp']) AS area, unnest([0, 1, 2, 3]) AS place) LEFT JOIN events ON area = CASE event_type WHEN 'click' THEN 'config' WHEN 'view' THEN 'provider' WHEN 'purchase' THEN 'index' END GROUP BY 1, 2)
SELECT place, area, list_extract(['pass', 'warn', 'fail'], CAST(s + 1 AS INTEGER)) AS status, list_extract(['pass', 'warn', 'fail'], CAST((SELECT max(s) FROM a) + 1 AS INTEGER)) AS overall FROM a""")
def agg16_health(s: SparkSession, d: str) -> DataFrame:
    """Problems that the events tell, rolled up by area; an area without events passes."""
    c, t = F.col("event_id"), F.col("event_type")
    area = F.when(t == "click", "config").when(t == "view", "provider").when(t == "purchase", "index")
    return facade.health(table(s, d, "events").select(area.alias("area"), F.when((c % 100 == 7) & (t < "f"), "fail").when(c % 50 == 3, "warn").alias("severity")))


@query("SELECT 'config' AS area, r_name AS key, 'fail' AS severity FROM region WHERE r_regionkey % 2 = 0 OR r_regionkey = 3")
def hlt01_config_problems(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "region")
    required = tuple(r["r_name"] for r in rows.orderBy("r_regionkey").select("r_name").collect())  # a fixed table of five rows stands for the settings
    return facade.config_problems(rows.where("r_regionkey % 2 = 1").select(F.col("r_name").alias("key"), F.when(F.col("r_regionkey") == 3, " ").otherwise("set").alias("value")), required)


@query(f"WITH {BM25} SELECT query_id, id, rank FROM lex WHERE rank <= 3")
def src16_stored_index(s: SparkSession, d: str) -> DataFrame:
    """The index written to a folder of its own, read again and asked."""
    index = lexical.indexed(_docs(s, d))
    return lexical.ranked(lexical.best(index, _items(s, d), 3), 3).select("query_id", "id", "rank")


# ---- suites as files ---------------------------------------------------------------------------


def _suite(s: SparkSession, d: str) -> DataFrame:
    """Cases of the documents in 20 suites: some faulty, some of the graph."""
    c, none = F.col("doc_id"), F.lit(None).cast("string")
    graph_case = c % 4 == 0
    rows = table(s, d, "documents").withColumn("place", F.row_number().over(Window.partitionBy(c % 20, graph_case).orderBy(c)) - 1)
    return rows.select(
        F.concat(F.lit("s"), c % 20).alias("path"), F.col("place").cast("int").alias("place"), F.when(graph_case, "graph_case").otherwise("case").alias("form"),
        F.when(~graph_case, F.concat(F.lit('say "'), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), r"[\x00-\x08\x0b-\x1f\x7f]", ""), F.lit('"\n\\'), c)).alias("query"),
        F.when(graph_case, F.when(c % 8 == 0, "defines").otherwise("who_calls")).alias("relation"), F.when(graph_case, F.concat(F.lit("t"), c)).alias("target"),
        F.when(graph_case & (c % 3 == 0), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("a/"), c), F.lit("b"))).alias("expected"),
        F.when(~graph_case & (c % 3 == 0), "nl").alias("kind"), F.when(~graph_case & (c % 5 == 1), "code").when(~graph_case & (c % 5 == 2), "unknown").alias("intent"), none.alias("fault"), c.alias("doc_id"),
    )


@query(r"""SELECT concat('s', doc_id % 20) AS path, CASE WHEN doc_id % 4 = 0 THEN 'graph_case' ELSE 'case' END AS form, CASE WHEN doc_id % 4 <> 0 THEN sha256(concat('say "', regexp_replace(left(coalesce(text, ''), 60), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g'), '"', chr(10), chr(92), doc_id)) END AS query_sha256,
CASE WHEN doc_id % 4 = 0 THEN concat('t', doc_id) END AS target, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN '' ELSE concat('a/', doc_id, ',b') END AS expected, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN 'nl' END AS kind,
CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 = 1 THEN 'code' WHEN doc_id % 4 <> 0 AND doc_id % 5 = 2 THEN 'unknown' END AS intent, CASE WHEN doc_id % 4 <> 0 AND doc_id % 5 = 2 THEN 'intent' END AS fault FROM documents""")
def src24_suites_written_and_read(s: SparkSession, d: str) -> DataFrame:
    """Suites written as TOML and read again, with the faults of their cases."""
    found = suites.parsed(suites.text_of(_suite(s, d)))
    return found.select("path", "form", F.sha2("query", 256).alias("query_sha256"), "target", F.array_join("expected", ",").alias("expected"), "kind", "intent", "fault")


@query("""SELECT concat('s', doc_id % 20) AS path, CASE WHEN doc_id % 4 = 0 THEN 'graph_case' ELSE 'case' END AS form, count(*) AS n, count_if(doc_id % 7 = 0 AND doc_id % 4 <> 0) AS amended FROM documents GROUP BY 1, 2""")
def snk14_suites_added_to(s: SparkSession, d: str) -> DataFrame:
    """Suites that got two thirds of their cases, then all of them twice, and of every seventh case another kind."""
    whole = _suite(s, d).withColumn("intent", F.when(F.col("intent") == "code", "code"))
    first = whole.where("doc_id % 3 <> 1").drop("doc_id")
    new = whole.drop("place", "fault", "doc_id")
    once, _ = suites.added(first, new)
    twice, _ = suites.added(suites.parsed(suites.text_of(once)), new)
    changes = whole.where("doc_id % 7 = 0 and form = 'case'").select("path", "query", F.lit(None).cast("array<string>").alias("expected"), F.lit("amended").alias("kind"), F.lit(None).cast("string").alias("intent"))
    rows = suites.amended(twice, changes)
    return rows.groupBy("path", "form").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "amended").alias("amended"))


@query("""WITH m AS (SELECT source AS path, unnest(['mrr', 'queries', 'hit_1', 'hit_10']) AS name, unnest([avg(n_chars), count(*), avg(CAST(doc_id % 2 AS DOUBLE)), 1.0]) AS value FROM documents GROUP BY source) SELECT path, 'ir' AS form, name, round(value, 9) AS value FROM m""")
def src25_baselines_written_and_read(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").groupBy(F.col("source").alias("path")).agg(F.avg("n_chars").alias("mrr"), F.count("*").cast("double").alias("queries"), F.avg((F.col("doc_id") % 2).cast("double")).alias("hit_1"), F.lit(1.0).alias("hit_10"))
    long = rows.unpivot("path", ["mrr", "queries", "hit_1", "hit_10"], "name", "value")
    return suites.baselines(suites.baseline_text(long, "2024-01-01T00:00:00Z", 'own "x"')).select("path", "form", "name", F.round("value", 9).alias("value"))


GROUPS = "gr AS (SELECT *, min(doc_id) OVER (PARTITION BY source) AS g FROM documents), so AS (SELECT DISTINCT source AS collection, g FROM gr)"


@query(f"""WITH {GROUPS}, st AS (SELECT source AS collection, count(*) AS n, bool_or((g % 4 = 1 AND doc_id % 7 = 0) OR (g % 4 = 2 AND doc_id % 11 = 3)) AS stale FROM gr WHERE doc_id % 5 <> 4 AND g % 4 <> 0 GROUP BY 1),
pr AS (SELECT so.collection, g % 3 = 0 AS no_end, g % 5 = 0 AS no_key, g % 7 = 1 AS away, n IS NULL AS absent, coalesce(stale, false) AS stale, g % 2 = 0 AS registered, g % 6 = 0 AS moves FROM so LEFT JOIN st USING (collection)),
ar AS (SELECT collection, 0 AS place, 'config' AS area, CASE WHEN no_end OR no_key THEN 'env_missing_key' ELSE '' END AS codes, CASE WHEN no_end OR no_key THEN 2 ELSE 0 END AS r FROM pr
  UNION ALL SELECT collection, 1, 'provider', CASE WHEN no_end THEN 'provider_config_incomplete' WHEN away THEN 'provider_unreachable' ELSE '' END, CASE WHEN no_end THEN 2 WHEN away THEN 1 ELSE 0 END FROM pr
  UNION ALL SELECT collection, 2, 'index', CASE WHEN absent THEN 'index_absent' WHEN stale THEN 'index_stale' ELSE '' END, CASE WHEN absent THEN 2 WHEN stale THEN 1 ELSE 0 END FROM pr
  UNION ALL SELECT collection, 3, 'mcp', CASE WHEN NOT registered THEN 'mcp_not_registered' WHEN moves THEN 'mcp_invocation_moves_cwd' WHEN stale THEN 'mcp_stale_after_reindex' ELSE '' END, CASE WHEN NOT registered OR moves OR stale THEN 1 ELSE 0 END FROM pr)
SELECT collection, CAST(place AS INTEGER) AS place, area, list_extract(['pass', 'warn', 'fail'], r + 1) AS status, codes, list_extract(['pass', 'warn', 'fail'], CAST(max(r) OVER (PARTITION BY collection) + 1 AS INTEGER)) AS overall FROM ar""")
def hlt02_health_of_collections(s: SparkSession, d: str) -> DataFrame:
    """Every source as a collection, with settings, probe, server, manifest and files that its first document decides."""
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("collection"), "text")
    groups = docs.groupBy("collection").agg(F.min("doc_id").alias("g"))
    rows = docs.join(groups, "collection")
    c, g = F.col("doc_id"), F.col("g")
    path, digest = c.cast("string").alias("path"), F.xxhash64("text").cast("string")
    manifests = rows.where("doc_id % 5 <> 4").select("collection", F.when(g % 4 == 0, "0").otherwise("1").alias("version"), path, c.alias("mtime"), digest.alias("content_hash"))
    touched = c % 7 == 0
    stats = rows.where("not (g % 4 = 2 and doc_id % 11 = 3)").select("collection", path, (c + touched.cast("long")).alias("mtime"), F.when(touched & (g % 4 == 1), F.concat(digest, F.lit("x"))).otherwise(digest).alias("content_hash"))
    end, key = F.struct(F.lit("ENDPOINT").alias("key"), F.when(g % 3 != 0, "set").alias("value")), F.struct(F.lit("KEY").alias("key"), F.when(g % 5 == 0, " ").otherwise("set").alias("value"))
    settings = groups.select("collection", F.explode(F.array(end, key)).alias("x")).select("collection", "x.*")
    needs = settings.select("collection", "key")
    fresh = health.freshness(groups, manifests, stats)
    problems = (
        health.config(groups, needs, settings), health.provider(groups, needs.where("key = 'ENDPOINT'"), settings, groups.select("collection", F.when(g % 7 == 1, "unreachable").otherwise("reachable").alias("status"))),
        health.index(fresh), health.server(fresh, groups.select("collection", (g % 2 == 0).alias("registered"), F.array(F.lit("run"), F.when(g % 6 == 0, "--directory").otherwise("--project")).alias("invocation"))),
    )
    return health.report(groups, *problems).withColumn("codes", F.array_join("codes", ","))
