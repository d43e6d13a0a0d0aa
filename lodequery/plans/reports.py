"""Queries over telemetry, graph, memory, incremental index, chunking and scalar functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions import text as T
from lodequery.operators import chunking, graph, incremental, memory, observe
from lodequery.plans.index import SECTIONS
from lodequery.sources.tables import GRAPH_SQL, TELEMETRY_SQL, table, telemetry
from lodequery.sources.tables import graph as graph_tables

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def tel(sql: str) -> str:
    return f"WITH {TELEMETRY_SQL} {sql}"


DAY, HOUR = "strftime(ts, '%Y-%m-%d')", "strftime(ts, '%Y-%m-%dT%H')"


@query(tel("SELECT event_id, ts, elapsed_ms FROM tel WHERE operation = 'index' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'"))
def src19_event_window(s: SparkSession, d: str) -> DataFrame:
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    return observe.window(telemetry(s, d), "index", lit("2024-01-05"), lit("2024-01-20")).select("event_id", "ts", "elapsed_ms")


@query(tel(f"SELECT {DAY} AS bucket, sum(hits)::BIGINT AS hits, sum(misses)::BIGINT AS misses, CAST(NULL AS BIGINT) AS tokens_saved FROM tel WHERE operation = 'embeddings_cache' GROUP BY 1 UNION ALL SELECT NULL, sum(CASE WHEN operation = 'embeddings_cache' THEN hits END)::BIGINT, sum(CASE WHEN operation = 'embeddings_cache' THEN misses END)::BIGINT, CAST(round_even(sum(CASE WHEN operation = 'embeddings_cache' THEN hits END) * sum(CASE WHEN operation = 'embeddings' THEN tokens END) / sum(CASE WHEN operation = 'embeddings' THEN texts END), 0) AS BIGINT) FROM tel"))
def agg01_cache_report(s: SparkSession, d: str) -> DataFrame:
    return observe.cache_report(telemetry(s, d))


@query(tel(f"SELECT provider, bucket, sum(tokens)::BIGINT AS tokens FROM (SELECT provider, {DAY} AS bucket, tokens FROM tel WHERE operation = 'embeddings' AND tokens IS NOT NULL) GROUP BY GROUPING SETS ((provider), (bucket), ())"))
def agg02_cost_report(s: SparkSession, d: str) -> DataFrame:
    return observe.cost_report(telemetry(s, d))


@query(tel(f"SELECT bucket, ts, documents, chunks FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ts DESC, event_id DESC) AS r FROM (SELECT *, {DAY} AS bucket FROM tel WHERE operation = 'index')) WHERE r = 1 UNION ALL SELECT * FROM (SELECT NULL, ts, documents, chunks FROM tel WHERE operation = 'index' ORDER BY ts DESC, event_id DESC LIMIT 1)"))
def agg03_health_report(s: SparkSession, d: str) -> DataFrame:
    return observe.health_report(telemetry(s, d))


@query(tel("SELECT operation, quantile_disc(elapsed_ms, 0.5) AS p50_ms, quantile_disc(elapsed_ms, 0.95) AS p95_ms, count(*) AS n FROM tel WHERE operation IN ('index', 'retrieve') GROUP BY 1"))
def agg04_latency_report(s: SparkSession, d: str) -> DataFrame:
    return observe.latency_report(telemetry(s, d))


@query(tel("SELECT count_if(operation = 'embeddings_error') AS errors, count_if(operation = 'embeddings_retry') AS retries, count_if(operation = 'low_confidence') AS low_confidence, count_if(operation = 'retrieve') AS retrieves, count_if(operation = 'low_confidence') / count_if(operation = 'retrieve') AS low_confidence_rate FROM tel"))
def agg06_reliability_report(s: SparkSession, d: str) -> DataFrame:
    return observe.reliability_report(telemetry(s, d))


@query(tel("SELECT sum(CASE WHEN operation = 'embeddings_cache' THEN hits END)::BIGINT AS cache_hits, sum(CASE WHEN operation = 'embeddings_cache' THEN misses END)::BIGINT AS cache_misses, sum(CASE WHEN operation = 'embeddings' THEN tokens END)::BIGINT AS tokens, max(CASE WHEN operation = 'index' THEN ts END) AS last_index_ts, count_if(operation = 'retrieve') AS retrieves, count_if(operation = 'retrieve' AND hits > 0) AS with_hits, count_if(operation = 'retrieve' AND hits > 0) / count_if(operation = 'retrieve') AS hit_rate FROM tel"))
def agg07_live_snapshot(s: SparkSession, d: str) -> DataFrame:
    return observe.snapshot(telemetry(s, d))


@query(tel("SELECT event_id, ts, operation FROM tel ORDER BY ts DESC, event_id DESC LIMIT 20"))
def win06_recent_events(s: SparkSession, d: str) -> DataFrame:
    return observe.recent(telemetry(s, d), 20).select("event_id", "ts", "operation")


@query(tel(f"SELECT {HOUR} AS bucket, count(*) AS n FROM tel GROUP BY 1"))
def scl03_time_buckets(s: SparkSession, d: str) -> DataFrame:
    return telemetry(s, d).groupBy(T.bucket(F.col("ts"), "hour").alias("bucket")).agg(F.count("*").alias("n"))


@query(tel("SELECT event_id, CASE WHEN x < 60 THEN x || 's' WHEN x < 3600 THEN (x // 60) || 'm' WHEN x < 86400 THEN (x // 3600) || 'h' ELSE (x // 86400) || 'd' END AS age, CASE WHEN hits > 0 THEN 'hit' WHEN misses > 3 THEN 'abstained' ELSE 'miss' END AS verdict FROM (SELECT *, CAST(floor(elapsed_ms * 900) AS BIGINT) AS x FROM tel)"))
def scl05_ages_and_verdicts(s: SparkSession, d: str) -> DataFrame:
    return telemetry(s, d).select("event_id", T.age(F.col("elapsed_ms") * 900).alias("age"), observe.verdict(F.col("hits"), F.col("misses") > 3).alias("verdict"))


def gr(sql: str) -> str:
    return f"WITH {GRAPH_SQL} {sql}"


@query(gr("SELECT 'node ' || kind AS what, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'edge ' || type, count(*) FROM edges GROUP BY 1"))
def agg13_graph_counts(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_tables(s, d)
    return graph.counts(nodes, "kind").select(F.concat(F.lit("node "), "kind").alias("what"), "n").unionByName(graph.counts(edges, "type").select(F.concat(F.lit("edge "), "type").alias("what"), "n"))


NAMES = "names AS (SELECT DISTINCT name FROM nodes WHERE CAST(substr(id, 2) AS BIGINT) % 20 = 0)"


def _names(nodes):
    """Names of every symbol whose key is divisible by 20."""
    return nodes.where("cast(substring(id, 2) as bigint) % 20 = 0").select("name")


@query(gr(f", {NAMES} SELECT name, path || '#' || name AS ref, kind, path, line FROM nodes SEMI JOIN names USING (name)").replace(") ,", "),", 1))
def grf05_find_symbol(s: SparkSession, d: str) -> DataFrame:
    nodes, _ = graph_tables(s, d)
    return graph.find_symbol(nodes, _names(nodes))


CALLERS = "cal AS (SELECT DISTINCT t.name, s.id FROM edges JOIN nodes t ON t.id = target JOIN nodes s ON s.id = source WHERE type = 'calls' AND t.name IN (SELECT name FROM names))"


@query(gr(f", {NAMES}, {CALLERS} SELECT cal.name, id, path || '#' || n.name AS ref FROM cal JOIN nodes n USING (id)"))
def grf06_who_calls(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_tables(s, d)
    return graph.related(nodes, edges, _names(nodes), "calls").select("name", "id", "ref")


@query(gr(f""", {NAMES}, {CALLERS}, callees AS (SELECT DISTINCT s.name, t.id FROM edges JOIN nodes t ON t.id = target JOIN nodes s ON s.id = source WHERE type = 'calls' AND s.name IN (SELECT name FROM names)),
sec AS (SELECT n.name, 'definitions' AS section, path || '#' || n.name AS ref, 10 AS most FROM nodes n SEMI JOIN names USING (name)
UNION ALL SELECT cal.name, 'callers', path || '#' || n.name, 8 FROM cal JOIN nodes n USING (id) UNION ALL SELECT callees.name, 'callees', path || '#' || n.name, 8 FROM callees JOIN nodes n USING (id))
SELECT name, section, ref, total, place FROM (SELECT *, count(*) OVER (PARTITION BY name, section) AS total, CAST(row_number() OVER (PARTITION BY name, section ORDER BY ref) AS INTEGER) AS place FROM sec) WHERE place <= most"""))
def grf08_context(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_tables(s, d)
    return graph.context(nodes, edges, _names(nodes))


EVERY_NAME = "names AS (SELECT DISTINCT name FROM nodes)"


def for_every_name(sql: str) -> str:
    return sql.replace(NAMES, EVERY_NAME)


@query(for_every_name(ORACLES["grf05_find_symbol"]))
def grf05b_find_every_symbol(s: SparkSession, d: str) -> DataFrame:
    nodes, _ = graph_tables(s, d)
    return graph.find_symbol(nodes, nodes.select("name"))


@query(for_every_name(ORACLES["grf06_who_calls"]))
def grf06b_who_calls_every_symbol(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_tables(s, d)
    return graph.related(nodes, edges, nodes.select("name"), "calls").select("name", "id", "ref")


@query(for_every_name(ORACLES["grf08_context"]))
def grf08b_context_of_every_symbol(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_tables(s, d)
    return graph.context(nodes, edges, nodes.select("name"))


@query(gr("SELECT DISTINCT name FROM nodes"))
def grf09_list_symbols(s: SparkSession, d: str) -> DataFrame:
    return graph_tables(s, d)[0].select("name").distinct()


#: A part's name for call sites that stays selective at any size. Of ten keys in a row seven have a name of their own,
#: two share one, and the tenths share one by three, which is ambiguous.
SITE_NAME = "CASE WHEN p_partkey % 10 = 0 THEN concat('tenths ', CAST(floor(p_partkey / 30) AS BIGINT)) WHEN p_partkey % 10 <= 2 THEN concat('pair ', CAST(floor(p_partkey / 10) AS BIGINT)) ELSE concat(p_name, '#', p_brand, '#', p_partkey) END"


@query(f"WITH def AS (SELECT p_partkey AS key, {SITE_NAME} AS name FROM part), tg AS (SELECT name FROM def GROUP BY name HAVING count(DISTINCT key) <= 2) SELECT DISTINCT 's' || l_suppkey AS source, 'p' || d.key AS target FROM lineitem JOIN def c ON c.key = l_partkey JOIN def d ON d.name = c.name JOIN tg ON tg.name = d.name")
def jon07b_resolved_calls_by_full_name(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.expr(SITE_NAME).alias("name"))
    _, edges = graph_tables(s, d)
    sites = edges.where("type = 'calls'").join(parts.select(F.col("id").alias("target"), F.col("name").alias("callee")), "target").select("source", "callee")
    return graph.resolved_calls(sites, parts)


#: Each part under its plain name, which few sizes leave selective, and under that of SITE_NAME.
BOTH_NAMES = f"def AS (SELECT p_partkey AS key, p_name AS name FROM part UNION SELECT p_partkey, {SITE_NAME} FROM part)"


@query(f"WITH {BOTH_NAMES}, tg AS (SELECT name FROM def GROUP BY name HAVING count(DISTINCT key) <= 40) SELECT DISTINCT 's' || l_suppkey AS source, 'p' || d.key AS target FROM lineitem JOIN def c ON c.key = l_partkey JOIN def d ON d.name = c.name JOIN tg ON tg.name = d.name")
def jon07_resolved_calls(s: SparkSession, d: str) -> DataFrame:
    """Calls under both names of what they call, to all definitions of a name that has at most 40."""
    part = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.explode(F.array("p_name", F.expr(SITE_NAME))).alias("name"))
    parts = part.where("name is not null").distinct()
    parts = parts.join(parts.groupBy("name").count().where("count <= 40"), "name", "left_semi")  # a name of more definitions resolves no call, so no site has to carry it
    _, edges = graph_tables(s, d)
    sites = edges.where("type = 'calls'").join(parts.select(F.col("id").alias("target"), F.col("name").alias("callee")), "target").select("source", "callee")
    return graph.resolved_calls(sites, parts, 40)


@query("SELECT DISTINCT doc_id, w AS id, w AS name FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS w FROM documents) WHERE w IN (SELECT DISTINCT unnest(string_split(text, ' ')) FROM benchmark) AND (length(w) >= 5 OR regexp_matches(w, '^.+[A-Z]') OR contains(w, '_'))")
def jon09_mentions(s: SparkSession, d: str) -> DataFrame:
    words = table(s, d, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).distinct().select(F.col("name").alias("id"), "name")
    return graph.mentions(table(s, d, "documents"), words)


SESSION = "conv AS (SELECT conv_id AS session_key, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '')"


def _turns(s, d):
    return memory.turn_rows(table(s, d, "conversations").withColumnRenamed("conv_id", "session_key"))


@query(f"WITH {SESSION} SELECT session_key, turn_index, role, text FROM conv")
def src09_transcript_turns(s: SparkSession, d: str) -> DataFrame:
    return _turns(s, d).select("session_key", "turn_index", "role", "text")


@query(f"WITH {SESSION}, ses AS (SELECT DISTINCT conv_id AS session_key, (conv_id * 7919) % 1000 AS captured_at FROM conversations), l AS (SELECT * FROM ses ORDER BY captured_at DESC, session_key LIMIT 20) SELECT l.session_key, captured_at, count(conv.turn) AS turn_count FROM l LEFT JOIN conv USING (session_key) GROUP BY 1, 2")
def src22_recent_sessions(s: SparkSession, d: str) -> DataFrame:
    sessions = table(s, d, "conversations").select(F.col("conv_id").alias("session_key"), ((F.col("conv_id") * 7919) % 1000).alias("captured_at")).distinct()
    return memory.listed(sessions, _turns(s, d), 20)


@query(f"""WITH {SESSION}, w AS (SELECT session_key, turn_index, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM conv),
sz AS (SELECT count(*) AS turns, avg(len(w)) AS avg_len FROM w), q(query_id, a, b) AS (VALUES (1, 'the', 'of'), (2, 'and', 'in'), (3, 'de', 'la')),
ph AS (SELECT query_id, 0 AS phrase, a AS p FROM q UNION ALL SELECT query_id, 1, b FROM q),
tf AS (SELECT query_id, phrase, session_key, turn_index, len(w) AS len, len(list_filter(w, lambda x: x = p)) AS tf FROM w, ph), t AS (SELECT * FROM tf WHERE tf > 0),
df AS (SELECT query_id, phrase, count(*) AS df FROM t GROUP BY 1, 2),
s AS (SELECT query_id, session_key, turn_index, count(*) AS n, round(sum(greatest(ln((turns - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM t JOIN df USING (query_id, phrase), sz GROUP BY 1, 2, 3)
SELECT query_id, session_key, turn_index, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_key DESC, turn_index DESC) AS INTEGER) AS rank FROM s WHERE n = 2) WHERE rank <= 20""")
def mem01_full_text_search(s: SparkSession, d: str) -> DataFrame:
    asked = s.createDataFrame([(1, "the of"), (2, "and in"), (3, "de la")], "query_id int, query string")
    return memory.full_text(_turns(s, d), asked, 20)


STATE = """a AS (SELECT 'd' || doc_id AS path, n_chars AS mtime, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 13 = 0 THEN 'v1' ELSE 'v2' END AS lv FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS mtime, sha256(text) AS h, 'v2' AS lv FROM documents WHERE doc_id % 11 <> 0),
cl AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.lv <> b.lv THEN 'modified' WHEN a.mtime = b.mtime THEN 'unchanged' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS class FROM a FULL JOIN b ON a.path = b.path)"""


def _states(s, d):
    docs = table(s, d, "documents").withColumn("path", F.concat(F.lit("d"), "doc_id"))
    c = F.col
    old = docs.where("doc_id % 7 <> 0").select("path", c("n_chars").alias("mtime"), F.sha2(F.when(c("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(c("text")), 256).alias("content_hash"), F.when(c("doc_id") % 13 == 0, "v1").otherwise("v2").alias("logic_version"))
    new = docs.where("doc_id % 11 <> 0").select("path", F.when(c("doc_id") % 3 == 0, c("n_chars") + 1).otherwise(c("n_chars")).alias("mtime"), F.sha2("text", 256).alias("content_hash"), F.lit("v2").alias("logic_version"))
    return old, new


@query(f"WITH {STATE} SELECT path, class FROM cl")
def idx03_classify(s: SparkSession, d: str) -> DataFrame:
    return incremental.classified(*_states(s, d))


@query(f"WITH {STATE} SELECT count_if(class = 'new') AS new, count_if(class = 'modified') AS modified, count_if(class = 'deleted') AS deleted, count_if(class = 'unchanged') AS unchanged FROM cl")
def idx08_counters(s: SparkSession, d: str) -> DataFrame:
    return incremental.counters(incremental.classified(*_states(s, d)))


@query(f"WITH {STATE} SELECT a.path, CASE WHEN b.path IS NULL THEN 'vanished' ELSE 'changed' END AS reason FROM a LEFT JOIN b ON a.path = b.path WHERE b.path IS NULL OR (a.mtime <> b.mtime AND a.h <> b.h)")
def idx09_stale(s: SparkSession, d: str) -> DataFrame:
    return incremental.stale(*_states(s, d))


@query(f"WITH {STATE} SELECT path, mtime, h AS content_hash, lv AS logic_version FROM b UNION ALL SELECT path, mtime, h, lv FROM a WHERE path NOT IN (SELECT path FROM b)")
def snk01_upsert(s: SparkSession, d: str) -> DataFrame:
    return incremental.upserted(*_states(s, d), ["path"])


@query(f"WITH {STATE} SELECT path, mtime, h AS content_hash, lv AS logic_version FROM a UNION ALL SELECT path, mtime, h, lv FROM b WHERE path NOT IN (SELECT path FROM a)")
def snk09_insert_or_ignore(s: SparkSession, d: str) -> DataFrame:
    return incremental.inserted_or_ignored(*_states(s, d), ["path"])


@query("SELECT 'm' AS model, sha256(text) AS content_hash, min(text) AS text FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY sha256(text)")
def emb09_cache_misses(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").withColumn("model", F.lit("m"))
    return incremental.cache_misses(docs, docs.where("lang = 'en'").select("model", F.sha2("text", 256).alias("content_hash")))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\bsk-[A-Za-z0-9_-]{8,}\\b', '[REDACTED]', 'g'), '\\bAKIA[0-9A-Z]{16}\\b', '[REDACTED]', 'g'), '(?i)\\b(?:authorization\\s*:?\\s*)?bearer\\s+[A-Za-z0-9._~+/=-]{6,}', '[REDACTED]', 'g'), '(?i)\\bauthorization\\s*[:=]\\s*\\S+', '[REDACTED]', 'g'), '(?i)\\b[A-Za-z0-9_.-]*(?:key|apikey|token|secret|password|authorization)[A-Za-z0-9_.-]*\\s*[:=]\\s*\\S+', '[REDACTED]', 'g') AS text FROM documents")
def scl01_scrub(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.scrubbed(F.col("text")).alias("text"))


@query(f"WITH {SECTIONS} SELECT id, CAST(ordinal AS INTEGER) AS ordinal, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(level AS INTEGER) AS level, heading, CASE WHEN heading_path = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(heading_path, ' > ') END AS heading_path, text FROM fin")
def chk01_markdown_sections(s: SparkSession, d: str) -> DataFrame:
    marked = table(s, d, "documents").withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (i / 5 % 3 + 1).cast("int")), F.lit(" "), x)).otherwise(x)), "\n"))
    return chunking.markdown_sections(marked)


@query()
def chk04_size_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.size_chunks(table(s, d, "documents"))


@query("SELECT doc_id, CAST(ceil(length(text) / 2) AS BIGINT) AS n_tokens FROM documents")
def chk06_token_estimate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.ceil(F.length("text") / 2).alias("n_tokens"))


@query("SELECT page_id, url, regexp_extract(lower(url), '(\\.[^./]+)$', 1) IN ('.md', '.markdown') AS is_doc, regexp_replace(url, '[^\\p{L}\\p{N}]', '_', 'g') || '__p' AS collection FROM pages")
def scl23_collection_names(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages")
    return rows.select("page_id", "url", F.coalesce(T.language(F.col("url")) == "markdown", F.lit(False)).alias("is_doc"), T.collection_name(F.col("url"), F.lit("p")).alias("collection"))
