"""Queries over transcripts and conversation memory, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequery.functions import text as T
from lodequery.operators import lexical, memory, observe, recall
from lodequery.plans.common import Registry
from lodequery.sources import transcripts
from lodequery.sources.tables import table

REGISTRY = Registry()
QUERIES, ORACLES, query = REGISTRY.queries, REGISTRY.oracles, REGISTRY.query

CAPTURED = "CAST((conv_id * 7919) % 1000 AS DOUBLE)"
TURNS = f"tr AS (SELECT conv_id AS session_key, turn, role, text, {CAPTURED} AS captured_at, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''), ses AS (SELECT DISTINCT conv_id AS session_key, {CAPTURED} AS captured_at FROM conversations)"


def _sessions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("session_key"), F.expr(CAPTURED).alias("captured_at")).distinct()


def _turns(s, d):
    return memory.turn_rows(table(s, d, "conversations").withColumnRenamed("conv_id", "session_key"))


# Lines of events in both dialects; one in eleven is broken, one in thirteen blank, contents are texts or lists of blocks.
STAMP = "concat('2024-01-0', turn % 9 + 1, 'T0', conv_id % 10, ':00:00Z')"


def _lines(s, d):
    c, stamp = F.col, F.expr(STAMP)
    rows = table(s, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    plain = F.to_json(F.struct(c("role").alias("type"), F.struct("role", c("text").alias("content")).alias("message"), stamp.alias("timestamp")))
    block = lambda kind, name, value: F.struct(F.lit(kind).alias("type"), (value if name == "text" else F.lit(None).cast("string")).alias("text"), (value if name == "thinking" else F.lit(None).cast("string")).alias("thinking"))
    blocks = F.array(block("text", "text", c("text")), block("tool", "text", F.lit("no")), block("thinking", "thinking", F.lit("so")))
    listed = F.to_json(F.struct(c("role").alias("type"), F.struct("role", blocks.alias("content")).alias("message"), F.lit("soon").alias("timestamp")))
    value = F.when(c("conv_id") % 11 == 3, F.concat(plain, F.lit("}{"))).when(c("conv_id") % 13 == 4, " ").when(c("turn") % 3 == 0, listed).otherwise(plain)
    return rows.select(c("conv_id").alias("session_key"), c("turn").alias("line"), value.alias("value"))


OK = "conv_id % 11 <> 3 AND conv_id % 13 <> 4"
LINE_TURNS = f"""SELECT conv_id AS session_key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role,
  CASE WHEN turn % 3 = 0 THEN CASE WHEN coalesce(text, '') = '' THEN 'so' ELSE text || chr(10) || 'so' END ELSE text END AS text,
  CASE WHEN turn % 3 <> 0 THEN CAST(epoch(CAST({STAMP.replace("'Z')", "')").replace(":00:00Z", ":00:00")} AS TIMESTAMP)) AS DOUBLE) END AS ts FROM conversations WHERE role IN ('user', 'assistant') AND {OK} AND (turn % 3 = 0 OR coalesce(text, '') <> '')"""


@query(LINE_TURNS)
def sub14_message_turns(s: SparkSession, d: str) -> DataFrame:
    return transcripts.message_turns(_lines(s, d))


def _events(s, d):
    c = F.col
    kind = F.when(c("turn") == 0, "session.start").when(c("role") == "system", "tool.call").otherwise(F.concat("role", F.lit(".message")))
    context = F.struct(F.concat(F.lit("/w/p"), c("conv_id") % 4, F.when(c("conv_id") % 3 == 0, "/sub/").otherwise("")).alias("cwd"), F.when(c("conv_id") % 5 == 0, "/").alias("gitRoot"))
    data = F.struct(F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\n")).alias("content"), F.when(c("turn") == 0, context).alias("context"))
    value = F.to_json(F.struct(kind.alias("type"), data.alias("data"), F.expr(STAMP).alias("timestamp")))
    return table(s, d, "conversations").select(c("conv_id").alias("session_key"), c("turn").alias("line"), F.when(c("conv_id") % 11 == 3, "[1]").otherwise(value).alias("value"))


@query("SELECT conv_id AS session_key, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn_index, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE turn > 0 AND role IN ('user', 'assistant') AND conv_id % 11 <> 3 AND regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> ''")
def sub15_event_turns(s: SparkSession, d: str) -> DataFrame:
    return transcripts.event_turns(_events(s, d)).drop("ts")


CONTEXTS = "ctx AS (SELECT DISTINCT conv_id AS session_key, concat('/w/p', conv_id % 4, CASE WHEN conv_id % 3 = 0 THEN '/sub/' ELSE '' END) AS cwd, CASE WHEN conv_id % 5 = 0 THEN '/' END AS git_root FROM conversations WHERE turn = 0 AND conv_id % 11 <> 3)"


@query(f"WITH {CONTEXTS} SELECT session_key, cwd, git_root FROM ctx")
def sub16_session_contexts(s: SparkSession, d: str) -> DataFrame:
    return transcripts.session_contexts(_events(s, d))


@query(f"WITH {CONTEXTS} SELECT session_key FROM ctx WHERE starts_with(cwd, '/w/p1') OR git_root IS NOT NULL")
def jon23_sessions_of_a_project(s: SparkSession, d: str) -> DataFrame:
    return transcripts.of_project(transcripts.session_contexts(_events(s, d)), "/w/p1").select("session_key")


@query("SELECT conv_id AS session_key, turn AS line FROM conversations WHERE conv_id % 11 <> 3 AND conv_id % 13 <> 4")
def sub17_json_lines(s: SparkSession, d: str) -> DataFrame:
    return transcripts.events(_lines(s, d)).select("session_key", "line")


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') AS encoded FROM pages")
def scl10_encoded_paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", transcripts.encoded_path(F.col("url")).alias("encoded"))


RAW_TIME = "CASE event_id % 4 WHEN 0 THEN concat('', event_id, '.5') WHEN 1 THEN concat('2024-01-0', event_id % 9 + 1) WHEN 2 THEN concat('2024-01-0', event_id % 9 + 1, 'T10:20:30') ELSE 'soon' END"


@query(f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id + 0.5 WHEN 3 THEN NULL ELSE epoch(CAST({RAW_TIME.replace('concat(', 'concat(', 1)} AS TIMESTAMP)) END AS seconds FROM events".replace("CAST(CASE", "TRY_CAST(CASE"))
def scl07_times(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", T.time_of(F.expr(RAW_TIME)).alias("seconds"))


@query("SELECT event_id, epoch(ts)::DOUBLE AS seconds FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def scl08_iso_times(s: SparkSession, d: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(s, d, "events").select("event_id", transcripts.epoch(iso).alias("seconds"))


DAYS = CAPTURED.replace("AS DOUBLE)", "AS DOUBLE) * 3600")


@query(f"""WITH se AS (SELECT DISTINCT conv_id, {DAYS} AS captured_at FROM conversations), now AS (SELECT max(captured_at) AS now FROM se)
SELECT preset, count(*) AS sessions, min(captured_at) AS first FROM (SELECT unnest(['all', '7d', '24h']) AS preset), se, now WHERE preset = 'all' OR captured_at >= now - CASE preset WHEN '7d' THEN 604800 ELSE 86400 END GROUP BY 1""")
def scl04_time_windows(s: SparkSession, d: str) -> DataFrame:
    """Sessions inside each preset's window, counted back from the last capture."""
    sessions = table(s, d, "conversations").select("conv_id", F.expr(DAYS).alias("captured_at")).distinct()
    now = sessions.agg(F.max("captured_at")).first()[0]
    rows = [sessions.where(memory.in_window(F.col("captured_at"), *observe.time_window(p, now or 0.0))).withColumn("preset", F.lit(p)) for p in ("all", "7d", "24h")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("preset").agg(F.count("*").alias("sessions"), F.min("captured_at").alias("first"))


@query(f"WITH {TURNS} SELECT session_key, captured_at FROM ses WHERE captured_at >= 200 AND captured_at <= 600")
def flt02_sessions_in_window(s: SparkSession, d: str) -> DataFrame:
    return _sessions(s, d).where(memory.in_window(F.col("captured_at"), 200.0, 600.0))


@query(f"WITH {TURNS} SELECT s.session_key, s.captured_at, string_agg(concat(turn_index, role, ':', sha256(text)), ',' ORDER BY turn_index) AS turns FROM ses s LEFT JOIN tr USING (session_key) WHERE s.session_key % 20 = 0 GROUP BY 1, 2")
def src20_sessions_by_key(s: SparkSession, d: str) -> DataFrame:
    sessions = _sessions(s, d)
    rows = memory.session(sessions, _turns(s, d), sessions.where("session_key % 20 = 0"))
    return rows.withColumn("turns", F.array_join(F.transform("turns", lambda t: F.concat(t["turn_index"].cast("string"), t["role"], F.lit(":"), F.sha2(t["text"], 256))), ","))


@query(f"WITH {TURNS} SELECT conv_id * 2 AS session_key, conv_id * 2 IN (SELECT session_key FROM ses) AS known FROM (SELECT DISTINCT conv_id FROM conversations)")
def src21_session_exists(s: SparkSession, d: str) -> DataFrame:
    sessions = _sessions(s, d)
    asked = sessions.select((F.col("session_key") * 2).alias("session_key"))
    return asked.join(sessions.select("session_key", F.lit(True).alias("known")), "session_key", "left").select("session_key", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"WITH {TURNS} SELECT DISTINCT session_key FROM ses WHERE session_key % 3 <> 0")
def jon05_sessions_to_archive(s: SparkSession, d: str) -> DataFrame:
    sessions = _sessions(s, d)
    return sessions.join(sessions.where("session_key % 3 = 0").select("session_key"), "session_key", "left_anti").select("session_key")


@query(f"WITH {TURNS} SELECT count_if(session_key % 3 <> 0 AND session_key IN (SELECT session_key FROM tr))::BIGINT AS archived, count_if(NOT (session_key % 3 <> 0 AND session_key IN (SELECT session_key FROM tr)))::BIGINT AS skipped FROM ses")
def agg20_archive_report(s: SparkSession, d: str) -> DataFrame:
    sessions = _sessions(s, d)
    return memory.archive_report(sessions, _turns(s, d), sessions.where("session_key % 3 = 0"))


@query(f"WITH {TURNS} SELECT session_key, turn_index, 'old' AS source FROM tr WHERE session_key % 3 = 0 UNION ALL SELECT session_key, turn_index, 'new' FROM tr WHERE session_key % 3 <> 0")
def mem05_archived_turns(s: SparkSession, d: str) -> DataFrame:
    sessions, turns = _sessions(s, d), _turns(s, d)
    old = turns.where("session_key % 3 = 0").withColumn("source", F.lit("old"))
    return memory.archived(sessions.where("session_key % 3 = 0"), old, sessions, turns.withColumn("source", F.lit("new")))[1].select("session_key", "turn_index", "source")


@query(f"WITH {TURNS} SELECT concat_ws('#', session_key, turn_index) AS id FROM tr WHERE session_key % 4 <> 0")
def jon06_unindexed_turns(s: SparkSession, d: str) -> DataFrame:
    turns = _turns(s, d)
    known = turns.where("session_key % 4 = 0").select(F.concat_ws("#", "session_key", "turn_index").alias("id"))
    return memory.unindexed(turns, known).select("id")


@query("""SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(coalesce(q, ''), '\\s+'), lambda x: x <> ''), lambda x: '"' || replace(x, '"', '""') || '"'), ' ') AS expression
FROM (SELECT conv_id, turn, concat(left(text, 40), CASE turn % 3 WHEN 0 THEN ' "q" x.y:z' WHEN 1 THEN '  a-b*' ELSE '' END) AS q FROM conversations)""")
def mem02_match_expressions(s: SparkSession, d: str) -> DataFrame:
    """What turns would be as queries, some with quotes and operators."""
    extra = F.when(F.col("turn") % 3 == 0, ' "q" x.y:z').when(F.col("turn") % 3 == 1, "  a-b*").otherwise("")
    query_ = F.concat(F.coalesce(F.substring("text", 1, 40), F.lit("")), extra)
    return table(s, d, "conversations").select("conv_id", "turn", memory.match_expression(query_).alias("expression"))


# two-word phrases, taken from the turns themselves: words 3 and 4 of every twentieth turn
PHRASES = f"""ws AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM tr),
q AS (SELECT session_key AS query_id, w[3] AS a, w[4] AS b FROM ws WHERE session_key % 20 = 0 AND turn_index = 0 AND len(w) >= 4),
pr AS (SELECT session_key, captured_at, role, turn_index, text, len(w) AS len, unnest(list_zip(w[:-2], w[2:])) AS p FROM ws WHERE len(w) >= 2),
tf AS (SELECT query_id, session_key, captured_at, role, turn_index, len, count(*) AS tf FROM pr JOIN q ON p[1] = a AND p[2] = b GROUP BY ALL),
sz AS (SELECT count(*) AS turns, avg(len(w)) AS avg_len FROM ws), df AS (SELECT query_id, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT tf.*, round(greatest(ln((turns - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)), 6) AS score FROM tf JOIN df USING (query_id), sz WHERE captured_at >= 100 AND captured_at <= 900)"""


def _phrases(s, d):
    w = memory.words(F.col("text"))
    rows = _turns(s, d).where("session_key % 20 = 0 and turn_index = 0").select(F.col("session_key").alias("query_id"), w.alias("w")).where("size(w) >= 4")
    return rows.select("query_id", F.concat(F.col("w")[2], F.lit("-"), F.col("w")[3]).alias("query"))


@query(f"WITH {TURNS}, {PHRASES} SELECT query_id, CAST(rank AS INTEGER) AS rank, session_key, captured_at, role, turn_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, captured_at DESC, session_key, turn_index) AS rank FROM sc) WHERE rank <= 5")
def jon01_episodes_by_relevance(s: SparkSession, d: str) -> DataFrame:
    return memory.episodes(_sessions(s, d), _turns(s, d), _phrases(s, d), 5, 100.0, 900.0).drop("snippet")


@query(f"WITH {TURNS}, {PHRASES} SELECT query_id, CAST(rank AS INTEGER) AS rank, session_key, captured_at, role, turn_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY captured_at DESC, session_key, turn_index) AS rank FROM sc) WHERE rank <= 5")
def ord05_episodes_by_recency(s: SparkSession, d: str) -> DataFrame:
    return memory.episodes(_sessions(s, d), _turns(s, d), _phrases(s, d), 5, 100.0, 900.0, "recency").drop("snippet")


@query()
def mem03_snippets(s: SparkSession, d: str) -> DataFrame:
    return memory.episodes(_sessions(s, d), _turns(s, d), _phrases(s, d), 5).select("query_id", "rank", "snippet")


@query(f"WITH {TURNS} SELECT query_id, CAST(rank AS INTEGER) AS rank, session_key, turn_index, captured_at, role, snippet FROM (SELECT q.conv_id AS query_id, row_number() OVER (PARTITION BY q.conv_id ORDER BY tr.session_key, turn_index) AS rank, tr.session_key, turn_index, captured_at, role, tr.text AS snippet FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 20 = 0) q JOIN tr ON tr.session_key = q.conv_id OR tr.session_key = q.conv_id + 1) WHERE rank <= 4 AND captured_at >= 300")
def flt03_cut_before_the_window(s: SparkSession, d: str) -> DataFrame:
    turns = _turns(s, d).join(_sessions(s, d), "session_key")
    ids = turns.select(F.concat_ws("#", "session_key", "turn_index").alias("id"), "turn_index", F.explode(F.array("session_key", F.col("session_key") - 1)).alias("query_id"), F.col("session_key").alias("k")).where("query_id % 20 = 0")
    asked = _sessions(s, d).select(F.col("session_key").alias("query_id"))
    hits = ids.join(asked, "query_id", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("k", "turn_index"))).where("rank <= 4").select("query_id", "id", F.lit(0.0).alias("score"), "rank")
    return memory.recalled(hits, turns, 300.0).drop("score")


@query("SELECT item_id AS query_id, left(sha256(text), 16) AS query_hash, CAST(CASE WHEN item_id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS results FROM benchmark")
def sub20_search_events(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = asked.where("query_id % 3 = 0").select("query_id").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    return memory.search_event(asked, hits)


@query(f"WITH {TURNS} SELECT session_key, captured_at, role, turn_index, text AS snippet, CAST(turn_index AS DOUBLE) AS score FROM tr WHERE turn_index % 4 <> 1 AND session_key % 6 <> 5")
def sub19_well_formed_rows(s: SparkSession, d: str) -> DataFrame:
    rows = _turns(s, d).join(_sessions(s, d), "session_key")
    raw = rows.select("session_key", F.when(F.col("session_key") % 6 == 5, "then").otherwise(F.col("captured_at").cast("string")).alias("captured_at"), "role", F.when(F.col("turn_index") % 4 == 1, "x").otherwise(F.col("turn_index").cast("string")).alias("turn_index"), F.col("text").alias("snippet"), (-F.col("turn_index")).cast("string").alias("bm25"))
    return memory.well_formed(raw)


# ---- semantic memory ---------------------------------------------------------------------------

VECTORS = "ev AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), ne AS (SELECT count(*) AS n FROM embeddings)"


def _vectors(s, d, place):
    """An embedding for each row of a table: one of the given vectors, chosen by a number of the row."""
    given = table(s, d, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").cast("array<double>").alias("vector"))
    n = given.count()
    return lambda rows: rows.withColumn("_v", F.expr(place) % n).join(given, "_v").drop("_v")


TURN_VECTOR, QUERY_VECTOR = "cast(substring_index(id, '#', 1) as bigint) * 7 + cast(substring_index(id, '#', -1) as bigint)", "query_id * 11"


@query(f"""WITH {TURNS}, {VECTORS}, tv AS (SELECT tr.*, v FROM tr, ne JOIN ev ON vec_id = (session_key * 7 + turn_index) % n), qv AS (SELECT item_id AS query_id, v FROM benchmark, ne JOIN ev ON vec_id = (item_id * 11) % n),
sc AS (SELECT query_id, concat(session_key, '#', turn_index) AS id, session_key, turn_index, captured_at, role, text AS snippet, round(list_cosine_similarity(qv.v, tv.v), 9) AS score FROM qv, tv)
SELECT query_id, CAST(rank AS INTEGER) AS rank, session_key, turn_index, captured_at, role, snippet, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5 AND captured_at >= 300 AND captured_at <= 900""")
def mem08_semantic_search(s: SparkSession, d: str) -> DataFrame:
    """A memory grown in two runs, the second over all turns, then asked; the window comes after the cut."""
    at = f"{lexical.shared(s)}/memory-{uuid.uuid4().hex}"
    turns, of_turn = _turns(s, d), _vectors(s, d, TURN_VECTOR)
    recall.grown(turns.where("session_key % 3 = 0"), _sessions(s, d), at, of_turn)
    recall.grown(turns, _sessions(s, d), at, of_turn)
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return recall.search(s, at, asked, 5, 300.0, 900.0, _vectors(s, d, QUERY_VECTOR))


@query(f"WITH {TURNS} SELECT r.run, CASE r.run WHEN 1 THEN count_if(session_key % 4 = 0) WHEN 2 THEN count_if(session_key % 4 <> 0) ELSE 0 END AS added, CASE r.run WHEN 1 THEN count_if(session_key % 4 = 0) ELSE count(*) END AS kept FROM (SELECT unnest([1, 2, 3]) AS run) r, tr GROUP BY 1")
def mem07_backfill(s: SparkSession, d: str) -> DataFrame:
    """How many turns three runs over the archive embedded and kept: a part, the rest, and none."""
    at, turns, rows = f"{lexical.shared(s)}/memory-{uuid.uuid4().hex}", _turns(s, d), []
    for run, own in enumerate((turns.where("session_key % 4 = 0"), turns, turns), 1):
        rows.append((run, recall.grown(own, _sessions(s, d), at), recall.kept(s, at).count()))
    return s.createDataFrame(rows, "run int, added long, kept long")


@query(f"WITH {TURNS} SELECT concat(session_key, '#', turn_index) AS id, CAST(floor(captured_at / 86400) AS INTEGER) AS day, session_key, role FROM tr")
def mem06_kept_turns(s: SparkSession, d: str) -> DataFrame:
    """What a memory keeps of the turns, with vectors of their hashed n-grams."""
    at = f"{lexical.shared(s)}/memory-{uuid.uuid4().hex}"
    recall.grown(_turns(s, d), _sessions(s, d), at)
    return recall.kept(s, at).where("size(vector) = 512").select("id", "day", "session_key", "role")


NAMES = "CASE event_id % 6 WHEN 0 THEN 'apiKey' WHEN 1 THEN 'API_TOKEN' WHEN 2 THEN 'monkey' WHEN 3 THEN 'user.password' WHEN 4 THEN 'tokens' ELSE 'keyName' END"


@query("SELECT event_id, event_id % 6 IN (0, 1, 3, 5) AS secret FROM events")
def flt14_secret_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", T.is_secret_name(F.expr(NAMES)).alias("secret"))


@query("SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 3, 5) THEN '[REDACTED]' ELSE event_type END AS value FROM events")
def scl02_redacted_fields(s: SparkSession, d: str) -> DataFrame:
    fields = T.redacted(F.create_map(F.expr(NAMES), F.col("event_type")))
    return table(s, d, "events").select("event_id", F.map_values(fields)[0].alias("value"))
