"""Queries over changesets and audits made from the documents, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions import diff as D
from lodequery.operators import audit, lexical, reports, trace
from lodequery.plans.common import Registry
from lodequery.sources import history
from lodequery.sources.tables import table

REGISTRY = Registry()
QUERIES, ORACLES, query = REGISTRY.queries, REGISTRY.oracles, REGISTRY.query

# A changeset of two files for each document, in expressions that both engines read alike: the first file is modified, renamed,
# added, deleted or binary by the document's id and has two hunks, one of them with the whole text; the second deletes a line.
N = "chr(10)"
DIR = "CASE doc_id % 7 WHEN 0 THEN 'docs' WHEN 1 THEN 'specs' ELSE 'src' END"
NAME = f"concat({DIR}, '/m', doc_id % 50, CASE WHEN doc_id % 9 = 0 THEN '.MD' ELSE '.py' END)"
HEAD = f"""CASE doc_id % 5 WHEN 0 THEN concat('rename from old', doc_id, {N}, 'rename to ', {NAME}, {N}) WHEN 1 THEN concat('new file mode 100644', {N}, '--- /dev/null', {N}, '+++ b/', {NAME}, {N})
  WHEN 2 THEN concat('deleted file mode 100644', {N}, '--- a/', {NAME}, {N}, '+++ /dev/null', {N}) WHEN 3 THEN concat('--- a/', {NAME}, {N}, '+++ b/', {NAME}, {N})
  ELSE concat('--- a/', {NAME}, {N}, '+++ b/', {NAME}, {N}, CASE WHEN doc_id % 15 = 4 THEN concat('Binary files differ', {N}) ELSE '' END) END"""
HUNKS = f"""concat('@@ -', doc_id % 90 + 1, ',3 +', doc_id % 80 + 1, ' @@ def ctx', doc_id % 13, {N}, ' ', replace(coalesce(text, ''), {N}, concat({N}, ' ')), {N}, '+def name', doc_id % 20, '(x):', {N}, '-LIMIT = ', doc_id, {N}, '+if a == 1', {N}, '+class ctx', doc_id % 13, {N},
  '@@ -200 +210,', CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 2 END, ' @@', {N}, '+fn go', doc_id % 11, '()', {N}, '+  local = 2', {N})"""
SECOND = f"concat('diff --git a/lib/x', doc_id % 10, ' b/lib/x', doc_id % 10, {N}, '--- a/lib/x', doc_id % 10, {N}, '+++ b/lib/x', doc_id % 10, {N}, '@@ -', doc_id + 1, ',2 +', doc_id, ',0 @@', {N}, '-gone', {N})"
TEXT = f"concat('preamble', {N}, 'diff --git a/x b/y', {N}, {HEAD}, {HUNKS}, {SECOND})"
BINARY = "(doc_id % 15 = 4)"
PATH0 = NAME
HUNK0 = "concat('ctx', doc_id % 13)"

FILES = f"""fs AS (SELECT doc_id AS ref, 0 AS file, {NAME} AS path, CASE WHEN doc_id % 5 = 0 THEN concat('old', doc_id) END AS old_path,
  CASE doc_id % 5 WHEN 0 THEN 'renamed' WHEN 1 THEN 'added' WHEN 2 THEN 'deleted' ELSE 'modified' END AS change_type, {BINARY} AS is_binary FROM documents
  UNION ALL SELECT doc_id, 1, concat('lib/x', doc_id % 10), NULL, 'modified', false FROM documents)"""
# the twin knows what each hunk must give, not how lines are read
HK = f"""hk AS (SELECT doc_id AS ref, 0 AS file, 0 AS hunk, {NAME} AS path, doc_id % 90 + 1 AS old_start, 3 AS old_len, doc_id % 80 + 1 AS new_start, 1 AS new_len,
  concat('ctx', doc_id % 13, ',name', doc_id % 20, ',LIMIT') AS identifiers, len(string_split(coalesce(text, ''), {N})) + 4 AS n_lines FROM documents WHERE NOT {BINARY}
  UNION ALL SELECT doc_id, 0, 1, {NAME}, 200, 1, 210, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 2 END, concat('go', doc_id % 11), 2 FROM documents WHERE NOT {BINARY}
  UNION ALL SELECT doc_id, 1, 0, concat('lib/x', doc_id % 10), doc_id + 1, 2, doc_id, 0, '', 1 FROM documents)"""


def _lines(s: SparkSession, d: str) -> DataFrame:
    return trace.diff_lines(table(s, d, "documents").select(F.col("doc_id").alias("ref"), F.expr(TEXT).alias("text")))


def _files(s, d):
    return trace.diff_files(_lines(s, d))


def _hunks(s, d):
    return trace.diff_hunks(_lines(s, d), _files(s, d))


@query(f"WITH {FILES} SELECT ref, file, path, old_path, change_type, is_binary FROM fs")
def sub44_diff_files(s: SparkSession, d: str) -> DataFrame:
    return _files(s, d)


@query(f"WITH {HK} SELECT ref, file, hunk, path, CAST(old_start AS INTEGER) AS old_start, CAST(old_len AS INTEGER) AS old_len, CAST(new_start AS INTEGER) AS new_start, CAST(new_len AS INTEGER) AS new_len, identifiers, CAST(n_lines AS INTEGER) AS n_lines FROM hk")
def scl19_diff_hunks(s: SparkSession, d: str) -> DataFrame:
    return _hunks(s, d).withColumn("n_lines", F.size("lines")).withColumn("identifiers", F.array_join("identifiers", ",")).drop("lines")


@query(f"WITH {HK} SELECT ref, file, hunk, CAST(new_start AS INTEGER) AS first_line, CAST(CASE WHEN new_len > 0 THEN new_start + new_len - 1 ELSE new_start END AS INTEGER) AS last_line FROM hk")
def scl21_hunk_lines(s: SparkSession, d: str) -> DataFrame:
    a, b = D.span(F.col("new_start"), F.col("new_len"))
    return _hunks(s, d).select("ref", "file", "hunk", a.alias("first_line"), b.alias("last_line"))


@query(f"WITH {HK} SELECT ref, file, hunk, CASE WHEN identifiers = '' THEN '' ELSE array_to_string(list_slice(string_split(identifiers, ','), 1, 2), ',') END AS queries FROM hk")
def scl20_identifier_queries(s: SparkSession, d: str) -> DataFrame:
    return _hunks(s, d).select("ref", "file", "hunk", F.array_join(D.identifier_queries(F.col("identifiers"), trace.snippet(F.col("lines")), 2), ",").alias("queries"))


@query("SELECT doc_id, regexp_extract_all(text, '\\b(?:def|class|func|function|fn|struct|enum|trait|type|const)\\s+([A-Za-z_]\\w*)', 1) AS found FROM documents".replace("SELECT doc_id, regexp_extract_all", "SELECT doc_id, len(regexp_extract_all").replace("1) AS found", "1)) AS found"))
def sub45_declared_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(D.DECLARATION), F.lit(1))).cast("long").alias("found"))


@query(f"WITH {FILES} SELECT ref, file, path, CASE WHEN split_part(path, '/', 1) = 'specs' THEN 'specification' WHEN split_part(path, '/', 1) = 'docs' OR ends_with(path, '.MD') THEN 'documentation' END AS reason FROM fs")
def flt05_source_files(s: SparkSession, d: str) -> DataFrame:
    return trace.source_files(_files(s, d)).select("ref", "file", "path", "reason")


@query("SELECT url AS path, regexp_matches(url, '(^|/)test_[^/]*$') OR ends_with(url, '_test.py') OR contains('/' || url || '/', '/tests/') AS is_test FROM (SELECT concat(url, CASE page_id % 4 WHEN 0 THEN '/tests/a.py' WHEN 1 THEN '/test_b.py' WHEN 2 THEN '/c_test.py' ELSE '' END) AS url FROM pages)")
def flt11_test_paths(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "pages").select(F.expr("concat(url, CASE page_id % 4 WHEN 0 THEN '/tests/a.py' WHEN 1 THEN '/test_b.py' WHEN 2 THEN '/c_test.py' ELSE '' END)").alias("path"))
    return rows.select("path", D.is_test_path(F.col("path")).alias("is_test"))


# ---- evidence ----------------------------------------------------------------------------------

#: Symbols: every `ctx` name in its own file, `name` symbols in another, `go` symbols in neither.
EVIDENCE = "SELECT DISTINCT {0} AS path, concat('ctx', doc_id % 13) AS query, concat('ctx', doc_id % 13) AS name, {0} AS symbol_path, doc_id % 13 AS line, 0 AS place FROM documents UNION SELECT DISTINCT {0}, concat('name', doc_id % 20), concat('name', doc_id % 20), 'src/other.py', doc_id % 20, 0 FROM documents".format(NAME)
ITEMS = f"""it AS (SELECT ref, CAST(row_number() OVER (PARTITION BY ref ORDER BY file, g) - 1 AS INTEGER) AS item, file, path, symbol, granularity, start_line, end_line, hunks, names, n_lines FROM (
  SELECT ref, file, 0 AS g, path, split_part(identifiers, ',', 1) AS symbol, 'symbol' AS granularity, new_start AS start_line, new_start AS end_line, 1 AS hunks, identifiers AS names, n_lines FROM hk WHERE file = 0 AND hunk = 0
  UNION ALL SELECT ref, file, 1, path, NULL, 'hunk', 210, 211, 1, identifiers, 2 FROM hk WHERE file = 0 AND hunk = 1 AND new_len > 0))"""
UNRESOLVED = "un AS (SELECT * FROM hk WHERE new_len = 0)"


def _evidence(s, d):
    docs = table(s, d, "documents")
    one = docs.select(F.expr(NAME).alias("path"), F.expr("concat('ctx', doc_id % 13)").alias("query"), F.expr("concat('ctx', doc_id % 13)").alias("name"), F.expr(NAME).alias("symbol_path"), F.expr("doc_id % 13").alias("line"), F.lit(0).alias("place"))
    two = docs.select(F.expr(NAME).alias("path"), F.expr("concat('name', doc_id % 20)").alias("query"), F.expr("concat('name', doc_id % 20)").alias("name"), F.lit("src/other.py").alias("symbol_path"), F.expr("doc_id % 20").alias("line"), F.lit(0).alias("place"))
    return one.union(two).distinct()


def _items(s, d):
    hunks = _hunks(s, d)
    return trace.evidence_items(hunks, trace.located(hunks, _evidence(s, d)))


@query(f"WITH {HK}, ev AS ({EVIDENCE}) SELECT DISTINCT ref, file, hunk, hk.path, name, symbol_path, line FROM (SELECT *, unnest(string_split(identifiers, ',')) AS query FROM hk) hk JOIN ev ON ev.path = hk.path AND ev.query = hk.query")
def sub47_located_symbols(s: SparkSession, d: str) -> DataFrame:
    return trace.located(_hunks(s, d), _evidence(s, d)).select("ref", "file", "hunk", "path", "name", "symbol_path", "line")


@query(f"WITH {HK}, {ITEMS} SELECT ref, item, file, path, symbol, granularity, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(hunks AS BIGINT) AS hunks, names, CAST(n_lines AS INTEGER) AS n_lines FROM it")
def trc03_evidence_items(s: SparkSession, d: str) -> DataFrame:
    items, _ = _items(s, d)
    return items.select("ref", "item", "file", "path", "symbol", "granularity", "start_line", "end_line", "hunks", F.array_join("identifiers", ",").alias("names"), F.size("lines").alias("n_lines"))


@query(f"WITH {HK}, m AS (SELECT path, count(*) AS hunks, min(old_start) AS old_start, max(old_start + greatest(old_len - 1, 0)) AS old_end, min(new_start) AS new_start, CASE WHEN count(*) = 1 AND max(new_len) = 0 THEN min(new_start) ELSE max(new_start + greatest(new_len - 1, 0)) END AS new_end, sum(n_lines) AS n_lines FROM hk WHERE file = 0 GROUP BY path) SELECT path, hunks, CAST(old_start AS INTEGER) AS old_start, CAST(old_end AS INTEGER) AS old_end, CAST(new_start AS INTEGER) AS new_start, CAST(new_end AS INTEGER) AS new_end, CAST(n_lines AS BIGINT) AS n_lines FROM m")
def agg17_merged_hunks(s: SparkSession, d: str) -> DataFrame:
    rows = _hunks(s, d).where("file = 0").withColumn("hunk", F.struct("ref", "hunk"))
    return trace.merged(rows, "path").select("path", "hunks", "old_start", "old_end", "new_start", "new_end", F.size("lines").cast("long").alias("n_lines"))


REQ = f"rq AS (SELECT ref, concat('REQ-', lpad(concat('', item), 3, '0'), '-', q) AS id, q AS quota, item, concat('change in ', coalesce(symbol, path), ' (', granularity, ')') AS statement, path, symbol, start_line, end_line FROM it, (SELECT unnest(['user_capability', 'behaviour', 'implementation']) AS q))"


@query(f"WITH {HK}, {ITEMS}, {REQ} SELECT ref, id, quota, item, statement FROM rq")
def trc05_placeholder_requirements(s: SparkSession, d: str) -> DataFrame:
    return trace.placeholder_requirements(_items(s, d)[0]).select("ref", "id", "quota", "item", "statement")


KEPT = "(ref % 3 <> 0 OR item <> 0) AND NOT (ref % 4 = 1 AND quota = 'behaviour')"


@query(f"WITH {HK}, {ITEMS}, {REQ} SELECT DISTINCT ref, item, 'behaviour' AS quota FROM rq WHERE ref % 4 = 1 AND (ref % 3 <> 0 OR item <> 0)")
def jon20_missing_quotas(s: SparkSession, d: str) -> DataFrame:
    items, _ = _items(s, d)
    return trace.missing_quotas(items, trace.placeholder_requirements(items).where(KEPT))


@query(f"WITH {HK}, {ITEMS}, {UNRESOLVED} SELECT ref, 'item' AS what, path, symbol, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM it WHERE ref % 3 = 0 AND item = 0 UNION ALL SELECT ref, 'hunk', path, NULL, CAST(CASE WHEN new_start = 0 THEN old_start ELSE new_start END AS INTEGER), CAST(CASE WHEN new_start = 0 THEN old_start ELSE new_start END AS INTEGER) FROM un")
def jon21_drift(s: SparkSession, d: str) -> DataFrame:
    items, unresolved = _items(s, d)
    return trace.drift(items, unresolved, trace.placeholder_requirements(items).where(KEPT))


@query(f"WITH {HK}, {ITEMS}, {REQ} SELECT ref, id FROM rq WHERE ref % 10 = 3")
def trc04_strangers(s: SparkSession, d: str) -> DataFrame:
    items, _ = _items(s, d)
    moved = trace.placeholder_requirements(items).withColumn("end_line", F.when(F.col("ref") % 10 == 3, F.col("end_line") + 1).otherwise(F.col("end_line")))
    return trace.strangers(moved, items).select("ref", "id")


@query(f"""WITH tr AS (SELECT doc_id, len(string_split(text, {N})) AS size, text FROM documents), an AS (SELECT doc_id, doc_id % 12 AS a, doc_id % 12 + doc_id % 4 AS b, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'never such text' END AS sym FROM documents)
SELECT doc_id AS anchor, a >= 1 AND b <= coalesce(size, 0) AND (sym IS NULL OR contains(coalesce(text, ''), sym)) AS verified FROM an LEFT JOIN tr USING (doc_id)""")
def flt12_verified_anchors(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    lines = docs.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    c = F.col("doc_id")
    anchors = docs.select(
        c.alias("anchor"), c.cast("string").alias("path"), (c % 12).alias("start_line"), (c % 12 + c % 4).alias("end_line"), F.when(c % 3 == 0, "a").when(c % 3 == 1, "never such text").alias("symbol"),
        F.lit(None).cast("string").alias("test_path"), F.lit(None).cast("string").alias("covers"),
    )
    return trace.verified(anchors, lines).select("anchor", "verified")


@query("SELECT DISTINCT symbol, concat('t/tests/', u, '.py') AS test_path, u AS name, arg_min(page_id, page_id) OVER (PARTITION BY symbol, u) AS chunk_id FROM (SELECT page_id, page_id % 5 AS symbol, concat('p', page_id % 9) AS u FROM pages) WHERE page_id % 2 = 0")
def sub48_tests_of_symbols(s: SparkSession, d: str) -> DataFrame:
    c = F.col("page_id")
    hits = table(s, d, "pages").select((c % 5).alias("symbol"), c.alias("rank"), F.concat(F.when(c % 2 == 0, "t/tests/p").otherwise("src/p"), c % 9, F.lit(".py")).alias("path"), c.alias("chunk_id"))
    return trace.tests_of(hits)


# ---- audits ------------------------------------------------------------------------------------

BULLETS = f"concat('# head', {N}, '- **REQ-A', doc_id, '** the system', {N}, '  must ', replace(replace(coalesce(text, ''), {N}, ' '), '#', ''), {N}, '- **Note** not one', {N}, '* **FR-', doc_id % 10, '** other', {N}, {N}, 'outside', {N})"


def _bullet_docs(s, d):
    return table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.expr(BULLETS).alias("text"))


@query(f"WITH b AS (SELECT concat('d', doc_id) AS path, doc_id, trim(replace(replace(coalesce(text, ''), {N}, ' '), '#', '')) AS t FROM documents) SELECT path, 0 AS place, concat('REQ-A', doc_id) AS id, length(t) AS n FROM b UNION ALL SELECT path, 1, concat('FR-', doc_id % 10), 0 FROM b")
def src33_requirement_bullets(s: SparkSession, d: str) -> DataFrame:
    rows = audit.requirement_bullets(_bullet_docs(s, d))
    inner = F.regexp_replace(F.col("text"), r"^[-*] \*\*[^*]*\*\* (?:the system must|other)", "")
    return rows.select("path", "place", "id", F.length(F.trim(inner)).cast("long").alias("n"))


@query("SELECT count(*) AS documents, 2 * count(*) AS requirements, 'found' AS status FROM documents")
def sub52_source_status(s: SparkSession, d: str) -> DataFrame:
    docs = _bullet_docs(s, d)
    return audit.source_status(docs, audit.requirement_bullets(docs))


#: Audits by source: the source's documents as original requirements, its labelled documents as lifted items.
SIDES = """og AS (SELECT source AS ref, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS idx, concat('R', doc_id) AS id FROM documents),
li AS (SELECT source AS ref, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS INTEGER) AS idx, doc_id FROM documents WHERE doc_id % 5 <> 0 OR length(source) = 4)"""
VERDICTS = """ve AS (SELECT coalesce(og.ref, li.ref) AS ref, og.idx AS original, li.idx AS lifted, CASE WHEN li.idx IS NULL THEN 'MANCANTE' WHEN og.idx IS NULL THEN 'NON_DOCUMENTATO' ELSE 'SODDISFATTO' END AS verdict,
  CASE WHEN li.idx IS NULL OR og.idx IS NULL THEN 'bassa' ELSE 'media' END AS confidence FROM og FULL JOIN li ON og.ref = li.ref AND og.idx = li.idx)"""


def _sides(s, d):
    docs = table(s, d, "documents").select(F.col("source").alias("ref"), "doc_id")
    original = audit.indexed(docs, "doc_id").select("ref", "index", F.concat(F.lit("R"), "doc_id").alias("id"))
    c = F.col("doc_id")
    lifted = audit.indexed(docs.where("doc_id % 5 <> 0 or length(ref) = 4").withColumn("_o", -c), "_o").select(
        "ref", "index", F.concat(F.lit("f"), c % 9).alias("path"), (c % 30).alias("start_line"), (c % 30 + 2).alias("end_line"), F.when(c % 2 == 0, F.concat(F.lit("s"), c % 7)).alias("symbol"), (c % 3 != 0).alias("verified"),
    )
    return original, lifted


@query(f"WITH {SIDES} SELECT ref, idx AS \"index\", id FROM og")
def aud01_prepared(s: SparkSession, d: str) -> DataFrame:
    return _sides(s, d)[0]


@query(f"WITH {SIDES}, {VERDICTS} SELECT ref, original, CAST(lifted AS VARCHAR) AS lifted, verdict, confidence FROM ve")
def aud03_placeholder_verdicts(s: SparkSession, d: str) -> DataFrame:
    return audit.placeholder_verdicts(*_sides(s, d)).select("ref", "original", F.get("lifted", F.lit(0)).cast("string").alias("lifted"), "verdict", "confidence")


# verdicts with every level and kind, set by the index
JUDGED = """jd AS (SELECT ref, original, lifted, CASE WHEN original % 7 = 3 THEN 'DRIFTED' WHEN original % 7 = 5 THEN 'PARZIALE' ELSE verdict END AS verdict, CASE WHEN original % 4 = 0 THEN 'alta' ELSE confidence END AS confidence,
  CASE WHEN original IS NULL THEN NULL WHEN original % 3 = 0 THEN 'bassa' ELSE 'media' END AS alignment, list_extract(['bassa', 'media', 'alta'], coalesce(original, lifted) % 3 + 1) AS severity, list_extract(['bassa', 'media', 'alta'], coalesce(original, lifted) % 2 + 1) AS detectability FROM ve)"""


def _judged(s, d):
    o, first = F.col("original"), F.coalesce("original", F.get("lifted", F.lit(0)))
    level = lambda c: F.element_at(F.array(*map(F.lit, audit.LEVELS)), c)
    rows = audit.placeholder_verdicts(*_sides(s, d))
    return rows.withColumns({
        "verdict": F.when(o % 7 == 3, "DRIFTED").when(o % 7 == 5, "PARZIALE").otherwise(F.col("verdict")), "confidence": F.when(o % 4 == 0, "alta").otherwise(F.col("confidence")),
        "alignment": F.when(o.isNull(), None).when(o % 3 == 0, "bassa").otherwise("media"), "severity": level((first % 3 + 1).cast("int")), "detectability": level((first % 2 + 1).cast("int")),
    })


SCORE = "(list_position(['bassa', 'media', 'alta'], severity) - 1 + 2 - (list_position(['bassa', 'media', 'alta'], detectability) - 1))"
RECORDS = f"""rc AS (SELECT *, CAST(row_number() OVER (PARTITION BY ref ORDER BY coalesce(list_position(['bassa', 'media', 'alta'], risk), 0) DESC, list_position(['SODDISFATTO', 'NON_DOCUMENTATO', 'MANCANTE', 'PARZIALE', 'DRIFTED'], verdict) DESC, original IS NULL, coalesce(original, lifted)) AS INTEGER) AS rank FROM (
  SELECT jd.ref, original, lifted, verdict, CASE WHEN alignment = 'bassa' THEN 'bassa' ELSE confidence END AS confidence, confidence <> 'bassa' AND coalesce(alignment, '') = 'bassa' AS lowered, id AS original_ref, CASE WHEN verdict <> 'SODDISFATTO' THEN CASE WHEN {SCORE} >= 3 THEN 'alta' WHEN {SCORE} = 2 THEN 'media' ELSE 'bassa' END END AS risk, doc_id,
  CASE WHEN doc_id IS NOT NULL THEN concat(CASE WHEN doc_id % 2 = 0 THEN concat('s', doc_id % 7, ' (') ELSE '' END, 'f', doc_id % 9, ':', doc_id % 30, '-', doc_id % 30 + 2, CASE WHEN doc_id % 2 = 0 THEN ')' ELSE '' END) END AS cite
  FROM jd LEFT JOIN og ON og.ref = jd.ref AND og.idx = original LEFT JOIN li ON li.ref = jd.ref AND li.idx = lifted))"""


@query(f"WITH {SIDES}, {VERDICTS}, {JUDGED}, {RECORDS} SELECT ref, rank, verdict, confidence, original_ref, coalesce(cite, '') AS lifted_refs, risk, verdict = 'DRIFTED' AS proposed, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN lowered THEN 1 ELSE 0 END AS notes, coalesce(original_ref, cite) AS record_ref FROM rc")
def aud02_records(s: SparkSession, d: str) -> DataFrame:
    return audit.records(*_sides(s, d), _judged(s, d)).withColumn("lifted_refs", F.array_join("lifted_refs", ";")).withColumn("notes", F.size("notes"))


@query(f"WITH {SIDES}, {VERDICTS}, {JUDGED}, {RECORDS}, vd AS (SELECT unnest(['SODDISFATTO', 'NON_DOCUMENTATO', 'MANCANTE', 'PARZIALE', 'DRIFTED']) AS verdict) SELECT r.ref, vd.verdict, count(rc.rank) AS n, coalesce(string_agg(coalesce(original_ref, cite), ' ' ORDER BY rank), '') AS refs FROM (SELECT DISTINCT ref FROM rc) r CROSS JOIN vd LEFT JOIN rc ON rc.ref = r.ref AND rc.verdict = vd.verdict GROUP BY 1, 2")
def agg14_verdict_matrix(s: SparkSession, d: str) -> DataFrame:
    return audit.matrix(audit.records(*_sides(s, d), _judged(s, d))).withColumn("refs", F.array_join("refs", " "))


@query("SELECT doc_id, CASE WHEN sc >= 3 THEN 'alta' WHEN sc = 2 THEN 'media' ELSE 'bassa' END AS risk FROM (SELECT doc_id, doc_id % 3 + 2 - (doc_id // 3) % 3 AS sc FROM documents)")
def agg18_risk(s: SparkSession, d: str) -> DataFrame:
    level = lambda c: F.element_at(F.array(*map(F.lit, audit.LEVELS)), (c + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", audit.risk(level(F.col("doc_id") % 3), level(F.floor(F.col("doc_id") / 3) % 3)).alias("risk"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'bassa' ELSE list_extract(['bassa', 'media', 'alta'], doc_id % 3 + 1) END AS confidence FROM documents")
def agg19_clamped(s: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_id")
    return table(s, d, "documents").select("doc_id", audit.clamped(F.element_at(F.array(*map(F.lit, audit.LEVELS)), (c % 3 + 1).cast("int")), F.when(c % 2 == 0, "bassa").otherwise("alta")).alias("confidence"))


@query(f"""WITH {SIDES}, {VERDICTS}, us AS (SELECT ref, side, idx, count(*) AS n FROM (SELECT ref, 'original' AS side, CASE WHEN original % 50 = 4 THEN original + 100000 ELSE original END AS idx FROM ve WHERE original IS NOT NULL AND original % 50 <> 9
  UNION ALL SELECT ref, 'lifted', lifted FROM ve WHERE lifted IS NOT NULL AND (original IS NULL OR original % 50 <> 9) UNION ALL SELECT ref, 'original', original FROM ve WHERE original % 50 = 11 UNION ALL SELECT ref, 'lifted', lifted FROM ve WHERE original % 50 = 11 AND lifted IS NOT NULL) GROUP BY 1, 2, 3),
kn AS (SELECT ref, 'original' AS side, idx FROM og UNION ALL SELECT ref, 'lifted', idx FROM li)
SELECT coalesce(kn.ref, us.ref) AS ref, coalesce(kn.side, us.side) AS side, coalesce(kn.idx, us.idx) AS "index", CASE WHEN kn.idx IS NULL THEN 'dangling' WHEN us.n IS NULL THEN 'uncovered' ELSE 'repeated' END AS fault FROM kn FULL JOIN us ON kn.ref = us.ref AND kn.side = us.side AND kn.idx = us.idx WHERE kn.idx IS NULL OR us.n IS NULL OR us.n > 1""")
def agg23_faults(s: SparkSession, d: str) -> DataFrame:
    original, lifted = _sides(s, d)
    rows = audit.placeholder_verdicts(original, lifted)
    o = F.col("original")
    broken = rows.where("original is null or original % 50 <> 9").withColumn("original", F.when(o % 50 == 4, o + 100000).otherwise(o))
    return audit.faults(original, lifted, broken.unionByName(rows.where("original % 50 = 11")))


# ---- version control ---------------------------------------------------------------------------

LISTED = "concat('d', doc_id % 16, '/', lang, '/f', doc_id, '.txt')"
BODY = "concat(coalesce(text, ''), chr(10))"


def _history(s: SparkSession, d: str) -> tuple[str, str, str]:
    """A repository of the documents as files, with two commits: in the second a fifth have a line more, a fifth are gone, a fifth are new, and a tenth have moved."""
    root = f"{lexical.shared(s)}/history-{uuid.uuid4().hex}".removeprefix("file://")
    docs = table(s, d, "documents")
    state = lambda when, path, body, n: history.put(docs.where(when).select("doc_id", F.expr(path).alias("path"), F.encode(F.expr(body), "UTF-8").alias("content"), F.lit(n).alias("n")), root, "blob")
    old = state("doc_id % 5 <> 2", LISTED, BODY, 0)
    new = state("doc_id % 5 <> 1", f"CASE WHEN doc_id % 10 = 3 THEN concat('moved/', {LISTED}) ELSE {LISTED} END", f"CASE WHEN doc_id % 5 = 0 THEN concat({BODY}, 'one line more', chr(10)) ELSE {BODY} END", 1)
    first = history.committed(old.select("path", F.col("id").alias("blob")), root, "main", "first", 1)
    second = history.committed(new.select("path", F.col("id").alias("blob")), root, "main", "second", 2, (first,))
    return root, first, second


@query(f"""WITH x AS (SELECT {LISTED} AS path, doc_id, sha1(coalesce(text, '')) AS same FROM documents)
SELECT path, 'modified' AS status FROM x WHERE doc_id % 5 = 0 UNION ALL SELECT path, 'deleted' FROM x WHERE doc_id % 5 = 1 OR doc_id % 10 = 3 UNION ALL SELECT path, 'added' FROM x WHERE doc_id % 5 = 2 UNION ALL SELECT concat('moved/', path), 'added' FROM x WHERE doc_id % 10 = 3""")
def sub35_changed_files(s: SparkSession, d: str) -> DataFrame:
    """The files in which two commits differ, told from their trees."""
    root, first, second = _history(s, d)
    found = history.objects(s, root)
    at = lambda commit: history.listed(found, s.createDataFrame([("r", commit)], "ref string, id string"))
    return history.changes(at(first), at(second), renames=False).select("path", "status")


@query(f"""WITH x AS (SELECT {LISTED} AS path, doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents)
SELECT path, CASE doc_id % 5 WHEN 0 THEN 'modified' WHEN 1 THEN 'deleted' ELSE 'added' END AS change_type, CAST(CASE doc_id % 5 WHEN 0 THEN greatest(n - 2, 1) WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS old_start, CAST(CASE doc_id % 5 WHEN 0 THEN least(n, 3) WHEN 1 THEN n ELSE 0 END AS INTEGER) AS old_len,
  CAST(CASE doc_id % 5 WHEN 0 THEN greatest(n - 2, 1) WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS new_start, CAST(CASE doc_id % 5 WHEN 0 THEN least(n, 3) + 1 WHEN 1 THEN 0 ELSE n END AS INTEGER) AS new_len FROM x WHERE doc_id % 5 <= 2""")
def src30_hunks_of_two_commits(s: SparkSession, d: str) -> DataFrame:
    """From objects to hunks: commits, trees, blobs, the line diff of each changed file and its reading; without those that moved."""
    root, first, second = _history(s, d)
    found = history.objects(s, root)
    at = lambda commit: history.listed(found, s.createDataFrame([("r", commit)], "ref string, id string"))
    # the twin doesn't know which of several equal files moved where, so files that came or went as copies are told apart without renames
    changed = history.changes(at(first), at(second), renames=False)
    parts = history.patches(found, changed).select(F.concat_ws(":", "ref", "path").alias("ref"), F.col("patch").alias("text"))  # each file is a changeset of its own, so that none gathers all
    lines = trace.diff_lines(parts)
    told = trace.diff_files(lines)
    return trace.diff_hunks(lines, told).join(told.select("ref", "file", "change_type"), ["ref", "file"]).where("path not like 'moved/%' and not (change_type = 'deleted' and try_cast(regexp_extract(path, 'f([0-9]+)', 1) as bigint) % 10 = 3)").select("path", "change_type", "old_start", "old_len", "new_start", "new_len")


# ---- lifts and audits over kept texts ----------------------------------------------------------

REF = "concat('', doc_id)"
#: Of every other document someone has written one requirement, of its first item; the tree lacks a symbol of every third file and the last lines of every fourth.
WRITTEN = """'{"requirements": [{"item": 0, "quota": "behaviour", "statement": " must do so "}], "open_questions": ["why?"]}'"""


def _folder(s: SparkSession, name: str) -> str:
    return f"{lexical.shared(s)}/{name}-{uuid.uuid4().hex}"


def _kept(rows: DataFrame) -> DataFrame:
    """Texts (ref, text) written to the shared folder and read from it, as (path, text)."""
    return reports.stored(rows.select(F.col("ref").alias("path"), "text"), _folder(rows.sparkSession, "texts"))


def _lifted(s: SparkSession, d: str) -> reports.Lift:
    docs = table(s, d, "documents").withColumn("ref", F.expr(REF))
    bundle = reports.kept_for_lift(docs.select("ref", F.expr(TEXT).alias("text")), _evidence(s, d), _folder(s, "bundle"))
    first = F.expr(f"CASE WHEN doc_id % 3 <> 0 THEN concat('class ', {HUNK0}) ELSE 'class other' END")
    tree = docs.select("ref", F.expr(NAME).alias("path"), F.explode(F.array(F.struct(F.lit(1).alias("n"), first.alias("line")), F.struct(F.expr("CASE WHEN doc_id % 4 = 1 THEN 209 ELSE 211 END").alias("n"), F.lit("end").alias("line")))).alias("x"))
    return reports.lift(bundle, tree.select("ref", "path", "x.*"), docs.where("doc_id % 2 = 0").select("ref", F.expr(WRITTEN).alias("text")), _folder(s, "lift"))


LIFTED = f"""dx AS (SELECT *, {DIR} IN ('docs', 'specs') OR doc_id % 9 = 0 AS left_out FROM documents), fx AS (SELECT *, NOT {BINARY} AND NOT left_out AS shown, doc_id % 6 <> 0 AS second, doc_id % 2 = 0 AS written, doc_id % 3 <> 0 AS v0, doc_id % 4 <> 1 AS v1 FROM dx),
lf AS (SELECT *, CASE WHEN NOT shown THEN 0 WHEN written THEN CAST(v0 AS INT) ELSE 3 * CAST(v0 AS INT) + 3 * CAST(second AND v1 AS INT) END AS needs, CASE WHEN NOT shown THEN 0 WHEN written THEN 1 ELSE 3 + 3 * CAST(second AS INT) END AS tried,
  1 + CASE WHEN NOT shown THEN 0 ELSE CAST(NOT second AS INT) + CAST(NOT v0 AS INT) + CAST(second AND (written OR NOT v1) AS INT) END AS loose,
  CASE WHEN NOT shown THEN 0 ELSE (doc_id % 80 + 1) * CASE WHEN NOT v0 OR written THEN 1 ELSE 3 END + CASE WHEN NOT second THEN 210 WHEN NOT written AND v1 THEN 630 ELSE 210 END END + CASE WHEN doc_id = 0 THEN 1 ELSE doc_id END AS starts FROM fx WHERE NOT (written AND NOT shown))"""


@query(f"WITH {LIFTED} SELECT {REF} AS ref, needs AS requirements, tried - needs AS excluded, loose AS drifts, CASE WHEN written THEN 3 ELSE 0 END + CAST(left_out AS INT) AS questions FROM lf")
def trc01_lift_reports(s: SparkSession, d: str) -> DataFrame:
    """From diffs to reports: what each report's JSON holds."""
    size = lambda name: F.size(F.from_json(F.get_json_object("text", f"$.{name}"), "array<string>")).alias(name if name != "open_questions" else "questions")
    return _lifted(s, d).reports.select("ref", *map(size, ("requirements", "excluded", "drifts", "open_questions")))


@query(f"WITH {LIFTED} SELECT DISTINCT {REF} AS ref, 0 AS place, 'item' AS fault FROM fx WHERE written AND NOT shown")
def sub50_refused_lifts(s: SparkSession, d: str) -> DataFrame:
    """Written requirements that name no item of their bundle."""
    return _lifted(s, d).refused


@query(f"WITH {LIFTED} SELECT {REF} AS ref, CAST(needs AS BIGINT) AS needs, CAST(loose AS BIGINT) AS loose, CAST(starts AS BIGINT) AS starts, CAST(NULL AS VARCHAR) AS fault FROM lf WHERE doc_id % 10 <> 7 UNION ALL SELECT {REF}, NULL, NULL, NULL, 'version' FROM lf WHERE doc_id % 10 = 7")
def src34_lifted_items(s: SparkSession, d: str) -> DataFrame:
    """Items of kept reports, a tenth of which are of another version: how many of each ref, the sum of their first lines, and the fault."""
    kept = _kept(_lifted(s, d).reports).withColumn("text", F.when(F.col("path").cast("bigint") % 10 == 7, F.replace("text", F.lit('"version":"1"'), F.lit('"version":"0"'))).otherwise(F.col("text")))
    items, refused = reports.read_lifts(kept)
    n = lambda origin: F.count(F.when(F.col("origin") == origin, 1))
    told = items.groupBy("ref").agg(n("requirement").alias("needs"), n("drift").alias("loose"), F.sum("start_line").alias("starts"))
    return told.unionByName(refused.select("ref", "fault"), allowMissingColumns=True)


@query(f"""WITH {LIFTED}, au AS (SELECT *, needs + loose AS n FROM lf WHERE doc_id % 10 <> 7)
SELECT {REF} AS ref, CASE WHEN doc_id % 10 = 9 THEN 'dangling' END AS fault, CAST(CASE WHEN doc_id % 10 <> 9 THEN least(n, 2) END AS BIGINT) AS met, CAST(CASE WHEN doc_id % 10 <> 9 THEN greatest(n - 2, 0) END AS BIGINT) AS undocumented, CAST(CASE WHEN doc_id % 10 <> 9 THEN greatest(2 - n, 0) END AS BIGINT) AS missing,
  CASE WHEN doc_id % 10 <> 9 THEN concat('REQ-A', doc_id) END AS first_met, CAST(CASE WHEN doc_id % 10 <> 9 THEN loose END AS BIGINT) AS unverified FROM au""")
def aud04_audits_of_kept_reports(s: SparkSession, d: str) -> DataFrame:
    """Lift reports, requirements of Markdown and kept verdicts to audits: the matrix of each, its faults; a tenth of the verdicts name a requirement too many."""
    kept = _kept(_lifted(s, d).reports.where("cast(ref as bigint) % 10 <> 7"))
    items = reports.stored(reports.read_lifts(kept)[0], _folder(s, "items"))
    refs = kept.select(F.col("path").alias("ref"))
    original = audit.requirement_bullets(_bullet_docs(s, d)).select(F.substring("path", 2, 30).alias("ref"), F.col("place").alias("index"), "id")
    original = reports.stored(original.join(refs, "ref", "left_semi"), _folder(s, "original"))
    drawn = audit.placeholder_verdicts(original, items)
    extra = refs.where("cast(ref as bigint) % 10 = 9").select("ref", F.lit(5).alias("original"), F.array().cast("array<int>").alias("lifted"), F.lit(audit.MET).alias("verdict"), *(F.lit(audit.LEVELS[1]).alias(c) for c in ("confidence", "alignment")), *(F.lit(None).cast("string").alias(c) for c in ("severity", "detectability", "explanation")))
    verdicts, asked, _ = reports.read_verdicts(_kept(reports.verdict_texts(drawn.unionByName(extra), refs)))
    done = reports.audit_reports(original, items, reports.stored(verdicts, _folder(s, "verdicts")), asked, refs, _folder(s, "audit"))
    told, _ = reports.read_audits(_kept(done.reports))
    n = lambda v: F.element_at("x.matrix.counts", F.lit(v))
    doubts = F.size(F.filter(F.flatten(F.transform("x.records", lambda r: r["notes"])), lambda t: F.startswith(t, F.lit("unverified"))))
    rows = told.select("ref", F.lit(None).cast("string").alias("fault"), n(audit.MET).alias("met"), n(audit.UNDOCUMENTED).alias("undocumented"), n(audit.MISSING).alias("missing"), F.get(F.element_at("x.matrix.records_by_verdict", F.lit(audit.MET)), F.lit(0)).alias("first_met"), doubts.cast("long").alias("unverified"))
    return rows.unionByName(done.refused.select("ref", "fault").distinct(), allowMissingColumns=True)
