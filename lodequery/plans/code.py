"""Queries over the graph of code, its entry points and streams, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions import text as T
from lodequery.operators import agent, chunking, evaluate, extraction, graph, lexical
from lodequery.operators import index as kept_index
from lodequery.plans.common import Registry
from lodequery.plans.retrieval import POSTINGS, TOKENS
from lodequery.sources import store, versions
from lodequery.sources.tables import table
from lodequery.streaming import flows

REGISTRY = Registry()
QUERIES, ORACLES, query = REGISTRY.queries, REGISTRY.oracles, REGISTRY.query

# A Python file for each nation, with a class and methods for its suppliers, and a text for each document.
N = "chr(10)"


def _sources(s: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(s, d, n)
    c = F.col
    methods = t("supplier").groupBy(c("s_nationkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: F.concat(F.lit("    def sup_"), x.cast("string"), F.lit("(self):\n        shared_help()\n        self.sup_"), (x + 25).cast("string"), F.lit("()\n"))), "").alias("m"))
    head = F.concat(F.lit("import pkg.nation"), (c("n_nationkey") + 1).cast("string"), F.lit("\nfrom . import x\ndef shared_help():\n    pass\nclass Nation"), c("n_nationkey").cast("string"), F.lit("(Nation"), F.floor(c("n_nationkey") / 2).cast("string"), F.lit("):\n    kind = 1\n"))
    code = t("nation").join(methods, c("n_nationkey") == c("k"), "left").select(F.concat(F.lit("pkg/nation"), c("n_nationkey").cast("string"), F.lit(".py")).alias("path"), F.concat(head, F.coalesce("m", F.lit(""))).alias("text"), F.lit("code").alias("doc_type"), F.lit("python").alias("language"))
    words = F.concat(F.coalesce("text", F.lit("")), F.lit(" sup_"), (c("doc_id") % 40).cast("string"), F.lit(" Nation"), (c("doc_id") % 25).cast("string"))
    docs = t("documents").select(F.concat(F.lit("docs/d"), "doc_id", F.lit(".md")).alias("path"), words.alias("text"), F.lit("doc").alias("doc_type"), F.lit("markdown").alias("language"))
    return code.unionByName(docs)


PY = "concat('pkg/nation', {0}, '.py')"
SUP = f"sup AS (SELECT s_suppkey AS k, s_nationkey AS n, concat({PY.format('s_nationkey')}, '::Nation', s_nationkey, '.sup_', s_suppkey) AS id, concat('sup_', s_suppkey) AS name FROM supplier)"
NODES = f"""nd AS (SELECT {PY.format('n_nationkey')} AS id, 'module' AS kind, concat('nation', n_nationkey, '.py') AS name FROM nation UNION ALL SELECT concat('docs/d', doc_id, '.md'), 'doc', concat('d', doc_id, '.md') FROM documents
  UNION ALL SELECT concat({PY.format('n_nationkey')}, '::shared_help'), 'function', 'shared_help' FROM nation UNION ALL SELECT concat({PY.format('n_nationkey')}, '::Nation', n_nationkey), 'class', concat('Nation', n_nationkey) FROM nation UNION ALL SELECT id, 'method', name FROM sup)"""
EDGES = f"""ed AS (SELECT {PY.format('n_nationkey')} AS source, concat({PY.format('n_nationkey')}, '::shared_help') AS target, 'contains' AS type FROM nation
  UNION ALL SELECT {PY.format('n_nationkey')}, concat({PY.format('n_nationkey')}, '::Nation', n_nationkey), 'contains' FROM nation
  UNION ALL SELECT concat({PY.format('n')}, '::Nation', n), id, 'contains' FROM sup
  UNION ALL SELECT a.id, b.id, 'calls' FROM sup a JOIN sup b ON b.k = a.k + 25
  UNION ALL SELECT concat({PY.format('a.n_nationkey')}, '::Nation', a.n_nationkey), concat({PY.format('b.n_nationkey')}, '::Nation', b.n_nationkey), 'inherits' FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey // 2 AND a.n_nationkey <> b.n_nationkey
  UNION ALL SELECT {PY.format('a.n_nationkey')}, {PY.format('b.n_nationkey')}, 'imports' FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1
  UNION ALL SELECT concat('docs/d', doc_id, '.md'), sup.id, 'mentions' FROM documents JOIN sup ON sup.k = doc_id % 40
  UNION ALL SELECT concat('docs/d', doc_id, '.md'), concat({PY.format('n_nationkey')}, '::Nation', n_nationkey), 'mentions' FROM documents JOIN nation ON n_nationkey = doc_id % 25)"""
GRAPH = f"WITH {SUP}, {NODES}, {EDGES}"


@query(f"{GRAPH} SELECT id, kind, name FROM nd")
def grf01_nodes(s: SparkSession, d: str) -> DataFrame:
    docs = _sources(s, d)
    return extraction.nodes_of(docs, extraction.facts(docs)).select("id", "kind", "name")


@query(f"{GRAPH} SELECT source, target, type FROM ed")
def grf01_edges(s: SparkSession, d: str) -> DataFrame:
    return extraction.extracted(_sources(s, d))[1]


@query(f"{GRAPH} SELECT source, target, type FROM ed")
def idx05_graph_of_a_kept_index(s: SparkSession, d: str) -> DataFrame:
    """Edges over the facts of an index that was built over other sources and brought up: unchanged files aren't parsed again."""
    now, at = _sources(s, d).withColumn("mtime", F.lit(2)), f"{lexical.shared(s)}/index-{uuid.uuid4().hex}"
    other = F.when(F.col("path").rlike(r"[05]\.(py|md)$"), F.concat("text", F.lit("\ndef former():\n    shared_help()\n"))).otherwise(F.col("text"))
    before = now.where(~F.col("path").rlike(r"3\.(py|md)$")).withColumn("mtime", F.when(F.col("path").rlike(r"[05]\.(py|md)$"), 1).otherwise(2)).withColumn("text", other)
    kept_index.build(before.unionByName(now.limit(1).withColumn("path", F.lit("gone.py"))), at, vectors=False)
    return kept_index.bring_up(now, at)[0].graph()[1]


@query(f"{GRAPH} SELECT source, target FROM ed WHERE type = 'inherits'")
def jon08_bases(s: SparkSession, d: str) -> DataFrame:
    docs = _sources(s, d)
    found = extraction.facts(docs)
    return extraction.inherited(found, extraction.nodes_of(docs, found)).select("source", "target")


@query(f"{GRAPH} SELECT source, target FROM ed WHERE type = 'imports'")
def jon10_imports(s: SparkSession, d: str) -> DataFrame:
    docs = _sources(s, d)
    found = extraction.facts(docs)
    return extraction.imported(found, extraction.nodes_of(docs, found)).select("source", "target")


@query(f"{GRAPH} SELECT source, target FROM ed WHERE type = 'contains'")
def jon11_parents(s: SparkSession, d: str) -> DataFrame:
    docs = _sources(s, d)
    return extraction.contained(extraction.nodes_of(docs, extraction.facts(docs))).select("source", "target")


@query(f"{GRAPH} SELECT DISTINCT t.name, d.id AS doc FROM ed JOIN (SELECT * FROM nd WHERE kind <> 'module' AND kind <> 'doc') t ON t.id = target JOIN nd d ON d.id = source WHERE type = 'mentions'")
def grf07_related_docs(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = extraction.extracted(_sources(s, d))
    symbols = nodes.where("qualname is not null").select("name")
    return graph.related(nodes, edges, symbols, "mentions").where("kind = 'doc'").select("name", F.col("id").alias("doc"))


@query("""SELECT language, kind, count(*) AS files FROM (SELECT list_extract(['python', 'javascript', 'java', 'go', 'c', 'ruby'], CAST(page_id % 6 + 1 AS INTEGER)) AS language FROM pages), (SELECT unnest(['calls', 'imports', 'inherits']) AS kind)
WHERE language = 'python' OR (language <> 'ruby' AND kind = 'calls') GROUP BY 1, 2""")
def grf14_coverage(s: SparkSession, d: str) -> DataFrame:
    """How many files of the corpus each kind of edge is read from, by language."""
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".js", ".java", ".go", ".c", ".rb"))), (F.col("page_id") % 6 + 1).cast("int"))
    found = table(s, d, "pages").select(T.language(F.concat(F.lit("f"), "page_id", suffix)).alias("language"))
    return extraction.coverage(found)


@query(f"{GRAPH} SELECT source, target, max(type) AS type FROM (SELECT source, target, type FROM ed UNION SELECT source, target, 'calls' FROM ed WHERE type = 'contains') GROUP BY 1, 2")
def grf02_one_type_a_pair(s: SparkSession, d: str) -> DataFrame:
    edges = extraction.extracted(_sources(s, d))[1]
    return extraction.one_type_a_pair(edges.unionByName(edges.where("type = 'contains'").withColumn("type", F.lit("calls"))))


# A source for each document, in one of four languages: a class where the language has one, two functions, and calls between them and of the next document's; strings and
# comments hold braces and calls that are none, among them the document's own text.
HIDDEN = "concat('/* { call', doc_id, '( ', regexp_replace(coalesce(text, ''), '[*/]', ' '), ' */')"
BRACES = {
    "java": ("java", "concat({h}, {n}, 'class K', doc_id, ' extends K0 {{', {n}, '  int f', doc_id, '(int a) {{ String s = \"g( {{\"; return g', doc_id, '(a) + h', doc_id + 1, '(); }}', {n}, '  @Over() void g', doc_id, '(int b) throws E {{ new N(b); }}', {n}, '}}', {n})"),
    "go": ("go", "concat('package p', {n}, {h}, {n}, 'type K', doc_id, ' struct {{ a int }}', {n}, 'func (k *K', doc_id, ') f', doc_id, '(a int) int {{ s := chr(123); return k.g', doc_id, '(a) + h', doc_id + 1, '() }}', {n}, 'func g', doc_id, '() {{ if (a) {{ }} }}', {n})"),
    "javascript": ("js", "concat({h}, {n}, 'class K', doc_id, ' {{', {n}, '  f', doc_id, '(a) {{ const r = /[{{(]/; return this.g', doc_id, '(a) + h', doc_id + 1, '() }}', {n}, '  async g', doc_id, '(b) {{ for (const x of b) {{ new N(x) }} }}', {n}, '}}', {n})"),
    "c": ("c", "concat('#define M {{', {n}, {h}, {n}, 'static int f', doc_id, '(int a) {{ char *s = \"}}\"; return g', doc_id, '(a) + h', doc_id + 1, '(); }}', {n}, 'struct p *g', doc_id, '(void) {{ while (1) {{ }} }}', {n}, 'int x = 3;', {n})"),
}


def _braces(s: SparkSession, d: str) -> DataFrame:
    rows = []
    for k, (language, (suffix, body)) in enumerate(BRACES.items()):
        hidden = HIDDEN
        own = table(s, d, "documents").where(f"doc_id % 4 = {k}")
        rows.append(own.select(F.expr(f"concat('src/f', doc_id, '.{suffix}')").alias("path"), F.expr(body.format(h=hidden, n="chr(10)")).alias("text"), F.lit("code").alias("doc_type"), F.lit(language).alias("language"), "doc_id"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


SOURCE = "concat('src/f', doc_id, list_extract(['.java', '.go', '.js', '.c'], CAST(doc_id % 4 + 1 AS INTEGER)))"
INSIDE = "CASE WHEN doc_id % 4 IN (0, 2) THEN concat('K', doc_id, '.') ELSE '' END"


@query(f"""SELECT {SOURCE} AS path, concat('K', doc_id) AS qualname, 'class' AS kind FROM documents WHERE doc_id % 4 <> 3
UNION ALL SELECT {SOURCE}, concat({INSIDE}, unnest(['f', 'g']), doc_id), CASE WHEN doc_id % 4 IN (0, 2) THEN 'method' ELSE 'function' END FROM documents""")
def grf02_definitions_in_braces(s: SparkSession, d: str) -> DataFrame:
    """Definitions of sources in Java, Go, JavaScript and C, as many as there are documents."""
    return extraction.facts(_braces(s, d)).where("fact = 'symbol'").select("path", F.col("source").alias("qualname"), "kind")


@query(f"SELECT {SOURCE} AS path, concat({INSIDE}, 'f', doc_id) AS caller, unnest([concat('g', doc_id), concat('h', doc_id + 1)]) AS callee FROM documents UNION ALL SELECT {SOURCE}, concat('f', doc_id), 'chr' FROM documents WHERE doc_id % 4 = 1")
def grf03_calls_in_braces(s: SparkSession, d: str) -> DataFrame:
    """Calls in the same sources: none from strings, comments, patterns, annotations or constructions."""
    return extraction.facts(_braces(s, d)).where("fact = 'call'").select("path", F.col("source").alias("caller"), F.col("name").alias("callee"))


@query(f"""WITH x AS (SELECT doc_id, {SOURCE} AS path, len(string_split(coalesce(text, ''), chr(10))) AS h, doc_id % 4 AS k FROM documents),
u AS (SELECT path, 'module' AS node_type, CAST(NULL AS VARCHAR) AS qualname, 1 AS a, CASE k WHEN 1 THEN h + 1 WHEN 3 THEN h + 1 ELSE h END AS b FROM x
UNION ALL SELECT path, 'class', concat('K', doc_id), CASE k WHEN 1 THEN h + 2 ELSE h + 1 END, CASE k WHEN 1 THEN h + 2 ELSE h + 1 END FROM x WHERE k <> 3
UNION ALL SELECT path, CASE WHEN k IN (0, 2) THEN 'method' ELSE 'function' END, concat(CASE WHEN k IN (0, 2) THEN concat('K', doc_id, '.') ELSE '' END, o, doc_id), s, s FROM (SELECT *, unnest(['f', 'g']) AS o, unnest([CASE k WHEN 0 THEN h + 2 WHEN 1 THEN h + 3 WHEN 2 THEN h + 2 ELSE h + 2 END, CASE k WHEN 0 THEN h + 3 WHEN 1 THEN h + 4 WHEN 2 THEN h + 3 ELSE h + 3 END]) AS s FROM x)
UNION ALL SELECT path, 'module', NULL, h + 4, h + 4 FROM x WHERE k = 3)
SELECT path, node_type, qualname, CAST(a AS INTEGER) AS start_line, CAST(b AS INTEGER) AS end_line FROM u""")
def chk02_units_in_braces(s: SparkSession, d: str) -> DataFrame:
    """Units of the same sources with their lines; none is parted."""
    return chunking.code_chunks(_braces(s, d), size=2**30, id_="path").select(F.col("id").alias("path"), "node_type", "qualname", "start_line", "end_line")


# questions that name suppliers, and names of symbols to find them by
ASK = "CASE s_suppkey % 4 WHEN 0 THEN concat('who calls sup_', s_suppkey, ' and BuildIndex?') WHEN 1 THEN concat('building the indexer of item', s_suppkey % 10) WHEN 2 THEN 'plain words only' ELSE concat('see Item', s_suppkey % 10, 'Builder.load or itemBuilders') END"


def _questions(s, d):
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.expr(ASK).alias("query"))


def _symbols(s, d):
    c = F.col("s_suppkey")
    own = table(s, d, "supplier").select(F.concat(F.lit("sup_"), c).alias("name"))
    return own.union(table(s, d, "supplier").where("s_suppkey < 10").select(F.concat(F.lit("Item"), c, F.lit("Builder.load")))).union(s.createDataFrame([("BuildIndex",), ("HTTPServer",)], "name string"))


@query("SELECT s_suppkey AS query_id, CASE s_suppkey % 4 WHEN 0 THEN concat('sup_', s_suppkey, ',BuildIndex') WHEN 3 THEN concat('Item', s_suppkey % 10, 'Builder.load,itemBuilders') ELSE '' END AS names FROM supplier")
def grf10_identifiers(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).select("query_id", F.array_join(graph.identifiers(F.col("query")), ",").alias("names"))


@query()
def grf11_name_parts(s: SparkSession, d: str) -> DataFrame:
    return _symbols(s, d).select("name", F.array_join(graph.parts_of(F.col("name")), ",").alias("parts"))


@query("SELECT a.n_name AS part, b.n_name AS word, a.n_name = b.n_name OR (length(a.n_name) >= 4 AND length(b.n_name) >= 4 AND left(a.n_name, 4) = left(b.n_name, 4)) AS akin FROM nation a JOIN nation b ON left(a.n_name, 2) = left(b.n_name, 2)")
def grf12_akin(s: SparkSession, d: str) -> DataFrame:
    a, b = table(s, d, "nation").select(F.col("n_name").alias("part")), table(s, d, "nation").select(F.col("n_name").alias("word"))
    rows = a.join(b, F.substring("part", 1, 2) == F.substring("word", 1, 2))
    return rows.select("part", "word", graph.akin(F.col("part"), F.col("word")).alias("akin"))


#: Humps part where a lower letter or digit meets an upper one, and before the last upper one of several.
QUALIFIED = r"list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1.\2', 'g'), '([A-Z])([A-Z][a-z])', '\1.\2', 'g'), '[._]', '.', 'g')), '.'), lambda x: x <> ''))"
ENTRY = rf"""WITH ask AS (SELECT s_suppkey AS query_id, {ASK} AS query FROM supplier),
sym AS (SELECT DISTINCT name FROM (SELECT concat('sup_', s_suppkey) AS name FROM supplier UNION ALL SELECT concat('Item', s_suppkey, 'Builder.load') FROM supplier WHERE s_suppkey < 10 UNION ALL SELECT unnest(['BuildIndex', 'HTTPServer']))),
written AS (SELECT query_id, name, pos FROM (SELECT query_id, unnest(n) AS name, generate_subscripts(n, 1) AS pos FROM (SELECT query_id, CASE query_id % 4 WHEN 0 THEN [concat('sup_', query_id), 'BuildIndex'] WHEN 3 THEN [concat('Item', query_id % 10, 'Builder.load'), 'itemBuilders'] ELSE [] END AS n FROM ask)) SEMI JOIN sym USING (name)),
word AS (SELECT DISTINCT query_id, lower(unnest(regexp_extract_all(query, '[a-zA-Z][a-zA-Z0-9]*'))) AS word FROM ask), part AS (SELECT name, len(ps) AS n, unnest(ps) AS part FROM (SELECT name, {QUALIFIED} AS ps FROM sym)),
tab AS (SELECT query_id, name, max(overlap) AS overlap FROM (SELECT query_id, name, count(DISTINCT part) AS overlap FROM word JOIN part ON part = word OR (length(part) >= 4 AND length(word) >= 4 AND left(part, 4) = left(word, 4)) GROUP BY 1, 2 HAVING count(DISTINCT part) >= 2
  UNION ALL SELECT query_id, name, n + 1 FROM (SELECT DISTINCT query_id, lower(unnest(regexp_extract_all(query, '[A-Za-z0-9_.]+'))) AS low FROM ask) JOIN (SELECT DISTINCT name, n FROM part) ON lower(name) = low) GROUP BY 1, 2),
every AS (SELECT query_id, name, 'extracted_from_query' AS source, 0 AS kind, pos FROM written UNION ALL SELECT query_id, name, 'symbol_table_match', 1, -overlap FROM tab ANTI JOIN written USING (query_id, name))
SELECT query_id, CAST(place AS INTEGER) AS place, name, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, pos, name) AS place FROM every) WHERE place <= 3"""


@query(ENTRY)
def ord06_entry_points(s: SparkSession, d: str) -> DataFrame:
    return graph.entry_points(_questions(s, d), _symbols(s, d))


@query("SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 4 = 2 THEN 'not_attempted' WHEN s_suppkey % 8 = 4 THEN 'partial' ELSE 'ok' END AS status FROM supplier")
def sub12_branch_status(s: SparkSession, d: str) -> DataFrame:
    asked = _questions(s, d)
    points = graph.entry_points(asked, _symbols(s, d))
    sections = points.select("query_id", "name", F.lit("callers").alias("section"), F.when(F.col("query_id") % 8 == 4, "graph_artifact_unusable").alias("reason"))
    return graph.branch_status(asked, points, sections).select("query_id", "status")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'graph_not_built' WHEN 1 THEN 'navigation_library_missing' ELSE 'graph_artifact_unusable' END AS reason FROM events")
def sub11_unavailable_reasons(s: SparkSession, d: str) -> DataFrame:
    c = F.col("event_id") % 3
    return table(s, d, "events").select("event_id", graph.unavailable_reason(F.when(c == 0, "GraphNotFound").otherwise("Config"), F.when(c == 1, "graph").otherwise("path")).alias("reason"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 50 ELSE 3 END AS INTEGER) AS total FROM supplier")
def sub13_section_totals(s: SparkSession, d: str) -> DataFrame:
    c = F.col("s_suppkey")
    totals = F.when(c % 2 == 0, F.create_map(F.lit("callers"), (c % 50).cast("int"))).otherwise(F.create_map(F.lit("callees"), F.lit(1)))
    return table(s, d, "supplier").select("s_suppkey", graph.total_for(totals, "callers", F.array(F.lit(1), F.lit(2), F.lit(3))).alias("total"))


@query("SELECT doc_id AS id, 1 AS query_id, concat('n', doc_id % 30) AS path, coalesce((SELECT string_agg(DISTINCT s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = doc_id % 30 AND s_suppkey % 3 = 0), '') AS names FROM documents")
def jon14_corroborated(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "documents").select(F.lit(1).alias("query_id"), F.col("doc_id").alias("id"), F.concat(F.lit("n"), F.col("doc_id") % 30).alias("path"))
    own = table(s, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("n"), "s_nationkey").alias("path"), F.col("s_name").alias("name"))
    return graph.corroborated(hits, own).withColumn("names", F.array_join("names", ","))


@query("""WITH cs AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'who_calls' ELSE 'defines' END AS relation, s_suppkey AS k FROM supplier),
x AS (SELECT relation, k, CASE WHEN relation = 'defines' OR EXISTS (SELECT 1 FROM supplier o WHERE o.s_suppkey = k - 25) THEN 1 ELSE 0 END AS got, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS ghost, CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END AS told FROM cs),
m AS (SELECT relation, CASE WHEN got = 0 THEN 1.0 WHEN told = 1 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN ghost + got * told = 0 THEN 1.0 ELSE got * told / (ghost + got * told) END AS r FROM x)
SELECT relation, count(*) AS n, round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall FROM m GROUP BY 1""")
def evl04_graph_evaluation(s: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the graph's answers against what the suppliers' own table says; every third case expects a ghost besides, every fifth isn't told."""
    nodes, edges = extraction.extracted(_sources(s, d))
    c = F.col("s_suppkey")
    own = table(s, d, "supplier").withColumn("relation", F.when(c % 2 == 0, "who_calls").otherwise("defines")).withColumn("target", F.concat(F.lit("sup_"), c))
    ref = lambda k, n: F.concat(F.lit("pkg/nation"), n, F.lit(".py#Nation"), n, F.lit(".sup_"), k)
    by = table(s, d, "supplier").select((c + 25).alias("s_suppkey"), ref(c, F.col("s_nationkey")).alias("ref"))
    callers = own.where("relation = 'who_calls' and s_suppkey % 5 <> 0").join(by, "s_suppkey").select("relation", "target", "ref")
    defined = own.where("relation = 'defines' and s_suppkey % 5 <> 0").select("relation", "target", ref(c, F.col("s_nationkey")).alias("ref"))
    ghosts = own.where("s_suppkey % 3 = 0").select("relation", "target", F.lit("ghost").alias("ref"))
    cases = own.select("relation", "target")
    metrics = evaluate.graph_metrics(evaluate.graph_answers(nodes, edges, cases), callers.unionByName(defined).unionByName(ghosts), cases)
    return metrics.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.avg("recall"), 6).alias("mean_recall"))


@query(f"{GRAPH} SELECT concat('sup_', k) AS target, concat('x', k) AS ref FROM sup WHERE k % 5 = 0")
def evl05_unknown_references(s: SparkSession, d: str) -> DataFrame:
    nodes, edges = extraction.extracted(_sources(s, d))
    cases = nodes.where("kind = 'method'").select(F.lit("defines").alias("relation"), F.col("name").alias("target"))
    answers = evaluate.graph_answers(nodes, edges, cases)
    fake = cases.where("try_cast(substr(target, 5) AS BIGINT) % 5 = 0").select("relation", "target", F.concat(F.lit("x"), F.substring("target", 5, 20)).alias("ref"))
    return evaluate.unknown_refs(answers.unionByName(fake), answers).select("target", "ref")


# ---- an agent's context ------------------------------------------------------------------------

AGENT = f"""WITH {SUP}, {POSTINGS}, q AS (SELECT item_id AS query_id, concat(text, ' sup_', item_id % 40) AS query FROM benchmark), qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS.format("query")}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM post JOIN qt USING (term) JOIN idf USING (term), size GROUP BY query_id, id),
fl AS (SELECT query_id, doc_id, CASE WHEN lang = 'en' THEN 'code' ELSE 'docs' END AS branch, row_number() OVER (PARTITION BY query_id, lang = 'en' ORDER BY score DESC, id) AS place FROM sc JOIN documents ON doc_id = id),
pt AS (SELECT query_id, sup.* FROM q JOIN sup ON k = query_id % 40),
sec AS (SELECT query_id, name, 'definitions' AS section, replace(id, '::', '#') AS ref, 10 AS most FROM pt
  UNION ALL SELECT query_id, pt.name, 'callers', replace(o.id, '::', '#'), 8 FROM pt JOIN sup o ON o.k = pt.k - 25 UNION ALL SELECT query_id, pt.name, 'callees', replace(o.id, '::', '#'), 8 FROM pt JOIN sup o ON o.k = pt.k + 25
  UNION ALL SELECT query_id, pt.name, 'docs', concat('docs/d', doc_id, '.md'), 8 FROM pt JOIN documents ON doc_id % 40 = pt.k)
SELECT fl.query_id, branch, 'passages' AS section, CAST(place AS INTEGER) AS place, concat('', doc_id) AS id, CASE WHEN branch = 'code' AND n = doc_id % 25 THEN name ELSE '' END AS detail FROM fl LEFT JOIN pt ON pt.query_id = fl.query_id WHERE place <= 5
UNION ALL SELECT query_id, 'graph', concat(name, ':', section), CAST(place AS INTEGER), ref, concat('', total) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, name, section ORDER BY ref) AS place, count(*) OVER (PARTITION BY query_id, name, section) AS total FROM sec) WHERE place <= most"""


def _asked(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" sup_"), F.col("item_id") % 40).alias("query"))


def _context(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The context of all questions, and the graph's nodes."""
    docs = table(s, d, "documents")
    path = F.when(F.col("lang") == "en", F.concat(F.lit("pkg/nation"), F.col("doc_id") % 25, F.lit(".py"))).otherwise(F.concat(F.lit("notes/"), "doc_id"))
    own = docs.select(F.col("doc_id").alias("id"), path.alias("path"), F.when(F.col("lang") == "en", "code").otherwise("doc").alias("doc_type"))
    nodes, edges = extraction.extracted(_sources(s, d))
    return agent.context(lexical.indexed(docs), own, _asked(s, d), nodes, edges), nodes


@query(AGENT)
def grf13_agent_context(s: SparkSession, d: str) -> DataFrame:
    """For each question two flows of passages, the graph's sections of the symbol it names, and which passages that symbol's file supports."""
    return _context(s, d)[0]


@query(f"WITH {SUP} SELECT item_id AS query_id, branch, CASE branch WHEN 'graph' THEN CASE WHEN item_id % 40 IN (SELECT k FROM sup) THEN 'ok' ELSE 'not_attempted' END ELSE 'ok' END AS status FROM benchmark, (SELECT unnest(['docs', 'code', 'graph']) AS branch)")
def grf13_branch_status(s: SparkSession, d: str) -> DataFrame:
    asked = _asked(s, d)
    rows, nodes = _context(s, d)
    points = graph.entry_points(asked, nodes.where("qualname is not null").select("name"))
    return agent.status(asked, rows, points)


# ---- streams -----------------------------------------------------------------------------------


def _fed(s: SparkSession, d: str, rows: DataFrame, parts: int, work, batch: str | None = None) -> DataFrame:
    """A stream over rows that arrive in `parts` batches, run to its end; what work(stream, folder) gives.

    batch: an expression that numbers the batches from 0. A batch has as many files as tasks wrote it; it arrives as a folder, and the stream runs
    over it before the next one does.
    """
    at = f"{lexical.shared(s)}/stream-{uuid.uuid4().hex}"
    if batch is None:
        rows.repartition(parts).write.parquet(f"{at}/in")
        return work(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), at)
    rows.withColumn("_batch", F.expr(batch)).write.partitionBy("_batch").parquet(f"{at}/staged")
    for i in range(parts):
        staged, fs = versions.file_of(s, f"{at}/staged/_batch={i}")
        if fs.exists(staged):
            fs.mkdirs(versions.file_of(s, f"{at}/in")[0])
            fs.rename(staged, versions.file_of(s, f"{at}/in/{i}")[0])
        else:  # an empty batch is one, too
            s.createDataFrame([], rows.schema).write.parquet(f"{at}/in/{i}")
        out = work(s.readStream.schema(rows.schema).parquet(f"{at}/in/*"), at)
    return out


@query("SELECT date_trunc('day', ts) AS begin, event_type AS operation, count(*) AS n FROM events GROUP BY 1, 2")
def str01_day_counts(s: SparkSession, d: str) -> DataFrame:
    """Counts of a stream of six batches in the order of time, its windows closed by the watermark; a last row far ahead closes the last."""
    rows = table(s, d, "events").select("ts", F.col("event_type").alias("operation"))
    span = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    ahead = span.select((F.col("b") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("end").alias("operation"), F.lit(6).alias("part"))
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    part = F.least(F.lit(5), F.floor(6 * (seconds("ts") - seconds("a")) / (1 + seconds("b") - seconds("a"))).cast("int"))
    fed = rows.join(F.broadcast(span)).select("ts", "operation", part.alias("part")).unionByName(ahead)

    def work(stream: DataFrame, at: str) -> DataFrame:
        flows.finished(flows.bucket_counts(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode("append"))
        return s.read.schema("begin timestamp, operation string, n long").parquet(f"{at}/out")

    return _fed(s, d, fed, 7, work, "part").where("operation <> 'end' or operation is null").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("SELECT content_hash, count(*) AS n FROM (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def str03_ingested_once(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("content_hash"))

    def work(stream: DataFrame, at: str) -> DataFrame:
        flows.finished(flows.ingested(stream, f"{at}/out", ["content_hash"], f"{at}/log"))
        return store.kept(s, f"{at}/out", rows)

    return _fed(s, d, rows, 4, work).groupBy("content_hash").agg(F.count("*").alias("n"))


def _states(s, d):
    """States of every document's file over eight batches: it comes in one, a third change in a later one, a seventh go in one after that, and
    some of these come again in the last."""
    c = F.col
    docs = table(s, d, "documents")
    row = lambda when, part, mtime, text, gone: docs.where(when).select(F.concat(F.lit("d"), "doc_id").alias("path"), mtime.alias("mtime"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("content_hash"), F.lit("v").alias("logic_version"), F.lit(gone).alias("gone"), part.cast("int").alias("part"))
    first = row("true", c("doc_id") % 3, c("n_chars"), F.concat("text", F.lit("!")), False)
    second = row("doc_id % 3 = 0", 3 + c("doc_id") % 2, c("n_chars") + 1, c("text"), False)
    third = row("doc_id % 7 = 0", 5 + c("doc_id") % 2, c("n_chars") + 2, c("text"), True)
    return first.unionByName(second).unionByName(third).unionByName(row("doc_id % 21 = 0", F.lit(7), c("n_chars") + 3, F.concat("text", F.lit("?")), False))


@query("SELECT concat('d', doc_id) AS path, sha256(coalesce(CASE WHEN doc_id % 21 = 0 THEN text || '?' WHEN doc_id % 3 = 0 THEN text ELSE text || '!' END, '')) AS content_hash, CAST(n_chars + CASE WHEN doc_id % 21 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS mtime FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 21 = 0")
def str04_manifest_kept_up(s: SparkSession, d: str) -> DataFrame:
    rows = _states(s, d)

    def work(stream: DataFrame, at: str) -> DataFrame:
        flows.finished(flows.kept_up(stream.drop("part"), f"{at}/manifest", f"{at}/log"))
        return store.kept(s, f"{at}/manifest", rows.drop("gone", "part"))

    return _fed(s, d, rows, 8, work, "part").select("path", "content_hash", "mtime")


@query("SELECT concat('d', doc_id) AS path, sha256(coalesce(CASE WHEN doc_id % 21 = 0 THEN text || '?' ELSE text END, '')) AS content_hash FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 21 = 0 OR doc_id % 2 = 0")
def str06_reconciled(s: SparkSession, d: str) -> DataFrame:
    """Every sixth batch the state of all files replaces the manifest; the seventh and eighth change that."""
    rows = _states(s, d)
    full = lambda: table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("n_chars").alias("mtime"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), F.lit("v").alias("logic_version"))

    def work(stream: DataFrame, at: str) -> DataFrame:
        flows.finished(flows.kept_up(stream.drop("part"), f"{at}/manifest", f"{at}/log", 6, full))
        return store.kept(s, f"{at}/manifest", rows.drop("gone", "part"))

    return _fed(s, d, rows, 8, work, "part").select("path", "content_hash")
