"""Queries over chunks, embeddings, the index's state and what is kept of it, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions import embed as E
from lodequery.functions import text as T
from lodequery.operators import chunking, incremental, lexical
from lodequery.operators import index as kept_index
from lodequery.plans.common import Registry
from lodequery.plans.retrieval import POSTINGS, TOKENS
from lodequery.sources import files, store
from lodequery.sources.tables import table

REGISTRY = Registry()
QUERIES, ORACLES, query = REGISTRY.queries, REGISTRY.oracles, REGISTRY.query

# documents as Markdown: every fifth line is a heading of level 1 to 3
MARKED = "md AS (SELECT doc_id AS id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), mk AS (SELECT id, n, CASE WHEN n % 5 = 0 THEN repeat('#', CAST((n // 5) % 3 + 1 AS INTEGER)) || ' ' || line ELSE line END AS line FROM md)"
SECTIONS = rf"""{MARKED},
hd AS (SELECT *, CASE WHEN regexp_matches(line, '(?s)^#{{1,6}}\s+.*\S\s*$') THEN length(regexp_extract(line, '^(#+)', 1)) ELSE 0 END AS level, CASE WHEN regexp_matches(line, '(?s)^#{{1,6}}\s+.*\S\s*$') THEN regexp_extract(line, '(?s)^#{{1,6}}\s+(.*\S)\s*$', 1) END AS title FROM mk),
sx AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n) AS section FROM hd),
sec AS (SELECT id, section, min(n) + 1 AS start_line, max(n) + 1 AS end_line, max(level) AS level, max(title) AS heading, string_agg(line, chr(10) ORDER BY n) AS text FROM sx GROUP BY id, section),
anc AS (SELECT s.id, s.section, string_agg(a.heading, ' > ' ORDER BY a.section) AS heading_path FROM sec s JOIN sec a ON a.id = s.id AND a.section > 0 AND a.section <= s.section AND (a.section = s.section OR a.level < s.level)
  WHERE NOT EXISTS (SELECT 1 FROM sec b WHERE b.id = s.id AND b.section > a.section AND b.section <= s.section AND b.level <= a.level) GROUP BY 1, 2),
fin AS (SELECT sec.*, coalesce(heading_path, '') AS heading_path, row_number() OVER (PARTITION BY sec.id ORDER BY sec.section) - 1 AS ordinal FROM sec LEFT JOIN anc USING (id, section) WHERE sec.section > 0 OR regexp_matches(text, '\S'))"""


#: The same with the headings of a path joined as a flat payload has them.
SLASHED = SECTIONS.replace("' > '", "'/'")


def _marked(s: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.floor(i / 5) % 3 + 1).cast("int")), F.lit(" "), x)).otherwise(x))
    return table(s, d, "documents").withColumn("text", F.array_join(lines, "\n"))


@query(f"WITH {SECTIONS} SELECT id, CAST(ordinal AS INTEGER) AS ordinal, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, CAST(level AS INTEGER) AS level, heading, heading_path, text FROM fin")
def win04_markdown_sections(s: SparkSession, d: str) -> DataFrame:
    return chunking.markdown_sections(_marked(s, d)).withColumn("heading_path", F.array_join("heading_path", " > "))


@query()
def chk02_code_units(s: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit("import x\n# note\nclass A"), "doc_id", F.lit("(B):\n    y = 1\n    @deco\n    def m(self):\n        return 1\n\n    class In:\n        def n(self): pass\n\ndef f():\n    return '''"), F.regexp_replace("text", r"['\\\\]", ""), F.lit("'''\n\nz = 3\n"))
    docs = table(s, d, "documents").select("doc_id", body.alias("text"), F.when(F.col("doc_id") % 5 == 0, "go").otherwise("python").alias("language"))
    return chunking.code_chunks(docs)


def _typed(s, d):
    docs = _marked(s, d)
    return docs.select("doc_id", "text", F.when(F.col("lang") == "en", "code").otherwise("doc").alias("doc_type"), F.lit("go").alias("language"), F.concat(F.lit("p/"), "doc_id").alias("path"))


@query()
def chk07_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(_typed(s, d), most_tokens=400)


@query()
def chk05_capped_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.cap(rows, 200, 20)


@query(f"WITH {SLASHED}, p AS (SELECT concat(id, '#', ordinal) AS chunk_id, id, start_line, heading_path, text FROM fin) SELECT chunk_id, concat('p/', id) AS path, concat('', start_line) AS start_line, nullif(heading_path, '') AS heading_path, CAST(NULL AS VARCHAR) AS qualname, 'markdown' AS chunker FROM p WHERE id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def chk09_flat_payloads(s: SparkSession, d: str) -> DataFrame:
    docs = _typed(s, d).where("doc_type = 'doc'")
    none = F.lit(None).cast("string")
    sections = chunking.markdown_sections(docs).select("id", "text", "start_line", "end_line", "heading_path", F.lit("markdown").alias("chunker"), none.alias("qualname"), none.alias("node_type"), F.concat_ws("#", "id", "ordinal").alias("chunk_id"))
    rows = chunking.payload(sections, docs)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema["payload"].dataType.fields}
    flat = rows.select("chunk_id", chunking.flat_payload(F.col("payload"), fields).alias("m"))
    return flat.select("chunk_id", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("path", "start_line", "heading_path", "qualname", "chunker")))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9a-zA-Z]+')) AS n, sha256(array_to_string(regexp_extract_all(text, '[0-9a-zA-Z]+'), ' ')) AS tokens_sha256 FROM documents")
def emb04_plain_tokens(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").select("doc_id", E.plain_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


GRAMS = "flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, greatest(length(w) + 4 - n, 1)), lambda i: substr(' ' || w || ' ', i, n))))))"


@query(f"SELECT item_id, len(g) AS n, sha256(array_to_string(g, '|')) AS grams_sha256 FROM (SELECT item_id, {GRAMS} AS g FROM benchmark)")
def emb02_ngrams(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "benchmark").select("item_id", E.ngrams(F.col("text")).alias("g"))
    return t.select("item_id", F.size("g").cast("long").alias("n"), F.sha2(F.array_join("g", "|"), 256).alias("grams_sha256"))


@query()
def emb01_hashed_vectors(s: SparkSession, d: str) -> DataFrame:
    return E.hashed(table(s, d, "documents").select("doc_id", "text"))


@query()
def emb05_humps(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", E.humps(F.concat(F.initcap("c_mktsegment"), F.lit("HTTPServer2x"))).alias("words"))


# a small vocabulary: the words of the benchmark of 5 letters, with vectors made of their letters
VOCABULARY = "vo AS (SELECT word, [ascii(word) / 10.0, length(word), ascii(substr(word, 2, 1)) / 7.0] AS v FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[0-9a-z]+')) AS word FROM benchmark) WHERE length(word) = 5)"


def _vocabulary(s, d):
    words = table(s, d, "benchmark").select(F.explode(E.plain_tokens(F.lower("text"))).alias("word")).where("length(word) = 5").distinct()
    vector = F.array(F.ascii("word") / 10.0, F.length("word").cast("double"), F.ascii(F.substring("word", 2, 1)) / 7.0)
    return words.select("word", vector.alias("vector"))


TOKEN_VECTORS = "tk AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[0-9a-zA-Z]+'))) AS word FROM documents), tv AS (SELECT doc_id, v FROM tk JOIN vo USING (word))"


@query(f"WITH {VOCABULARY}, {TOKEN_VECTORS} SELECT doc_id AS id, count(*) AS n FROM tv GROUP BY 1")
def sub04_known_tokens(s: SparkSession, d: str) -> DataFrame:
    return E.vectors_of(table(s, d, "documents").select("doc_id", F.lower("text").alias("text")), _vocabulary(s, d), "doc_id").groupBy("id").agg(F.count("*").alias("n"))


@query(f"""WITH {VOCABULARY}, {TOKEN_VECTORS}, m AS (SELECT doc_id, avg(v[1]) AS a, avg(v[2]) AS b, avg(v[3]) AS c FROM tv GROUP BY 1)
SELECT d.doc_id AS id, round(coalesce(a / sqrt(a * a + b * b + c * c), 0), 6) AS a, round(coalesce(b / sqrt(a * a + b * b + c * c), 0), 6) AS b, round(coalesce(c / sqrt(a * a + b * b + c * c), 0), 6) AS c FROM documents d LEFT JOIN m USING (doc_id)""")
def emb03_word_means(s: SparkSession, d: str) -> DataFrame:
    rows = E.word_means(table(s, d, "documents").select("doc_id", F.lower("text").alias("text")), _vocabulary(s, d), "doc_id", dim=3)
    return rows.select("id", *(F.round(F.col("vector")[i], 6).alias(n) for i, n in enumerate("abc")))


# ---- what is kept of an index ------------------------------------------------------------------

CHUNKS = "ck AS (SELECT concat('d', doc_id) AS doc_id, unnest(range(0, CAST(doc_id % 3 + 1 AS BIGINT))) AS ordinal FROM documents)"


def _chunks(s, d):
    docs = table(s, d, "documents")
    rows = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("doc_id") % 3).cast("long"))).alias("ordinal"))
    return rows.withColumn("chunk_id", F.concat_ws("#", "doc_id", "ordinal"))


def _some(s, d):
    return table(s, d, "documents").where("doc_id % 20 = 0").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"))


@query(f"WITH {CHUNKS} SELECT ck.doc_id, ordinal, sha256(coalesce(text, '')) AS text_sha256 FROM ck JOIN documents d ON ck.doc_id = concat('d', d.doc_id) WHERE d.doc_id % 20 = 0")
def src13_kept_units(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return incremental.units(docs, _chunks(s, d), _some(s, d)).select("doc_id", "ordinal", "text_sha256")


@query(f"WITH {CHUNKS} SELECT concat(doc_id, '#', ordinal) AS chunk_id FROM ck WHERE doc_id IN (SELECT concat('d', doc_id) FROM documents WHERE doc_id % 20 = 0)")
def src14_chunk_ids(s: SparkSession, d: str) -> DataFrame:
    return _chunks(s, d).join(_some(s, d), "doc_id", "left_semi").select("chunk_id")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS vector FROM documents WHERE doc_id % 2 = 0 AND sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 20 = 0) GROUP BY 1")
def src15_cached_vectors(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.lit("m").alias("model"), F.sha2("text", 256).alias("content_hash"))
    cache = docs.where("doc_id % 2 = 0").groupBy("model", "content_hash").agg(F.min("doc_id").alias("vector"))
    return incremental.cached(cache, docs.where("doc_id % 20 = 0")).select("content_hash", "vector")


@query(f"WITH {CHUNKS} SELECT CAST(place AS INTEGER) AS place, chunk_id FROM (SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS place, concat('d', doc_id, '#', doc_id % 4) AS chunk_id FROM documents WHERE doc_id % 20 = 0) WHERE chunk_id IN (SELECT concat(doc_id, '#', ordinal) FROM ck)")
def src17_entries_in_order(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "documents").where("doc_id % 20 = 0").select("doc_id", F.concat(F.lit("d"), "doc_id", F.lit("#"), F.col("doc_id") % 4).alias("chunk_id"))
    wanted = ids.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("doc_id")).alias("o"), "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    return incremental.in_order(_chunks(s, d), wanted.select(F.posexplode("ids").alias("place", "chunk_id")), "chunk_id").select("place", "chunk_id")


@query(f"WITH {CHUNKS} SELECT concat('d', doc_id, '#', doc_id % 4) AS chunk_id FROM documents WHERE concat('d', doc_id, '#', doc_id % 4) IN (SELECT concat(doc_id, '#', ordinal) FROM ck)")
def ret20_ids_that_exist(s: SparkSession, d: str) -> DataFrame:
    asked = table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit("#"), F.col("doc_id") % 4).alias("chunk_id"))
    return asked.join(_chunks(s, d), "chunk_id", "left_semi")


@query("SELECT source AS collection, count(*) AS n FROM documents GROUP BY 1")
def src23_collections(s: SparkSession, d: str) -> DataFrame:
    return incremental.collections(table(s, d, "documents").withColumnRenamed("source", "collection"))


@query(f"WITH {CHUNKS} SELECT concat(doc_id, '#', ordinal) AS chunk_id, CASE WHEN CAST(substr(doc_id, 2) AS BIGINT) % 5 = 1 THEN 'new' ELSE 'old' END AS version FROM ck WHERE CAST(substr(doc_id, 2) AS BIGINT) % 5 <> 2 AND NOT (CAST(substr(doc_id, 2) AS BIGINT) % 5 = 1 AND ordinal > 0)")
def snk08_manifest_delta(s: SparkSession, d: str) -> DataFrame:
    own = _chunks(s, d).withColumn("n", F.substring("doc_id", 2, 20).cast("long"))
    updated, removed = own.where("n % 5 = 1"), own.where("n % 5 = 2").select("doc_id")
    fresh = updated.where("ordinal = 0").withColumn("version", F.lit("new"))
    return incremental.delta(own.withColumn("version", F.lit("old")), fresh, updated.select("doc_id"), removed, "doc_id").select("chunk_id", "version")


@query(f"WITH {CHUNKS} SELECT concat(doc_id, '#', ordinal) AS chunk_id FROM ck WHERE CAST(substr(doc_id, 2) AS BIGINT) % 3 <> 0")
def snk02_deleted_ids(s: SparkSession, d: str) -> DataFrame:
    """Chunks written as a table, then a third deleted from it by id."""
    own, at = _chunks(s, d).select("chunk_id", "doc_id"), _folder(s, "deletes")
    store.replaced(own, at)
    return store.without(own.where("CAST(substr(doc_id, 2) AS BIGINT) % 3 = 0"), at, own, ["chunk_id"]).select("chunk_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'full' WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'full' WHEN doc_id % 4 = 2 AND doc_id % 7 >= 5 THEN 'full' ELSE 'incremental' END AS mode FROM documents")
def idx04_build_mode(s: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_id")
    return table(s, d, "documents").select("doc_id", incremental.build_mode(c % 4 == 0, ~((c % 4 == 1) & (c % 3 == 0)), F.when(c % 4 == 2, c % 7).otherwise(0), F.when(c % 4 == 2, 5).otherwise(0)).alias("mode"))


FULL_STATE = "fs AS (SELECT 'd' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0)"


@query(f"WITH {FULL_STATE} SELECT path, h AS content_hash FROM fs")
def idx02_incremental_state(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").withColumn("path", F.concat(F.lit("d"), "doc_id"))
    c = F.col
    old = docs.where("doc_id % 7 <> 0").select("path", c("n_chars").alias("mtime"), F.sha2(F.when(c("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(c("text")), 256).alias("content_hash"), F.lit("v2").alias("logic_version"))
    new = docs.where("doc_id % 11 <> 0").select("path", F.when(c("doc_id") % 5 == 0, c("n_chars") + 1).otherwise(c("n_chars")).alias("mtime"), F.sha2("text", 256).alias("content_hash"), F.lit("v2").alias("logic_version"))
    return incremental.brought_up(old, new).select("path", "content_hash")


@query("SELECT doc_id, lower(coalesce(json_extract_string(j, '$.chunker'), '')) AS chunker, CAST(json_extract_string(j, '$.start_line') AS INTEGER) AS start_line FROM (SELECT doc_id, json_object('chunker', CASE WHEN doc_id % 2 = 0 THEN 'markdown' ELSE 'syntactic' END, 'start_line', doc_id % 90) AS j FROM documents)")
def sub05_metadata_round_trip(s: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_id")
    rows = table(s, d, "documents").select("doc_id", F.when(c % 2 == 0, "markdown").otherwise("syntactic").alias("chunker"), (c % 90).cast("int").alias("start_line"), F.array(F.lit("a"), F.lit("b")).alias("heading_path"))
    stored = rows.select("doc_id", F.to_json(F.struct("chunker", "start_line", "heading_path")).alias("j"))
    return stored.select("doc_id", F.from_json("j", "chunker string, start_line int, heading_path array<string>").alias("m")).select("doc_id", "m.chunker", "m.start_line")


@query("SELECT DISTINCT concat('d', doc_id) AS path FROM documents WHERE lang = 'en'")
def sub26_indexed_paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("lang = 'en'").select(F.concat(F.lit("d"), "doc_id").alias("path")).distinct()


def _tokenizer() -> chunking.Tokenizer:
    import public_tokenizers

    return chunking.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def chk05_exact_windows(s: SparkSession, d: str) -> DataFrame:
    """Every document in windows of at most 256 tokens of a tokenizer, 32 of them shared with the window before; tests hold it against the library."""
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.cap(rows, 256, 32, _tokenizer())


@query()
def chk06_exact_counts(s: SparkSession, d: str) -> DataFrame:
    """How many tokens of a tokenizer every document has."""
    return table(s, d, "documents").select("doc_id", chunking.token_counts(F.col("text"), _tokenizer()).alias("n_tokens"))


SUFFIXES = "list_extract(['.py', '.MD', '.tsx', '.txt', '.hh', '.sql'], CAST(page_id % 6 + 1 AS INTEGER))"
FOLDERS = "list_extract(['src', 'node_modules', '.git', 'out', 'a.pem', 'lib'], CAST(page_id % 5 + 1 AS INTEGER))"


@query(f"SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' WHEN 2 THEN 'typescript' WHEN 4 THEN 'cpp' WHEN 5 THEN 'sql' END AS language, page_id % 5 <> 0 AS excluded FROM pages")
def src04_languages_and_exclusions(s: SparkSession, d: str) -> DataFrame:
    c = F.col("page_id")
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".MD", ".tsx", ".txt", ".hh", ".sql"))), (c % 6 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("src", "node_modules", ".git", "out", "a.pem"))), (c % 5 + 1).cast("int"))
    path = F.concat(folder, F.lit("/f"), c.cast("string"), suffix)
    return table(s, d, "pages").select("page_id", T.language(path).alias("language"), T.excluded(path).alias("excluded"))


# ---- tables that are written -------------------------------------------------------------------


def _folder(s: SparkSession, name: str) -> str:
    return f"{lexical.shared(s)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, lang AS collection FROM documents WHERE lang <> 'en' OR doc_id % 3 = 0")
def snk03_collection_reset(s: SparkSession, d: str) -> DataFrame:
    """All documents written by language, then English reset to a third of them."""
    rows, at = table(s, d, "documents").select("doc_id", F.col("lang").alias("collection")), _folder(s, "collections")
    store.collection_reset(rows, at)
    store.collection_reset(rows.where("collection = 'en' and doc_id % 3 = 0"), at)
    return store.kept(s, at, rows)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 <> 0")
def snk01_written_upsert(s: SparkSession, d: str) -> DataFrame:
    rows, at = table(s, d, "documents").select("doc_id"), _folder(s, "upserts")
    store.upserted(rows.where("doc_id % 5 <> 0").withColumn("version", F.lit("old")), at, ["doc_id"])
    return store.upserted(rows.where("doc_id % 4 = 0").withColumn("version", F.lit("new")), at, ["doc_id"])


@query("SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'first' ELSE 'second' END AS version FROM documents WHERE doc_id % 4 = 0 OR doc_id % 5 <> 0")
def snk13_first_write_wins(s: SparkSession, d: str) -> DataFrame:
    rows, at = table(s, d, "documents").select("doc_id"), _folder(s, "inserts")
    store.inserted_or_ignored(rows.where("doc_id % 5 <> 0").withColumn("version", F.lit("first")), at, ["doc_id"])
    return store.inserted_or_ignored(rows.where("doc_id % 4 = 0").withColumn("version", F.lit("second")), at, ["doc_id"])


@query("SELECT 'node' AS what, 'nation' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'edge', 'contains', count(*) FROM supplier")
def snk06_graph_artifact(s: SparkSession, d: str) -> DataFrame:
    """Nodes and edges replaced as tables, and counted by kind and type as they were kept."""
    nodes = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("kind"))
    edges = table(s, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("source"), F.concat(F.lit("s"), "s_suppkey").alias("target"), F.lit("contains").alias("kind"))
    at = _folder(s, "graph")
    count = lambda what, df: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count("node", store.replaced(nodes, f"{at}/nodes")).unionByName(count("edge", store.replaced(edges, f"{at}/edges")))


@query("""WITH x AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents WHERE doc_id % 5 <> 0), y AS (SELECT doc_id, unhex(hex(encode(concat('blob ', octet_length(b)))) || '00' || hex(b)) AS whole FROM x)
SELECT doc_id, sha1(whole) AS content_id FROM y UNION ALL SELECT doc_id, '-' FROM documents WHERE doc_id % 5 = 0""")
def src32_content_ids(s: SparkSession, d: str) -> DataFrame:
    """The identities of the documents' bytes; one in five has no file."""
    content = F.when(F.col("doc_id") % 5 != 0, F.coalesce("text", F.lit("")).cast("binary"))
    return table(s, d, "documents").select("doc_id", files.content_id(content).alias("content_id"))


# ---- an index that is kept ---------------------------------------------------------------------

SECTION_TERMS = f"""{SECTIONS},
tok AS (SELECT concat('d', id, '.md#', ordinal) AS id, CASE WHEN len(t) = 0 THEN [''] ELSE t END AS t FROM (SELECT id, ordinal, {TOKENS.format("text")} AS t FROM fin)),
post AS{POSTINGS.split("post AS", 1)[1]}"""


def _files(s: SparkSession, d: str) -> DataFrame:
    """The documents as Markdown files, each fifth line a heading."""
    return _marked(s, d).select(F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("path"), "text", F.lit("doc").alias("doc_type"), F.lit("markdown").alias("language"), F.col("n_chars").alias("mtime"), "doc_id")


def _before(s: SparkSession, d: str) -> DataFrame:
    """The files as they were: some of other texts, some that aren't there, some that are gone by now."""
    old = _files(s, d)
    other = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("# former\nzebra "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    gone = old.where("doc_id % 25 = 0").withColumn("path", F.concat(F.lit("gone/"), "path"))
    return old.where("doc_id % 20 <> 7").withColumn("text", other).withColumn("mtime", F.when(F.col("doc_id") % 10 == 3, F.col("mtime") - 1).otherwise(F.col("mtime"))).unionByName(gone)


@query(f"WITH {SECTION_TERMS} SELECT term, df, round(idf, 9) AS idf FROM idf")
def idx01_built_index(s: SparkSession, d: str) -> DataFrame:
    """Statistics of the terms of an index over chunks, built in one call from all files."""
    kept = kept_index.build(_files(s, d), _folder(s, "index"), most_tokens=2**20, vectors=False)
    return kept.lexical().terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {SECTION_TERMS} SELECT term, df, round(idf, 9) AS idf FROM idf")
def idx02_brought_up_index(s: SparkSession, d: str) -> DataFrame:
    """The same statistics of an index that was built over the files as they were and then brought up."""
    at = _folder(s, "index")
    kept_index.build(_before(s, d), at, most_tokens=2**20, vectors=False)
    kept, _ = kept_index.bring_up(_files(s, d), at)
    return kept.lexical().terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query("SELECT count_if(doc_id % 20 = 7) AS new, count_if(doc_id % 10 = 3) AS modified, count_if(doc_id % 25 = 0 AND doc_id % 20 <> 7) AS deleted, count_if(doc_id % 20 <> 7 AND doc_id % 10 <> 3) AS unchanged FROM documents")
def idx08_counts_of_a_run(s: SparkSession, d: str) -> DataFrame:
    """What a run over a kept index found new, modified, deleted and unchanged."""
    at = _folder(s, "index")
    small = lambda df: df.withColumn("text", F.substring(F.coalesce("text", F.lit("")), 1, 40))
    kept_index.build(small(_before(s, d)), at, vectors=False)
    found = kept_index.bring_up(small(_files(s, d)), at)[1]
    return s.createDataFrame([tuple(found[k] for k in ("new", "modified", "deleted", "unchanged"))], "new long, modified long, deleted long, unchanged long")


@query(f"""WITH {SECTION_TERMS}, qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM post JOIN qt USING (term) JOIN idf USING (term), size GROUP BY query_id, id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc) WHERE rank <= 5""")
def src16_search_of_a_kept_index(s: SparkSession, d: str) -> DataFrame:
    """BM25 over an index that was built over older files, brought up, compacted, and opened again from its folder."""
    at = _folder(s, "index")
    kept_index.build(_before(s, d), at, most_tokens=2**20, vectors=False)
    kept_index.bring_up(_files(s, d), at)
    kept_index.compact(s, at)
    items = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return kept_index.search(kept_index.opened(s, at), items, 5)


@query("SELECT concat('d', doc_id, '.md') AS path, sha256(coalesce(text, '')) AS content_hash, n_chars AS mtime FROM (SELECT id AS doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM mk GROUP BY 1) JOIN documents_chars USING (doc_id)".replace("SELECT concat", f"WITH {MARKED}, documents_chars AS (SELECT doc_id, n_chars FROM documents) SELECT concat", 1))
def src12_manifest_of_an_index(s: SparkSession, d: str) -> DataFrame:
    """The manifest that a kept index has after it was brought up."""
    at = _folder(s, "index")
    kept_index.build(_before(s, d), at, vectors=False)
    return kept_index.bring_up(_files(s, d), at)[0].files.select("path", "content_hash", "mtime")
