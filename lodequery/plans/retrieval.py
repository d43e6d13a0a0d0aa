"""Queries over retrieval and evaluation operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.functions import text as T
from lodequery.operators import evaluate, lexical, retrieve
from lodequery.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


TOK = """list_transform(regexp_extract_all(lower({0}), '[a-z0-9_]+'), lambda w: CASE WHEN contains(w, '_') THEN list_concat([w], list_filter(string_split(w, '_'), lambda p: p <> '')) ELSE [w] END)"""
TOKENS = f"flatten({TOK})"
POSTINGS = f"""
tok AS (SELECT doc_id AS id, CASE WHEN len(t) = 0 THEN [''] ELSE t END AS t FROM (SELECT doc_id, {TOKENS.format("coalesce(text, '')")} AS t FROM documents)),
post AS (SELECT id, any_value(l) AS len, term, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM tok) GROUP BY id, term),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, size GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)
"""
BM25 = (
    POSTINGS
    + f""",
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score
  FROM post JOIN qt USING (term) JOIN idf USING (term), size GROUP BY query_id, id),
lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc)
"""
)
DENSE = """
vec AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
qv AS (SELECT id AS query_id, v FROM vec WHERE id IN (SELECT item_id FROM benchmark)),
ds AS (SELECT query_id, vec.id, round(CASE WHEN list_dot_product(qv.v, qv.v) * list_dot_product(vec.v, vec.v) = 0 THEN 0
  ELSE list_dot_product(qv.v, vec.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(vec.v, vec.v))) END, 9) AS score FROM qv, vec),
den AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM ds)
"""
FUSED = """
legs AS (SELECT query_id, id, rank FROM den WHERE rank <= 30 UNION ALL SELECT query_id, id, rank FROM lex WHERE rank <= 30),
fu AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM legs GROUP BY query_id, id),
fus AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM fu)
"""
NEAR_BY_RANK = """
near AS (SELECT a.query_id, b.rank, list(a.rank) AS before FROM cand a JOIN cand b ON a.query_id = b.query_id AND a.rank < b.rank
  WHERE CASE WHEN least(len(a.s), len(b.s)) = 0 THEN len(a.s) = len(b.s) ELSE len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)) >= 0.8 END GROUP BY 1, 2),
fold AS (SELECT query_id, 0 AS rank, CAST([] AS INTEGER[]) AS kept FROM (SELECT DISTINCT query_id FROM cand)
  UNION ALL SELECT f.query_id, c.rank, CASE WHEN list_has_any(f.kept, coalesce(n.before, CAST([] AS INTEGER[]))) THEN f.kept ELSE list_append(f.kept, c.rank) END
  FROM fold f JOIN cand c ON c.query_id = f.query_id AND c.rank = f.rank + 1 LEFT JOIN near n ON n.query_id = c.query_id AND n.rank = c.rank),
last AS (SELECT query_id, arg_max(kept, rank) AS kept FROM fold GROUP BY 1),
dedup AS (SELECT c.query_id, c.id, c.score, CAST(list_position(l.kept, c.rank) AS INTEGER) AS rank FROM cand c JOIN last l ON l.query_id = c.query_id AND list_contains(l.kept, c.rank))
"""
COLLAPSED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' ')"
SHINGLES = """CASE WHEN w[1] = '' THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END"""
WORDS = f"string_split({COLLAPSED}, ' ')"


def _docs(s, d):
    return table(s, d, "documents")


def _items(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _lexical(s, d, k=30):
    return lexical.bm25(_docs(s, d), _items(s, d), k)


def _dense(s, d, k=30):
    vectors = table(s, d, "embeddings")
    q = vectors.join(table(s, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return retrieve.dense(vectors, q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k)


def _entries(s, d):
    return _docs(s, d).select(F.col("doc_id").alias("id"), "text")


def _truth(s, d):
    return evaluate.holding(_docs(s, d).select(F.col("doc_id").alias("id"), "text"), table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


TRUTH = "tru AS (SELECT b.item_id AS query_id, d.doc_id AS id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


@query(f"SELECT doc_id, len(t) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def ret03_tokens(s: SparkSession, d: str) -> DataFrame:
    t = _docs(s, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query(f"WITH {POSTINGS} SELECT term, df, round(idf, 9) AS idf FROM idf")
def agg22_bm25_statistics(s: SparkSession, d: str) -> DataFrame:
    return lexical.indexed(_docs(s, d)).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {BM25} SELECT query_id, id, score, rank FROM lex WHERE rank <= 10")
def ret02_bm25_top_k(s: SparkSession, d: str) -> DataFrame:
    return _lexical(s, d, 10)


@query(f"WITH {BM25.replace('FROM post JOIN', 'FROM (SELECT * FROM post WHERE id IN (SELECT doc_id FROM documents WHERE lang = $$en$$)) post JOIN')} SELECT query_id, id, score, rank FROM lex WHERE rank <= 5")
def ret12_search_by_type(s: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(_docs(s, d), _items(s, d), 5, keep=F.col("lang") == "en")


@query(f"WITH {DENSE} SELECT query_id, id, score, rank FROM den WHERE rank <= 10")
def ret01_dense_top_k(s: SparkSession, d: str) -> DataFrame:
    return _dense(s, d, 10)


@query(f"WITH {DENSE.replace('id IN (SELECT item_id FROM benchmark)', 'id % 20 = 0')} SELECT query_id, id, score, rank FROM den WHERE rank <= 10")
def ret01b_dense_every_twentieth(s: SparkSession, d: str) -> DataFrame:
    vectors = table(s, d, "embeddings")
    q = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieve.dense(vectors, q, 10)


@query(f"WITH {BM25}, {DENSE}, {FUSED} SELECT query_id, id, score, rank FROM fus WHERE rank <= 15")
def ret04_rank_fusion(s: SparkSession, d: str) -> DataFrame:
    return retrieve.fused([_dense(s, d), _lexical(s, d)], 15)


@query(f"WITH {BM25}, {DENSE}, {FUSED} SELECT query_id, id, score, rank, text FROM fus JOIN documents ON doc_id = id WHERE rank <= 15")
def ret06_materialise(s: SparkSession, d: str) -> DataFrame:
    dense_rows = _dense(s, d).join(_entries(s, d), "id")
    return retrieve.materialised(retrieve.fused([_dense(s, d), _lexical(s, d)], 15), dense_rows, _entries(s, d)).select("query_id", "id", "score", "rank", "text")


HYBRID = f"""WITH RECURSIVE {BM25}, {DENSE}, {FUSED}, cand AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS rank, {SHINGLES} AS s FROM (SELECT query_id, id, score, rank, {WORDS.format('text')} AS w FROM fus JOIN documents ON doc_id = id WHERE rank <= 15)), {NEAR_BY_RANK}"""


@query(HYBRID + " SELECT query_id, id, score, rank FROM dedup WHERE rank <= 5")
def ret08_hybrid_deduplicated(s: SparkSession, d: str) -> DataFrame:
    return retrieve.hybrid(_lexical(s, d), _dense(s, d), _entries(s, d), 5).select("query_id", "id", "score", "rank")


@query(f"WITH {BM25}, {DENSE}, {FUSED} SELECT query_id, id, score, rank FROM fus JOIN documents ON doc_id = id WHERE rank <= 5")
def ret05_hybrid(s: SparkSession, d: str) -> DataFrame:
    return retrieve.hybrid(_lexical(s, d), _dense(s, d), _entries(s, d), 5, dedup=False).select("query_id", "id", "score", "rank")


@query(f"WITH {DENSE} SELECT query_id, count(*) AS candidates, count_if(score >= 0.5) AS kept, max(score) AS best, count_if(score >= 0.5) = 0 AS abstained FROM den WHERE rank <= 30 AND rank > 1 GROUP BY query_id")
def ret07_threshold_abstention(s: SparkSession, d: str) -> DataFrame:
    return retrieve.abstentions(_dense(s, d).where("rank > 1"), 0.5)


@query(f"SELECT doc_id, len(s) AS n_shingles, sha256(array_to_string(list_sort(s), '|')) AS shingles_sha256 FROM (SELECT doc_id, {SHINGLES} AS s FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents))")
def ret09_shingles(s: SparkSession, d: str) -> DataFrame:
    t = _docs(s, d).select("doc_id", T.shingles(F.col("text")).alias("s"))
    return t.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.sha2(F.array_join(F.array_sort("s"), "|"), 256).alias("shingles_sha256"))


@query(f"""WITH {BM25}, top AS (SELECT query_id, id, rank, {SHINGLES} AS s FROM (SELECT query_id, id, rank, {WORDS.format('text')} AS w FROM lex JOIN documents ON doc_id = id WHERE rank <= 2))
SELECT a.query_id, a.id AS first_id, b.id AS second_id, round(len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)), 9) AS containment FROM top a JOIN top b ON a.query_id = b.query_id AND a.rank = 1 AND b.rank = 2""")
def ret10_containment(s: SparkSession, d: str) -> DataFrame:
    top = _lexical(s, d, 2).join(_entries(s, d), "id").select("query_id", "rank", F.struct("id", T.shingles(F.col("text")).alias("s")).alias("x"))
    of = lambda rank: F.first(F.when(F.col("rank") == rank, F.col("x")), ignorenulls=True)
    rows = top.groupBy("query_id").agg(of(1).alias("a"), of(2).alias("b")).where("a is not null and b is not null")
    return rows.select("query_id", F.col("a.id").alias("first_id"), F.col("b.id").alias("second_id"), F.round(T.containment(F.col("a.s"), F.col("b.s")), 9).alias("containment"))


@query(f"WITH {BM25}, fl AS (SELECT query_id, sc.id, score, CASE WHEN lang = 'en' THEN 'code' ELSE 'docs' END AS flow FROM sc JOIN documents ON doc_id = id) SELECT * FROM (SELECT query_id, id, score, flow, CAST(row_number() OVER (PARTITION BY query_id, flow ORDER BY score DESC, id) AS INTEGER) AS rank FROM fl) WHERE rank <= 3")
def ret13_two_flows(s: SparkSession, d: str) -> DataFrame:
    own = _docs(s, d).select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "code").otherwise("docs").alias("flow"))
    rows = lexical.best(lexical.indexed(_docs(s, d)), _items(s, d), 3, own.distinct()).join(own, ["id", "flow"])
    return retrieve.per_flow(rows, F.col("flow"), 3).select("query_id", "id", "score", "flow", "rank")


FAN = DENSE.replace("FROM qv, vec)", "FROM qv, vec), p AS (SELECT ds.*, label % 3 AS part FROM ds JOIN embeddings ON vec_id = id), pr AS (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, id) AS pk FROM p)")


@query(f"WITH {FAN}, g AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM pr WHERE pk <= 5) SELECT * FROM g WHERE rank <= 5 AND score >= 0.2")
def ret14_fan_out(s: SparkSession, d: str) -> DataFrame:
    vectors = table(s, d, "embeddings")
    q = vectors.join(table(s, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    parts = [retrieve.dense(vectors.where(F.col("label") % 3 == i), q, 5) for i in range(3)]
    return retrieve.fan_out(parts, 5, 0.2).drop("abstained").select("query_id", "id", "score", "rank")


@query(f"WITH {BM25}, {DENSE}, u AS (SELECT query_id, id, rank, 0 AS flow FROM den WHERE rank <= 4 UNION ALL SELECT query_id, id, rank, 1 FROM lex WHERE rank <= 6) SELECT query_id, id, rank, flow, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, flow) AS INTEGER) AS place FROM u")
def ret16_interleave(s: SparkSession, d: str) -> DataFrame:
    cols = ["query_id", "id", "rank"]
    return retrieve.interleaved(_dense(s, d, 4).select(*cols), _lexical(s, d, 6).select(*cols))


@query(f"WITH {BM25}, {TRUTH}, f AS (SELECT t.query_id, min(rank) AS first FROM (SELECT DISTINCT query_id FROM tru) t LEFT JOIN (SELECT * FROM lex WHERE rank <= 10 AND (query_id, id) IN (SELECT query_id, id FROM tru)) l USING (query_id) GROUP BY 1) SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 9) AS hit_{k}" for k in (1, 3, 5, 10)) + ", round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0.0 END), 9) AS mrr FROM f")
def agg08_hit_rate_and_mrr(s: SparkSession, d: str) -> DataFrame:
    return evaluate.report(_lexical(s, d, 10), _truth(s, d))


@query(f"WITH {BM25}, {DENSE}, {TRUTH} SELECT count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS union_hit_rate FROM (SELECT query_id, bool_or((query_id, id) IN (SELECT query_id, id FROM (SELECT query_id, id FROM lex WHERE rank <= 5 UNION SELECT query_id, id FROM den WHERE rank <= 5))) AS hit FROM tru GROUP BY query_id)")
def agg09_union_hit_rate(s: SparkSession, d: str) -> DataFrame:
    return evaluate.union_hit_rate([_lexical(s, d, 5), _dense(s, d, 5)], _truth(s, d), 5)


SETS = """g AS (SELECT DISTINCT source AS case_id, doc_id AS ref FROM documents WHERE n_chars > 1500), e AS (SELECT DISTINCT source AS case_id, doc_id AS ref FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
c AS (SELECT case_id, count(g.ref) AS got, count(e.ref) AS expected, count(CASE WHEN g.ref IS NOT NULL AND e.ref IS NOT NULL THEN 1 END) AS shared FROM g FULL JOIN e USING (case_id, ref) GROUP BY case_id),
pr AS (SELECT case_id, got, expected, shared, round(CASE WHEN got = 0 THEN 1.0 ELSE shared / got END, 9) AS precision, round(CASE WHEN expected = 0 THEN 1.0 ELSE shared / expected END, 9) AS recall FROM c),
m AS (SELECT *, round(coalesce(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 0.0), 9) AS f1 FROM pr)"""


def _metrics(s, d):
    docs = _docs(s, d)
    got = docs.where("n_chars > 1500").select(F.col("source").alias("case_id"), F.col("doc_id").alias("ref"))
    expected = docs.join(table(s, d, "labels").where("quality = 1"), "doc_id").select(F.col("source").alias("case_id"), F.col("doc_id").alias("ref"))
    return evaluate.set_metrics(got, expected, docs.select(F.col("source").alias("case_id")))


@query(f"WITH {SETS} SELECT * FROM m")
def agg10_set_metrics(s: SparkSession, d: str) -> DataFrame:
    return _metrics(s, d)


@query(f"WITH {SETS}, r AS (SELECT m.*, CASE WHEN length(case_id) = 4 THEN 'short' ELSE 'long' END AS relation FROM m) SELECT relation, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, count(*) AS n FROM r GROUP BY GROUPING SETS ((relation), ())")
def agg11_suite_means(s: SparkSession, d: str) -> DataFrame:
    m = _metrics(s, d)
    return evaluate.suite_means(m, m.select("case_id", F.when(F.length("case_id") == 4, "short").otherwise("long").alias("relation")))


@query("WITH c AS (SELECT source AS name, CAST(avg(n_chars) AS DOUBLE) AS value FROM documents GROUP BY 1), b AS (SELECT source AS name, CAST(median(n_chars) AS DOUBLE) AS baseline FROM documents WHERE source <> 'src3' GROUP BY 1) SELECT name, round(value, 6) AS value, baseline, round(round(value, 6) - baseline, 9) AS delta, CASE WHEN baseline IS NULL THEN 'no-baseline' WHEN round(round(value, 6) - baseline, 9) < -100 THEN 'regressed' ELSE 'ok' END AS status FROM c LEFT JOIN b USING (name)")
def agg21_regression(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    current = docs.groupBy(F.col("source").alias("name")).agg(F.round(F.avg("n_chars"), 6).alias("value"))
    baseline = docs.where("source <> 'src3'").groupBy(F.col("source").alias("name")).agg(F.median("n_chars").alias("value"))
    return evaluate.regression(current, baseline, 100)


@query("SELECT DISTINCT doc_id AS path FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def jon19_missing_paths(s: SparkSession, d: str) -> DataFrame:
    return evaluate.missing(table(s, d, "labels").select(F.col("doc_id").alias("path")), _docs(s, d).where("lang = 'en'").select(F.col("doc_id").alias("path")))


@query(f"""WITH {DENSE}, t AS (SELECT query_id, id, rank, score, text FROM den JOIN documents ON doc_id = id WHERE rank <= 5)
SELECT query_id, id, rank, round(score, 6) AS score, CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END AS preview, CASE WHEN length(w) > 300 THEN left(w, 300) || '…' ELSE w END AS line, round(score, 4) AS short_score
FROM (SELECT *, {COLLAPSED.format('text')} AS w FROM t)""")
def snk23_result_previews(s: SparkSession, d: str) -> DataFrame:
    rows = _dense(s, d, 5).join(_entries(s, d), "id")
    return rows.select("query_id", "id", "rank", F.round("score", 6).alias("score"), T.preview(F.col("text")).alias("preview"), T.preview(T.collapsed(F.col("text")), 300).alias("line"), F.round("score", 4).alias("short_score"))
