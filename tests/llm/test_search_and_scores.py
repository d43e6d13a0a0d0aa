"""M-tree search and Pitman-Yor scores against brute force, and the pipeline against its stages."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from lodequery.llm import jaccard_join, metric_search, pitman_yor, quality_model, quality_rules

SF = "/root/testdata/sf0.001"
IS_QUERY = lambda: F.col("vec_id") % 20 == 0


def brute(rows, k=20):
    """rows: (id, integers), ids may repeat; (query_id, rank, vec_id, score) of all pairs of rows of two ids."""
    out = []
    for q in sorted({i for i, _ in rows if i % 20 == 0}):
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), i) for j, x in rows if j == q for i, y in rows if i != q and len(x) == len(y))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"page": 16, "query_block": 2}])
def test_search_against_all_pairs(spark, options):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(5, 8))
    rows = [(int(i), (centers[i % 5] + rng.normal(scale=0.2, size=8)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)]  # equal vectors
    rows += [(2000 + i, [1.0, -1.0]) for i in range(3)] + [(2020, [0.25, 0.75])]  # another length
    rows += rows[:5] + [(25, [2.0] * 8), (40, [-1.0] * 8)]  # repeated ids, with equal vectors and others
    good = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    bad = [(3000, None), (3020, [float("nan")] * 8), (3040, [float("inf")] + [0.0] * 7), (3060, [None] * 8), (3080, []), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, 1.0) for i, v in rows + bad], "vec_id long, embedding array<double>, score double")
    assert found(metric_search.top_k(table, IS_QUERY(), **options)) == brute(good)


def test_search_of_the_embeddings_and_of_no_rows(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    good = [(r["vec_id"], np.floor(64 * np.array(r["embedding"], float)).astype(int)) for r in table.collect()]
    assert found(metric_search.top_k(table, IS_QUERY())) == brute(good)
    assert metric_search.top_k(table.where("false"), IS_QUERY()).count() == 0


def test_the_bounds_of_the_tree_spare_distances():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-3, 4, (400, 6)) + c for c in (-200, 0, 200)]).astype(np.int64)
    tree = metric_search.MTree(np.arange(len(x)), x, leaf=32)
    scores, ids = tree.search(x[5], 5, 10, -math.inf)
    want = sorted((-(int(x[5] @ y)), i) for i, y in enumerate(x) if i != 5)[:10]
    assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want


# ---- language model ----------------------------------------------------------------------------


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ") if w]


def plain_base(rows):
    """(doc_id, n_tokens, n_known, train_tokens, base score) of each row."""
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10
    tokens = [(i, [*words_of(t or ""), None]) for i, t in rows]
    counts = Counter(w for i, own in tokens if fold(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    score = lambda w: math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1)))
    return sorted((i if i is not None else -1, len(own), sum(counts[w] > 0 for w in own), n, round(sum(map(score, own)), 6)) for i, own in tokens)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20_000}])
def test_base_scores_and_perplexity(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "The the"), (5001, None), (5002, ""), (5002, ""), (5003, "zzz unseen " * 50)], "doc_id long, text string")
    docs = docs.union(odd).withColumn("shard", F.lit("x"))
    rows = pitman_yor.score(docs.repartition(3), **options).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    want = plain_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=1e-4)
    held = [r for r in rows if r["held_out"]]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # lower perplexity than the base


def test_held_out_rows_teach_nothing_and_equal_rows_score_alike(spark):
    """Words of held-out rows stay unknown, and a frequent pair scores above one never seen."""
    train = [(i, t) for i, t in enumerate(["a b", "a c", "a b a b", "b c a", "c"] * 12) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(100, 900) if zlib.crc32(str(i).encode()) % 10 == 0]
    asked = list(zip(held, ["a b", "b b", "new", "new", "new new new"], strict=False))
    docs = spark.createDataFrame(train + asked, "doc_id long, text string").coalesce(1)
    rows = {r["doc_id"]: r for r in pitman_yor.score(docs).collect()}
    score = [rows[i]["score"] for i in held[:5]]
    assert score[0] > max(score[1:]) and score[2] == score[3]
    assert 10 ** score[0] == pytest.approx(0.6 * 0.6 * 0.5, rel=0.15)  # shares of begin-a, a-b and b-end in training
    assert [rows[i]["n_known"] for i in held[:5]] == [3, 3, 1, 1, 1]


def test_tables_are_drawn_from_their_conditional():
    """Numbers of tables of c customers follow the generalised Stirling weights."""
    c, others, base, d, s = 6, 3.0, 0.3, 0.5, 1.0
    table = pitman_yor.stirling(d)
    weight = np.array([math.exp(table[c, t] + t * math.log(base) + sum(math.log(s + d * (others + j)) for j in range(t))) for t in range(1, c + 1)])
    n = 40_000
    drawn = pitman_yor.draw_tables(np.full(n, c), np.full(n, others), np.full(n, base), d, s, np.random.default_rng(0))
    assert np.bincount(drawn, minlength=c + 1)[1:] / n == pytest.approx(weight / weight.sum(), abs=0.01)


def test_stirling_numbers_by_recursion():
    plain = {(0, 0): 1.0}
    for c in range(8):
        for t in range(9):
            plain[c + 1, t] = (c - 0.4 * t) * plain.get((c, t), 0.0) + plain.get((c, t - 1), 0.0)
    table = pitman_yor.stirling(0.4)
    assert [math.exp(table[8, t]) for t in range(1, 9)] == pytest.approx([plain[8, t] for t in range(1, 9)])


def test_scores_of_no_rows_and_without_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert pitman_yor.score(docs.where("false")).count() == 0
    rows = pitman_yor.score(docs).collect()
    assert len(rows) == docs.count() and {r["train_tokens"] for r in rows} == {0}


# ---- the pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    want = [
        lambda d: ids(quality_model.score(d, labels).where("predicted = 1")), lambda d: ids(quality_rules.judge(d).where("kept")),
        lambda d: sorted({r["class_id"] for r in jaccard_join.join(d).collect()}), ids,
    ]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        expected = want[i](docs)
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert ids(docs) == expected and docs.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct()
    assert ids(packed) == ids(docs)


def test_registry():
    names = set(entry.queries())
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) == 10


def test_search_agrees_with_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    twin = con.sql(entry.oracle_sql()["op7_metric_search"])
    cols = ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r[twin.columns.index(c)] for c in cols) for r in twin.fetchall()) == found(entry.queries()["op7_metric_search"](spark, SF))
