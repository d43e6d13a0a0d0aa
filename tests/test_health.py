"""Health of many collections, and strict, hybrid and page searches of kept indexes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodequery.operators import health, index, lexical, retrieve

MANIFEST, STATS = "collection string, version string, path string, mtime long, content_hash string", "collection string, path string, mtime long, content_hash string"


def test_freshness_of_manifests(spark):
    collections = spark.createDataFrame([(c,) for c in ("touched", "changed", "gone", "old", "none", "more", "more")], "collection string")
    rows = [("touched", "1", "p", 1, "h"), ("changed", "1", "p", 1, "h"), ("changed", "1", "q", 5, None), ("gone", "1", "p", 1, "h"), ("old", "0", "p", 1, "h"), ("more", "1", "p", 1, "h"), ("other", "1", "p", 1, "h")]
    now = [("touched", "p", 2, "h"), ("changed", "p", 2, "i"), ("changed", "q", 6, None), ("old", "p", 1, "h"), ("more", "p", 1, "i"), ("more", "new", 1, "h")]
    fresh = health.freshness(collections, spark.createDataFrame(rows, MANIFEST), spark.createDataFrame(now, STATS))
    got = {r["collection"]: (r["absent"], r["stale"], r["last"]) for r in fresh.collect()}
    assert got == {"touched": (False, False, 1), "changed": (False, True, 5), "gone": (False, True, 1), "old": (True, False, None), "none": (True, False, None), "more": (False, False, 1)}
    servers = spark.createDataFrame([("touched", True, ["run", "-C", "x"]), ("changed", True, ["run", "--project", "x"]), ("gone", False, ["-C"]), ("more", True, None)], "collection string, registered boolean, invocation array<string>")
    codes = {r["collection"]: r["code"] for r in health.server(fresh, servers).collect()}
    assert codes == {"touched": "mcp_invocation_moves_cwd", "changed": "mcp_stale_after_reindex", "gone": "mcp_not_registered", "old": "mcp_not_registered", "none": "mcp_not_registered"}


def test_reports_of_collections(spark):
    collections = spark.createDataFrame([("a",), ("b",), ("c",)], "collection string")
    required = spark.createDataFrame([(c, k) for c in "abz" for k in ("K", "L", "K")], "collection string, key string")
    settings = spark.createDataFrame([("a", "K", "x"), ("a", "L", "y"), ("b", "K", " "), ("b", "L", None)], "collection string, key string, value string")
    probes = spark.createDataFrame([("a", "unreachable"), ("b", "unreachable"), ("c", "skipped"), ("z", "unreachable")], "collection string, status string")
    problems = health.config(collections, required, settings), health.provider(collections, required, settings, probes)
    assert sorted((r["collection"], r["area"], r["code"], r["fields"]) for p in problems for r in p.collect()) == [
        ("a", "provider", "provider_unreachable", []), ("b", "config", "env_missing_key", ["K"]), ("b", "config", "env_missing_key", ["L"]), ("b", "provider", "provider_config_incomplete", ["K", "L"]),
    ]
    rows = {(r["collection"], r["area"]): (r["status"], r["overall"]) for r in health.report(collections, *problems).collect()}
    assert len(rows) == 12 and rows["a", "provider"] == ("warn", "warn") and rows["b", "mcp"] == ("pass", "fail") and rows["c", "config"] == ("pass", "pass")
    nothing = collections.where("false")
    assert health.report(nothing, health.config(nothing, required, settings)).count() == 0


def test_hybrid_search_of_a_kept_index(spark, tmp_path):
    at = f"file://{tmp_path}/pages"
    tree = spark.createDataFrame([("index.md", "all pages"), ("a/b.md", "# Rivers\nthe river runs to the sea"), ("c.md", "# Hills\na hill of green grass"), ("d.md", None), ("code.py", "river = 1")], "rel_path string, text string")
    assert index.build_pages(tree, at, enabled=False) is None
    with pytest.raises(index.Absent):
        index.existing(spark, at)
    index.build_pages(tree, at)
    kept = index.existing(spark, at)
    assert sorted(r["path"] for r in kept.files.collect()) == ["a/b.md", "c.md", "d.md", "index.md"]
    queries = spark.createDataFrame([(1, "river"), (2, "green hill"), (3, "")], "query_id int, query string")
    got = index.hybrid(kept, queries, 2)
    assert {r["query_id"]: r["id"].split("#")[0] for r in got.where("rank = 1 and query_id < 3").collect()} == {1: "a/b.md", 2: "c.md"}
    entries = kept.chunks.select(F.col("chunk_id").alias("id"), "text")
    docs = entries.withColumnRenamed("id", "doc_id")
    want = retrieve.hybrid(lexical.bm25(docs, queries, 30), index.nearest(kept, queries, 30), entries, 2)
    pick = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.collect())
    assert pick(got) == pick(want)
    assert index.hybrid(kept, queries, 2, doc_type="code").count() == 0
    index.build_pages(tree.where("false"), at, vectors=False)
    with pytest.raises(ValueError):
        index.hybrid(index.existing(spark, at), queries, 2)
