"""Moves of pages, logs of two writers, an agent's branches, semantic memory, and dense search with odd vectors."""

from __future__ import annotations

import posixpath
import random
import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import functions as F

from lodequery.functions import embed
from lodequery.operators import agent, edits, evaluate, graph, lexical, memory, recall, retrieve, wiki
from lodequery.sources import versions


def plain_move(pages, src, dest):
    """The tree after one move, page by page."""
    forms = lambda p: (p, p.removesuffix(".md"), p.rsplit("/", 1)[-1].removesuffix(".md"))
    new = dict(zip(forms(src), forms(dest), strict=True))
    out = {}
    for page, text in pages.items():
        if not page.startswith("log/"):
            bare = lambda m: m[1].strip().rstrip("\\").strip()
            text = re.sub(edits.WIKILINK, lambda m: f"[[{new[bare(m)]}{m[1].strip()[len(m[1].strip().rstrip(chr(92))) :]}{m[2]}]]" if bare(m) in new else m[0], text)

            def path(m, page=page):
                raw = m[1].strip()
                base, sep, part = raw.partition("#")
                here = posixpath.dirname(page)
                if "://" in raw or raw.startswith(("#", "/", "<", "mailto:")) or not base or posixpath.normpath(posixpath.join(here, base)) != src:
                    return m[0]
                return f"]({posixpath.relpath(dest, here or '.')}{sep}{part})"

            text = re.sub(edits.PATH_LINK, path, text)
        out[dest if page == src else page] = text
    return out


def test_a_page_moves_with_all_links_to_it(spark):
    pages = {
        "index.md": "[[tech/Old page]] [i](tech/Old page.md) [[Old page]]", "tech/Old page.md": "[[Old page#self]] [s](./Old page.md#x) [b](b.md)", "tech/b.md": "a[[ Old page |über]]b[[tech/Old page.md]][[Old page]] [x](../tech/Old page.md#part)é[y](Old page.md)",
        "log/2024-01-01.md": "[[Old page]]", "deep/er/c.md": "[z](../../tech/Old page.md) [w](https://x/tech/Old page.md) [v](/tech/Old page.md) [u](#Old page.md) [[Other]]", "d.md": "| [[Old page\\|in a table]] |", "notes.txt": "[[Old page]]",
    }
    tree = spark.createDataFrame(list(pages.items()), "rel_path string, text string")
    moves = spark.createDataFrame([("tech/Old page.md", "new/place/New page.md")], "src string, dest string")
    want = plain_move({p: t for p, t in pages.items() if p.endswith(".md")}, "tech/Old page.md", "new/place/New page.md") | {"notes.txt": pages["notes.txt"]}
    assert {r["rel_path"]: r["text"] for r in edits.moved(tree, moves).collect()} == want
    changed = {r["rel_path"]: r["n"] for r in edits.move_edits(tree, moves).groupBy("rel_path").agg(F.count("*").alias("n")).collect()}
    assert changed == {"index.md": 3, "tech/Old page.md": 2, "tech/b.md": 5, "deep/er/c.md": 1, "d.md": 1}
    back = edits.moved(spark.createDataFrame(list(want.items()), "rel_path string, text string"), moves.select(F.col("dest").alias("src"), F.col("src").alias("dest")))
    assert wiki.lint(back).where("finding = 'broken-link'").count() == wiki.lint(tree).where("finding = 'broken-link'").count()


def test_moves_that_cannot_be_made(spark):
    tree = spark.createDataFrame([("a.md", "[[b]]"), ("b.md", ""), ("c.md", None)], "rel_path string, text string")
    moves = spark.createDataFrame([("a.md", "b.md"), ("gone.md", "c.md"), ("no.md", "no2.md"), ("b.md", "../x.md"), ("b.md", "b.txt"), ("b.md", "z.md")], "src string, dest string")
    assert {(r["src"], r["dest"]): r["status"] for r in edits.checked(tree, moves).collect()} == {
        ("a.md", "b.md"): "collision", ("gone.md", "c.md"): "recovered", ("no.md", "no2.md"): "missing", ("b.md", "../x.md"): "invalid", ("b.md", "b.txt"): "invalid", ("b.md", "z.md"): "moved",
    }
    assert {r["rel_path"]: r["text"] for r in edits.moved(tree, moves).collect()} == {"a.md": "[[z]]", "z.md": "", "c.md": None}
    assert edits.moved(tree, moves.where("false")).count() == 3


def test_edits_at_any_places(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab[]|#é ") for _ in range(rng.randint(0, 60))) + rng.choice(["", "[[a]]", "[[b|c]][[b]]"]) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", edits.spans(F.col("text"), edits.WIKILINK).alias("s")).collect()
    for r in rows:
        assert [(x["begin"], x["end"], x["text"]) for x in r["s"]] == [(m.start(), m.end(), m[0]) for m in re.finditer(edits.WIKILINK, texts[r["i"]])]


def test_two_writers_of_a_log(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    current = spark.createDataFrame([("x.py", "1"), ("y.py", "2")], "path string, content_id string")
    entry = lambda *t: spark.createDataFrame([("2024-01-01", "record", x, f"about {x}") for x in t], "day string, op string, title string, body string")
    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(lambda t: edits.appended(entry(t), at, current), ["same", "same"])) == [0, 1]
    assert edits.appended(entry("same", "other"), at, current.union(spark.createDataFrame([("x.py", "3")], current.schema))) == 1
    rows = edits.entries(spark, at).orderBy("number").collect()
    assert [(r["heading"], [tuple(c) for c in r["covers"]]) for r in rows] == [("## [2024-01-01] record | same", [("x.py", "1"), ("y.py", "2")]), ("## [2024-01-01] record | other", [("x.py", "3")])]
    text = edits.partitions(edits.entries(spark, at)).first()["text"]
    assert text.startswith("## [2024-01-01] record | same\n\nabout same\n\n<!-- covers/1\nx.py@1\ny.py@2\n-->\n\n## ")
    read = wiki.coverage(spark.createDataFrame([(text,)], "text string"))
    assert wiki.pending(current, read).count() == 0


def test_branches_of_an_agents_context(spark):
    docs = spark.createDataFrame([(1, "run the build", "a.py", "code"), (2, "build notes", "n.md", "doc"), (3, "other", "b.py", "code")], "id long, text string, path string, doc_type string")
    nodes = spark.createDataFrame([("a.py", "module", "a.py", "a.py", None, None), ("a.py::build_all", "function", "build_all", "a.py", 3, "build_all"), ("b.py::call_it", "function", "call_it", "b.py", 1, "call_it")], "id string, kind string, name string, path string, line int, qualname string")
    edges = spark.createDataFrame([("b.py::call_it", "a.py::build_all", "calls")], "source string, target string, type string")
    asked = spark.createDataFrame([(1, "who uses build_all in the build"), (2, "notes"), (3, "")], "query_id long, query string")
    index = lexical.indexed(docs, "id")
    rows = agent.context(index, docs, asked, nodes, edges)
    got = {(r["query_id"], r["branch"], r["section"], str(r["id"]), r["detail"]) for r in rows.collect()}
    assert (1, "code", "passages", "1", "build_all") in got and (1, "graph", "build_all:callers", "b.py#call_it", "1") in got and (2, "docs", "passages", "2", "") in got
    points = graph.entry_points(asked, nodes.where("qualname is not null").select("name"))
    state = {(r["query_id"], r["branch"]): r["status"] for r in agent.status(asked, rows, points).collect()}
    assert state[1, "graph"] == "ok" and state[2, "graph"] == state[3, "graph"] == "not_attempted" and state[3, "docs"] == "empty" and state[2, "code"] == "empty"
    without = agent.context(index, docs, asked, None, None)
    assert without.where("branch = 'graph'").count() == 0 and without.where("branch <> 'graph'").count() == sum(x[1] != "graph" for x in got)
    assert {r["status"] for r in agent.status(asked, without, None).where("branch = 'graph'").collect()} == {"unavailable"}


def test_semantic_memory(spark, tmp_path):
    at = f"file://{tmp_path}/m"
    texts = [f"turn about {w} number {i}" for i, w in enumerate(["apples", "pears", "ships", "ship's apples", "rivers"] * 6)] + ["", "   "]
    messages = spark.createDataFrame([(i // 8, i % 8, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)], "session_key long, turn long, role string, text string")
    turns = memory.turn_rows(messages)
    sessions = spark.createDataFrame([(k, 86400.0 * k + 5) for k in range(4)] + [(9, 1.0)], "session_key long, captured_at double")
    assert recall.grown(turns.where("session_key = 0"), sessions, at) == 8
    assert recall.grown(turns, sessions, at) == 22 and recall.grown(turns, sessions, at) == 0
    assert versions.last(spark, at)[0] == 2 and recall.kept(spark, at).count() == 30
    assert recall.kept(spark, at, 86400.0, 2 * 86400.0).select("session_key").distinct().count() == 2
    asked = spark.createDataFrame([(1, "apples"), (2, "rivers and ships"), (3, "")], "query_id long, query string")
    got = {(r["query_id"], r["rank"]): (r["session_key"], r["turn_index"]) for r in recall.search(spark, at, asked, 4, 86400.0).collect()}
    unit = lambda t: (v := sum((embed.word_vector(w) for w in t.lower().split()), np.zeros(embed.DIM))) / (np.linalg.norm(v) or 1)
    rows = [(f"{k}#{i}", k, i, unit(t)) for k, i, t in ((r["session_key"], r["turn_index"], r["text"]) for r in turns.collect())]
    for q, text in ((1, "apples"), (2, "rivers and ships"), (3, "")):
        best = sorted((-round(float(unit(text) @ v), 9), own, k, i) for own, k, i, v in rows)[:4]
        assert {n + 1: (k, i) for n, (_, _, k, i) in enumerate(best) if k >= 1} == {rank: x for (own, rank), x in got.items() if own == q}
    assert recall.search(spark, f"file://{tmp_path}/nothing", asked, 3).count() == 0


def test_dense_search_leaves_out_what_is_no_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0, 0.0]), (7, [0.0, 0.0]), (1, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0, 5.0]), (4, [])], "query_id long, vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in retrieve.dense(table, asked, 3).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 1, 0.707107), (1, 3, 2, 0.0), (3, 1, 6, 0.0)]
    assert retrieve.dense(table, asked.where("false"), 3).count() == 0


def test_texts_that_hold_items_of_any_length(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "xyz", "ü"]) for _ in range(rng.randint(0, 12))) for _ in range(80)]
    items = ["b", "ab", "abc x", "bc", "ab abc", " ", "b xyz ab", "z ab", "c b xyz ab ü", "ab abc b xyz ab abc", "nowhere at all in these texts", "", None]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "id long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "query_id long, text string")
    want = {(q, i) for q, x in enumerate(items) if x for i, t in enumerate(texts) if x in t}
    assert {tuple(r) for r in evaluate.holding(docs, asked).select("query_id", "id").collect()} == want
    assert evaluate.holding(docs, asked.where("false")).count() == 0


def test_pages_of_one_address_have_a_line_each(spark, tmp_path):
    import __spark_entry__ as entry
    from tests.compare import rows

    import duckdb

    pages = [(i, f"u{i // 2}", "") for i in range(9)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    df, twin = entry.queries()["snk19_index_rows"](spark, str(tmp_path)), con.sql(entry.oracle_sql()["snk19_index_rows"])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == 9 and got == rows(list(twin.columns), twin.fetchall())
