"""Versioned tables, an index that is brought up, listings of trees, and streams that keep a manifest."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodequery.operators import index, lexical
from lodequery.sources import files, store, versions
from lodequery.streaming import flows


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tables_by_key_and_their_versions(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    like = rows()
    assert not store.exists(spark, at) and store.kept(spark, at, like).count() == 0
    store.upserted(rows((1, "a"), (2, "b"), (2, "a"), (None, "n")), at, ["k"])
    old = store.kept(spark, at, like)
    assert found(old) == [(1, "a"), (2, "a"), (None, "n")]  # the least of a key's rows
    assert found(store.upserted(rows((2, "c"), (None, "m")), at, ["k"])) == [(1, "a"), (2, "c"), (None, "m")]
    assert found(store.inserted_or_ignored(rows((2, "z"), (3, "y"), (3, "x")), at, ["k"], order=("v",))) == [(1, "a"), (2, "c"), (3, "x"), (None, "m")]
    assert found(store.without(rows((1, "")), at, like, ["k"])) == [(2, "c"), (3, "x"), (None, "m")]
    assert found(store.upserted(rows((1, "again")), at, ["k"])) == [(1, "again"), (2, "c"), (3, "x"), (None, "m")]
    assert found(old) == [(1, "a"), (2, "a"), (None, "n")]  # a reader keeps its version
    before = found(store.kept(spark, at, like))
    assert found(store.compacted(spark, at, like)) == before and len(versions.last(spark, at)[1]["segments"]) == 1
    assert store.swept(spark, at) > 0 and found(store.kept(spark, at, like)) == before
    store.replaced(store.kept(spark, at, like).where("k = 1"), at)
    assert found(store.kept(spark, at, like)) == [(1, "again")]
    store.dropped(spark, at)
    store.dropped(spark, at)
    assert not store.exists(spark, at)


def test_two_writers_and_a_broken_version(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    seen, _ = versions.last(spark, at)
    versions.committed(spark, at, seen, {"segments": []})
    with pytest.raises(versions.Conflict):
        versions.committed(spark, at, seen, {"segments": ["x"]})
    (tmp_path / "t/versions/00000002.json").write_text('{"segm')  # a writer that ended half way
    assert versions.last(spark, at) == (2, {"segments": []})
    one = lambda i: store.inserted_or_ignored(spark.createDataFrame([(i, "w"), (99, str(i))], "k int, v string"), at, ["k"])
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(one, range(3)))
    rows = found(store.kept(spark, at, spark.createDataFrame([], "k int, v string")))
    assert [r[0] for r in rows] == [0, 1, 2, 99]  # each one's own row, and one first write of the shared key


def corpus(spark, texts, mtime=1):
    rows = [(p, t, "code" if p.endswith(".py") else "doc", "python" if p.endswith(".py") else "markdown", m if isinstance(m := (mtime.get(p, 1) if isinstance(mtime, dict) else mtime), int) else 1) for p, t in texts.items()]
    return spark.createDataFrame(rows, "path string, text string, doc_type string, language string, mtime long")


OLD = {"a.md": "# One\nalpha beta\n# Two\nbeta beta", "b.md": "gamma", "c.py": "def f():\n    g()\n\ndef g():\n    pass\n", "e.md": None, "d.md": "delta alpha"}
NEW = {"a.md": "# One\nalpha beta\n# Two\nchanged", "c.py": "def f():\n    h()\n\ndef h():\n    pass\n", "d.md": "delta alpha", "e.md": "", "f.md": "new alpha f", "z.py": "import c\nclass K:\n    def m(self):\n        f()\n"}


def state(kept):
    terms = sorted((r["term"], r["df"], round(r["idf"], 9)) for r in kept.lexical().terms.collect())
    nodes, edges = kept.graph()
    vectors = sorted((r["chunk_id"], round(sum(r["vector"]), 9)) for r in kept.vectors.collect())
    return found(kept.files), found(kept.chunks.drop("heading_path")), terms, found(kept.lexical().sizes), found(nodes), found(edges), vectors


def test_bringing_up_equals_building(spark, tmp_path):
    at, mtime = f"file://{tmp_path}/i", {"a.md": 2, "c.py": 2, "f.md": 2, "z.py": 2}
    index.build(corpus(spark, OLD), at)
    kept, counts = index.bring_up(corpus(spark, NEW, mtime), at)
    assert counts == {"new": 2, "modified": 2, "deleted": 1, "unchanged": 2}
    whole = state(index.build(corpus(spark, NEW, mtime), f"file://{tmp_path}/whole"))
    assert state(kept) == whole
    # what didn't change is neither chunked nor parsed nor embedded again
    for table in ("chunks", "vectors", "postings", "facts"):
        own = versions.read(spark, at, table, kept.segments[-1:], index.schema(table))
        assert {r["path"] for r in own.select("path").distinct().collect()} <= {"a.md", "c.py", "f.md", "z.py"}
    assert index.bring_up(corpus(spark, NEW, mtime), at)[1] == {"new": 0, "modified": 0, "deleted": 0, "unchanged": 6}
    assert index.opened(spark, at).number == kept.number  # a run without changes writes nothing
    assert state(index.compact(spark, at)) == whole and index.swept(spark, at) > 0
    again = index.opened(spark.newSession(), at)
    assert len(again.segments) == 1 and state(again) == whole
    asked = spark.createDataFrame([(1, "alpha f"), (2, "nothing"), (3, "changed")], "query_id long, query string")
    assert [tuple(r)[:2] for r in index.search(again, asked, 2).orderBy("query_id", "rank").collect()][-1] == (3, "a.md#1")
    assert {r["id"] for r in index.search(again, asked, 9, "code").collect()} <= {"c.py#0", "c.py#1", "z.py#0", "z.py#1", "z.py#2"}


def test_an_index_of_nothing_and_of_repeated_paths(spark, tmp_path):
    at = f"file://{tmp_path}/i"
    kept, counts = index.bring_up(corpus(spark, {}), at)
    assert kept.chunks.count() == 0 and counts["new"] == 0
    twice = corpus(spark, {"a.md": "old"}).unionByName(corpus(spark, {"a.md": "new"}, 5)).unionByName(corpus(spark, {"a.md": "x"}).withColumn("path", F.lit(None).cast("string")))
    kept, counts = index.bring_up(twice, at)
    assert counts["new"] == 1 and [r["text"] for r in kept.chunks.collect()] == ["new"]
    assert index.bring_up(corpus(spark, {}), at)[0].lexical().terms.count() == 0


def test_runs_between_full_builds(spark, tmp_path):
    at = f"file://{tmp_path}/i"
    index.build(corpus(spark, OLD), at, vectors=False)
    sizes = [len(index.bring_up(corpus(spark, OLD | {"x.md": f"text {i}"}, {"x.md": i}), at, reconcile_every=3)[0].segments) for i in range(2, 5)]
    assert sizes == [2, 3, 1]


def test_an_index_of_files_is_built_once_and_opened_by_others(spark, tmp_path):
    at = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").write.parquet(at)
    before = set(os.listdir(lexical.shared(spark).removeprefix("file://")))
    first = lexical.indexed(spark.read.parquet(at))
    other = lexical.indexed(spark.newSession().read.parquet(at))
    assert first.postings.inputFiles() == other.postings.inputFiles()
    fresh = set(os.listdir(lexical.shared(spark).removeprefix("file://"))) - before
    assert len(fresh) == 1
    spark.createDataFrame([(3, "c d")], "doc_id long, text string").write.mode("append").parquet(at)
    assert {r["term"] for r in lexical.indexed(spark.read.parquet(at)).terms.collect()} == {"a", "b", "c", "d"}
    some = spark.read.parquet(at).where("doc_id > 1")
    assert {r["term"] for r in lexical.indexed(some).terms.collect()} == {"b", "c", "d"}
    twice = spark.createDataFrame([(1, "a a"), (1, "a b"), (2, "b"), (None, "x")], "doc_id long, text string")
    assert found(lexical.indexed(twice).sizes)[0][0] == 3


def test_every_file_is_listed(spark, tmp_path):
    for p in ("a/__init__.py", "a/.env2", "a/b/c/d/deep.md", "_x/y.py", "empty.txt", "node_modules/m.js", "ä b/ü.py", "bin/x"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("" if p.startswith("empty") else p)
    (tmp_path / "hollow").mkdir()
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "nothing", tmp_path / "broken")
    want = {os.path.relpath(os.path.join(d, f), tmp_path): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names if os.path.exists(os.path.join(d, f))}
    for tasks in ("1", "3", "64"):
        spark.dataSource.register(files.FileTree)
        got = spark.read.format("file_tree").option("tasks", tasks).load(str(tmp_path)).collect()
        assert {r["path"]: r["size"] for r in got} == want and len(got) == len(want)
        assert all((tmp_path / r["path"]).read_bytes() == r["content"] for r in got)
    names = files.all_files(spark, f"file://{tmp_path}", exclude=("node_modules", "b*"), content=False)
    assert {r["path"] for r in names.collect()} == {p for p in want if not p.startswith(("node_modules", "bin")) and "/b/" not in p}
    assert names.where("content is not null").count() == 0
    made, _ = index.bring_up(files.documents(files.all_files(spark, str(tmp_path))), f"file://{tmp_path}-index", vectors=False)
    assert {r["path"] for r in made.files.collect()} == {"a/__init__.py", "a/b/c/d/deep.md", "_x/y.py", "ä b/ü.py"}


def test_a_batch_of_a_stream_writes_its_own_paths_alone(spark, tmp_path):
    schema = "path string, mtime long, content_hash string, logic_version string, gone boolean"
    batches = [[(f"p{i}", 1, "h", "v", False) for i in range(500)], [("p1", 2, "i", "v", False), ("p2", 2, None, "v", True), ("p1", 1, "z", "v", False)], [("p2", 3, "j", "v", False), ("p1", 4, None, "v", True)], [("p3", 1, "k", "v", False)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    at = f"file://{tmp_path}/manifest"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.finished(flows.kept_up(stream, at, str(tmp_path / "log")))
    rows = store.kept(spark, at, spark.createDataFrame([], schema).drop("gone"))
    got = {r["path"]: r["content_hash"] for r in rows.collect()}
    assert len(got) == 499 and got["p2"] == "j" and got["p3"] == "k" and "p1" not in got
    segments = versions.last(spark, at)[1]["segments"]
    counts = [spark.read.parquet(f"{at}/rows/_seg={s['name']}").count() for s in segments]
    assert counts == [500, 1, 1, 1]
