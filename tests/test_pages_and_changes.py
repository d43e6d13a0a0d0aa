"""Pages, changesets, audits, transcripts, chunks and embeddings: hand-made cases, nulls and empty tables."""

from __future__ import annotations

import ast

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.functions import diff as D
from lodequery.functions import embed as E
from lodequery.functions import wiki as W
from lodequery.operators import audit, chunking, memory, trace, wiki
from lodequery.sources import transcripts


def one(spark, value, body):
    return spark.createDataFrame([(value,)], "x string").select(body(F.col("x")).alias("y")).first()["y"]


PAGE = "---\ntitle: 'A b'\ntags:\n  - x\n  - \"y\"\nkind: [p, q]\nempty:\n# note\ntitle: last\n---\nbody [[a]] [[b|c]] [[a#d]] `[[no]]`\n```\n[[never]]\n```\n[[t\\|u]]\n"


def test_frontmatter_and_links(spark):
    fields = one(spark, PAGE, W.frontmatter)
    assert {k: (v["list"], v["values"]) for k, v in fields.items()} == {"title": (False, ["last"]), "tags": (True, ["x", "y"]), "kind": (True, ["p", "q"]), "empty": (True, [])}
    assert one(spark, PAGE, W.wikilinks) == ["a", "b", "t"]
    assert one(spark, PAGE, lambda c: W.missing_required(W.frontmatter(c), ("title", "empty", "none"))) == ["empty", "none"]
    for text in (None, "", "---\nno end", "x"):
        assert one(spark, text, W.frontmatter) == {} and one(spark, text, W.wikilinks) == []
        assert one(spark, text, W.body) == (text or "")


def test_code_is_stripped_with_back_references(spark):
    assert one(spark, "a ``x ` y`` b", W.strip_code) == "a   b"
    assert one(spark, "~~~\n[[x]]\n~~~\nend", W.strip_code) == "\n\nend"
    assert one(spark, "```\nopen [[x]]", W.wikilinks) == ["x"]


def test_wiki_of_no_pages_and_null_texts(spark):
    files = spark.createDataFrame([("en/a.md", None), ("en/b.md", "[[a]]"), ("index.md", None)], "rel_path string, text string").withColumn("target", F.lit("clash"))
    found = {(r["rel_path"], r["finding"]) for r in wiki.lint(files).collect()}
    assert found == {("en/b.md", "orphan"), ("en/a.md", "missing-frontmatter"), ("en/b.md", "missing-frontmatter")}
    none = files.where("false")
    assert wiki.lint(none).count() == wiki.distill_audit(none).count() == wiki.inventory(none, {}).count() == wiki.log_segments(none).count() == 0
    assert wiki.stale_recording(none.withColumnRenamed("rel_path", "path"), "x").first()[0] is None


def test_coverage_lines(spark):
    text = "x\n <!-- covers/1 -->\na@1\n  b@c@2\nbad\n@3\n-->\nz@9\n<!-- covers/1\nd@4"
    assert [tuple(r) for r in one(spark, text, W.covered_items)] == [("a", "1"), ("b@c", "2"), ("d", "4")]


DIFF = """noise
diff --git a/x.py b/x.py
rename from w.py
rename to x.py
--- a/w.py
+++ b/x.py
@@ -1 +1,2 @@ class K
-def old(): pass
+def new(): pass
+VALUE = 3
--- not a header but read as one
@@ -9,2 +9,0 @@
-gone
diff --git a/p.png b/p.png
new file mode 1
+++ b/p.png
Binary files differ
@@ -1 +1 @@
+x
"""


def test_diffs(spark):
    lines = trace.diff_lines(spark.createDataFrame([("r", DIFF), ("n", None), ("e", "")], "ref string, text string"))
    files = {r["path"]: r for r in trace.diff_files(lines).collect()}
    assert (files["x.py"]["change_type"], files["x.py"]["old_path"], files["x.py"]["is_binary"]) == ("renamed", "w.py", False)
    assert files["p.png"]["is_binary"] and len(files) == 2
    hunks = {r["hunk"]: r for r in trace.diff_hunks(lines, trace.diff_files(lines)).collect()}
    assert len(hunks) == 2 and hunks[0]["identifiers"] == ["K", "old", "new", "VALUE"] and hunks[0]["lines"] == ["-def old(): pass", "+def new(): pass", "+VALUE = 3"]
    assert (hunks[1]["old_start"], hunks[1]["old_len"], hunks[1]["new_len"]) == (9, 2, 0)


def test_items_and_drift(spark):
    lines = trace.diff_lines(spark.createDataFrame([("r", DIFF)], "ref string, text string"))
    hunks = trace.diff_hunks(lines, trace.diff_files(lines))
    evidence = spark.createDataFrame([("x.py", "new", "new", "x.py", 1, 0), ("x.py", "K", "K", "other.py", 5, 0)], "path string, query string, name string, symbol_path string, line int, place int")
    items, unresolved = trace.evidence_items(hunks, trace.located(hunks, evidence))
    rows = items.collect()
    assert [(r["item"], r["symbol"], r["start_line"], r["end_line"], r["cross"]) for r in rows] == [(0, "new", 1, 2, ["K@other.py"])]
    assert unresolved.count() == 1
    needs = trace.placeholder_requirements(items)
    assert trace.strangers(needs, items).count() == 0 and trace.missing_quotas(items, needs.limit(2)).count() == 1
    assert {r["what"] for r in trace.drift(items, unresolved, needs.where("false")).collect()} == {"item", "hunk"}


def test_queries_fall_back_to_a_single_name(spark):
    ask = lambda ids, text: spark.createDataFrame([(ids, text)], "i array<string>, t string").select(D.identifier_queries(F.col("i"), F.col("t")).alias("q")).first()["q"]
    assert ask(["a", "a", "", "b"], "x") == ["a", "b"] and ask([], "\n  name \n") == ["name"] and ask([], "two words") == [] and ask([], "") == []


def test_requirement_bullets(spark):
    text = "- **REQ-1** first\n  more\n# head\n- **FR-2** b\n* **Note** c\n\nx\n"
    rows = audit.requirement_bullets(spark.createDataFrame([("p", text), ("q", None)], "path string, text string")).orderBy("place").collect()
    assert [(r["id"], r["text"]) for r in rows] == [("REQ-1", "- **REQ-1** first more"), ("FR-2", "- **FR-2** b")]


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "ref string, index int, id string, path string, start_line int, end_line int, symbol string, verified boolean")
    verdicts = audit.placeholder_verdicts(none, none)
    assert verdicts.count() == audit.faults(none, none, verdicts).count() == audit.records(none, none, verdicts).count() == audit.matrix(audit.records(none, none, verdicts)).count() == 0


def test_transcripts(spark):
    lines = [("s", 0, "{bad"), ("s", 1, None), ("s", 2, '{"type":"user","message":{"role":"user","content":"hi"},"timestamp":"2024-01-01T00:00:10Z"}'), ("s", 3, '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"thinking","thinking":"b"}]}}'), ("s", 4, '{"type":"user","message":{"role":"user","content":5}}'), ("s", 5, "[1]")]
    rows = transcripts.message_turns(spark.createDataFrame(lines, "session_key string, line int, value string")).orderBy("turn_index").collect()
    assert [(r["turn_index"], r["role"], r["text"], r["ts"]) for r in rows] == [(0, "user", "hi", 1704067210.0), (1, "assistant", "a\nb", None)]


@pytest.mark.parametrize(("child", "parent", "inside"), [("/a/b", "/a", True), ("/a", "/a/", True), ("/ab", "/a", False), ("/a", "/", True), ("/a", "/a/b", False)])
def test_paths_within(spark, child, parent, inside):
    assert spark.range(1).select(transcripts.within(F.lit(child), F.lit(parent))).first()[0] is inside


def test_sessions_read_from_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s1.jsonl").write_text('{"type":"user","message":{"role":"user","content":"x"}}\n\n')
    rows = transcripts.message_turns(transcripts.json_lines(spark, str(tmp_path))).collect()
    assert [(r["session_key"], r["text"]) for r in rows] == [("s1", "x")]


def test_windows_refuse_a_begin_after_the_end():
    with pytest.raises(ValueError, match="begins after"):
        memory.checked_window(2.0, 1.0)


def test_snippets(spark):
    cut = lambda text, p: spark.createDataFrame([(text, p)], "t string, p array<string>").select(memory.snippet(F.col("t"), F.col("p"), 3).alias("s")).first()["s"]
    assert cut("a b c Hit, d e", ["hit"]) == "…c [Hit,] d…" and cut("a b", ["z"]) == "a b" and cut(None, ["z"]) == ""


def test_python_units():
    source = "import x\n\n@d\ndef f():\n    return 1\n\nclass A:\n    y = 1\n    def m(self):\n        pass\n    class B:\n        def n(self): pass\nz = 1\n"
    units = list(chunking.python_units(source, 1600))
    assert [(u["node_type"], u["qualname"], u["start_line"], u["end_line"]) for u in units] == [
        ("module", None, 1, 1), ("function", "f", 3, 5), ("class", "A", 7, 8), ("method", "A.m", 9, 10), ("class", "A.B", 11, 11), ("method", "A.B.n", 12, 12), ("module", None, 13, 13),
    ]
    assert chunking.python_units("def (", 10) is None and ast.parse(source)
    parts = list(chunking.python_units("def f():\n    a = 1\n    b = 2\n", 20))
    assert [p["qualname"] for p in parts] == ["f (part 1)", "f (part 2)"] and {(p["start_line"], p["end_line"]) for p in parts} == {(1, 3)}


def test_capped_pieces_keep_to_the_budget(spark):
    rows = spark.createDataFrame([(1, 0, "\n".join(["word word"] * 50)), (2, 0, "short")], "id int, ordinal int, text string")
    got = chunking.cap(rows, 30, 5).collect()
    assert sum(r["id"] == 1 for r in got) > 5 and all(len(r["text"]) <= 60 for r in got)


def test_windows_of_exact_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    own = chunking.Tokenizer(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    texts = ["", "short", "größe 日本語 🎉 " * 40, "a b\n" * 100, "x" * 500, None]
    rows = spark.createDataFrame([(i, 0, t, "kept") for i, t in enumerate(texts)], "id long, ordinal int, text string, other string")
    for most, overlap in ((10, 3), (7, 0), (5, 9), (1, 0)):
        got = {(r["id"], r["piece"]): r["text"] for r in chunking.cap(rows.where("text is not null"), most, overlap, own).collect()}
        for i, t in enumerate(texts[:-1]):
            ids = own.encoding().encode_ordinary(t)
            want, at = [t], 0
            if len(ids) > most:
                want = []
                while True:
                    want.append(own.encoding().decode(ids[at : at + most]))
                    if at + most >= len(ids):
                        break
                    at += max(1, most - overlap)
            assert [got[i, n] for n in range(len(want))] == want and (i, len(want)) not in got
    counts = [r["n"] for r in rows.select("id", chunking.token_counts(F.col("text"), own).alias("n")).orderBy("id").collect()]
    assert counts == [len(own.encoding().encode_ordinary(t or "")) for t in texts]


def test_hashed_vectors(spark):
    rows = E.hashed(spark.createDataFrame([(1, "Ab"), (2, None), (3, "ab  ab")], "i int, text string")).orderBy("i").collect()
    a = np.array(rows[0]["vector"])
    assert len(a) == 512 and np.linalg.norm(a) == pytest.approx(1) and not any(rows[1]["vector"]) and np.allclose(rows[2]["vector"], a)
    assert {E.place(g)[1] < 0 for g in (" ab", "ab ", " ab ") if E.place(g)[0] < 256} <= {True}


def test_word_vectors_from_a_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("cat 1 0\nhouse 0 2\n")
    vocabulary = E.word_vectors(spark, f"{tmp_path}/v.txt", dim=2)
    rows = E.word_means(spark.createDataFrame([(1, "cat House"), (2, "CatHouse x"), (3, None)], "i int, text string"), vocabulary, "i", dim=2).orderBy("id").collect()
    want = np.array([0.5, 1.0]) / np.linalg.norm([0.5, 1.0])
    assert np.allclose(rows[0]["vector"], want) and np.allclose(rows[1]["vector"], want) and rows[2]["vector"] == [0.0, 0.0]
    (tmp_path / "bad.txt").write_text("cat 1\n")
    with pytest.raises(Exception, match="unexpected line"):
        E.word_vectors(spark, f"{tmp_path}/bad.txt", dim=2).select(F.sum(F.size("vector"))).collect()


def test_files_are_discovered_and_read(spark, tmp_path):
    from lodequery.sources import files

    for name, data in {"src/a.py": b"x = 1", "src/b.MD": b"# t\xff", "out/c.py": b"c", "src/d.bin": b"1", "a/e.sql": b"s", "a-b/f.go": b"f", "src/_hidden.py": b"h", "src/empty.py": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    every = files.all_files(spark, str(tmp_path))
    assert [r["path"] for r in files.discovered(every).collect()] == ["a/e.sql", "a-b/f.go", "src/_hidden.py", "src/a.py", "src/b.MD", "src/empty.py"]
    docs = {r["path"]: (r["text"], r["doc_type"], r["language"]) for r in files.documents(every).collect()}
    assert docs["src/b.MD"] == ("# t", "doc", "markdown") and docs["src/a.py"] == ("x = 1", "code", "python")
    ids = {r["path"]: r["i"] for r in every.select("path", files.content_id(F.col("content")).alias("i")).collect()}
    assert set(ids) == {"src/a.py", "src/b.MD", "out/c.py", "src/d.bin", "a/e.sql", "a-b/f.go", "src/_hidden.py", "src/empty.py"}
    empty = spark.range(1).select(files.content_id(F.lit(b""))).first()[0]
    assert empty == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert spark.range(1).select(files.content_id(F.lit(None).cast("binary"))).first()[0] == "-"


def test_a_streams_batch_has_as_many_files_as_tasks_wrote_it(spark):
    from lodequery.plans.code import _fed

    rows = spark.range(60).repartition(3).selectExpr("id", "cast(id % 2 * 2 AS int) AS part")
    seen = []

    def work(stream, at):
        put = lambda batch, n: seen.append((n, sorted(r[0] % 2 for r in batch.select("id").distinct().collect()), len(batch.inputFiles()) if batch.isLocal() else batch.rdd.getNumPartitions()))
        stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{at}/in/*")

    out = _fed(spark, "", rows, 3, work, "part")
    assert out.count() == 60 and [(n, set(v)) for n, v, _ in seen] == [(0, {0}), (1, set()), (2, {1})]
    assert len({r[0] for r in out.selectExpr("input_file_name()").distinct().collect()}) >= 6
