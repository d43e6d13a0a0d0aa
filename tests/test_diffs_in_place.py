"""Diffs and Markdown are read where they lie: what rows say is what lines say, and no line is shuffled or kept for a lift."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodequery.operators import audit, reports, trace

ODD = {
    "plain": "before\n@@ -1 +1 @@\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3 @@ def f\n a\n-def g(): pass\n+class H:\n@@ -9 +9,0 @@\n-gone\ndiff --git a/y b/y\nnew file mode 1\n--- /dev/null\n+++ b/y\n@@ -0,0 +1 @@\n+x",
    "renamed": "diff --git a/o b/n\nrename from o\nrename to n\n--- a/o\n+++ b/n2\n+++ /dev/null\n--- a/late\n@@ -1 +1 @@\n+lone\n",
    "binary": "diff --git a/p b/p\nGIT binary patch\n@@ -1 +1 @@\n+x\ndiff --git a/q b/q\ndeleted file mode\n--- a/q\n+++ /dev/null\n@@ -1 +0,0 @@\n--- a/not a header\n-k = 1\n+++ b/neither\n\\ No newline\nother\n",
    "bare": "diff --git a/z b/z\ndiff --git a/docs/d.md b/docs/d.md\n+++ b/docs/d.md\n@@ -1 +1 @@\n+def d\n@@ bad @@\n+ b\n@@ -1 +1 @@\r\n+two words\x0b+wide = 1\u2028+ z\n\n",
    "none": None, "empty": "", "no file": "@@ -1 +1 @@\n+x\n",
}


def changesets(spark):
    return spark.createDataFrame(list(ODD.items()), "ref string, text string")


def same(one, other):
    assert set(one.columns) == set(other.columns) and {f.name: f.dataType.simpleString() for f in one.schema} == {f.name: f.dataType.simpleString() for f in other.schema}
    got = sorted(map(str, one.select(other.columns).collect()))
    assert got == sorted(map(str, other.collect())) and got


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString(), rows._jdf.queryExecution().executedPlan().toString()


def test_rows_say_what_lines_say(spark):
    lines, diffs = trace.diff_lines(changesets(spark)), trace.read_diffs(changesets(spark))
    files = trace.diff_files(lines)
    same(trace.read_files(diffs), files)
    same(trace.read_hunks(diffs), trace.diff_hunks(lines, files))
    for rows in (trace.read_files(diffs), trace.read_hunks(diffs)):
        assert "Exchange" not in plan(rows)[1]


def test_a_lift_needs_no_lines(spark, tmp_path):
    evidence = spark.createDataFrame([("x", "H", "H", "x", 1, 0), ("x", "f", "f", "other", 2, 0), ("n2", "lone", "lone", "n2", 1, 0)], "path string, query string, name string, symbol_path string, line int, place int")
    whole, slim = reports.bundled(changesets(spark), evidence), reports.kept_for_lift(changesets(spark), evidence, str(tmp_path / "b"))
    same(slim.items, whole.items.drop("lines"))
    same(slim.unresolved.drop("snippet"), whole.unresolved.drop("lines"))
    same(slim.excluded, whole.excluded)
    same(slim.refs, whole.refs)
    assert {r["symbol"] for r in slim.items.collect()} == {"H", "lone", None}
    long = spark.createDataFrame([("long", ODD["plain"] + "\n a line of a long file" * 100_000)], "ref string, text string")
    reports.kept_for_lift(long, evidence, str(tmp_path / "long"))
    assert sum(f.stat().st_size for f in (tmp_path / "long").rglob("*.parquet")) < 50_000
    assert reports.lift(slim, spark.createDataFrame([], "ref string, path string, n int, line string")).reports.count() == len(ODD)


def test_bullets_are_read_where_they_lie(spark):
    text = "lead\n  more\n- **REQ-1** first\n\tmore \n  - **FR-2** b\n* **Note** c\nrest\n# - **REQ-3** no\n\n- **REQ-4**\x0bx\n  \ny\n- **REQ-** none\n+ **REQ-5** none"
    rows = audit.requirement_bullets(spark.createDataFrame([("p", text), ("q", None), ("r", ""), ("s", "- **FR-9**"), ("t", "no bullet")], "path string, text string"))
    assert [tuple(r) for r in rows.orderBy("path", "place").select("path", "place", "id", "text").collect()] == [("p", 0, "REQ-1", "- **REQ-1** first more"), ("p", 1, "FR-2", "- **FR-2** b"), ("p", 2, "REQ-4", "- **REQ-4** x"), ("s", 0, "FR-9", "- **FR-9**")]
    assert "Exchange" not in plan(rows)[1]


def test_what_is_read_several_times_is_kept(spark, tmp_path):
    text = lambda *items: json.dumps({"requirements": [{"item": i, "quota": "behaviour", "statement": "must"} for i in items], "open_questions": ["why?"]})
    bundle = reports.kept_for_lift(changesets(spark), spark.createDataFrame([("x", "H", "H", "x", 1, 0)], "path string, query string, name string, symbol_path string, line int, place int"), str(tmp_path / "b"))
    tree = spark.createDataFrame([("plain", "x", 1, "class H"), ("plain", "x", 3, ""), ("bare", "z", 1, "")], "ref string, path string, n int, line string")
    authored = spark.createDataFrame([("plain", text(0)), ("renamed", text(7)), ("empty", "["), ("unknown", text(0)), (None, text(0))], "ref string, text string")
    plain, kept = reports.lift(bundle, tree, authored), reports.lift(bundle, tree, authored, str(tmp_path / "lift"))
    same(kept.reports, plain.reports)
    same(kept.refused, plain.refused)
    assert {(r["ref"], r["fault"]) for r in kept.refused.collect()} == {("renamed", "item"), ("empty", "malformed"), ("unknown", "no changeset"), (None, "no changeset")}
    read = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert 0 < 2 * read(kept.reports) < read(plain.reports)
    items = reports.stored(reports.read_lifts(kept.reports.withColumn("path", F.col("ref")))[0], str(tmp_path / "items"))
    original = spark.createDataFrame([("plain", 0, "REQ-A"), ("binary", 0, "REQ-B")], "ref string, index int, id string")
    verdicts = audit.placeholder_verdicts(original, items).where("ref <> 'binary'")
    one, other = reports.audit_reports(original, items, verdicts), reports.audit_reports(original, items, verdicts, at=str(tmp_path / "audit"))
    same(other.reports, one.reports)
    same(other.refused, one.refused)
