"""Lift and audit over kept texts: what is read back, what is refused, and pages of the reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodequery.operators import audit, reports, trace

DIFF = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,2 +1,3 @@ def alpha
 x
+def beta():
+    pass
@@ -9,2 +10,0 @@
-gone
-gone too
diff --git a/docs/b.md b/docs/b.md
--- a/docs/b.md
+++ b/docs/b.md
@@ -1 +1 @@
+text
"""


@pytest.fixture(scope="module")
def bundle(spark, tmp_path_factory):
    changesets = spark.createDataFrame([("r1", DIFF, 7), ("r2", "", 7), ("r3", None, 7), ("r4", DIFF, 7)], "ref string, text string, item int")
    located = {"symbols": {"src/a.py::beta": [{"name": "beta", "path": "src/a.py", "line": 2}, {"name": "beta", "path": "src/a.py", "line": 9}], "src/a.py::alpha": [{"name": "far", "path": "src/z.py"}]}, "tests": {"beta": [{"name": "t", "path": "tests/t.py"}, {"name": "u", "path": "tests/t.py"}]}}
    evidence, tests = reports.read_evidence(spark.createDataFrame([(json.dumps(located),), ("{",), (None,), ('{"symbols": {"no separator": [{"name": "x", "path": "y"}]}}',)], "text string"))
    assert sorted(map(tuple, evidence.collect())) == [("src/a.py", "alpha", "far", "src/z.py", 0, 0), ("src/a.py", "beta", "beta", "src/a.py", 2, 0)]
    assert [tuple(r) for r in tests.collect()] == [("beta", "tests/t.py", "t", 0)]
    return reports.bundled(changesets, evidence).kept(str(tmp_path_factory.mktemp("bundle") / "b"))


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame([("r1", "src/a.py", 1, "x"), ("r1", "src/a.py", 2, "def beta():"), ("r1", "src/a.py", 3, "    pass"), ("r4", "src/a.py", 1, "beta")], "ref string, path string, n int, line string")


def loaded(rows):
    return {r["ref"]: json.loads(r["text"]) for r in rows.collect()}


def test_a_diff_becomes_a_report(bundle, tree):
    found = reports.lift(bundle, tree)
    out = loaded(found.reports)
    assert set(out) == {"r1", "r2", "r3", "r4"} and found.refused.count() == 0
    one = out["r1"]
    assert one["version"] == "1" and one["changeset_ref"] == "r1" and one["excluded"] == []
    assert [(r["id"], r["source_item"]) for r in one["requirements"]] == [(f"REQ-000-{q}", "item-0") for q in trace.QUOTAS]
    assert one["requirements"][0]["anchor"] == {"file": "src/a.py", "lines": [1, 3], "symbol": "beta", "test": None, "granularity": "symbol", "status": "verified"}
    assert [(d["anchor"]["lines"], d["anchor"]["status"], d["status"]) for d in one["drifts"]] == [([10, 10], "unverified", "proposed")]
    assert one["open_questions"] == ["left out as documentation: docs/b.md"]
    # too short a file: nothing is confirmed, so the item itself is drift, before the hunk
    assert out["r4"]["requirements"] == [] and len(out["r4"]["excluded"]) == 3 and [d["anchor"]["lines"] for d in out["r4"]["drifts"]] == [[1, 3], [10, 10]]
    assert all(not out[r][k] for r in ("r2", "r3") for k in ("requirements", "drifts", "excluded", "open_questions"))


def test_written_requirements(spark, bundle, tree):
    good = {"requirements": [{"item": 0, "quota": "behaviour", "statement": " It must. "}], "open_questions": ["why?"]}
    texts = [("r1", json.dumps(good)), ("r2", json.dumps(good)), ("r3", "no json"), ("r9", json.dumps(good))]
    found = reports.lift(bundle, tree, spark.createDataFrame(texts, "ref string, text string"))
    out = loaded(found.reports)
    assert set(out) == {"r1", "r4"}
    assert [(r["id"], r["statement"]) for r in out["r1"]["requirements"]] == [("REQ-000-behaviour", "It must.")]
    assert out["r1"]["open_questions"] == ["why?", "no requirement of quota user_capability for item-0 (src/a.py:1)", "no requirement of quota implementation for item-0 (src/a.py:1)", "left out as documentation: docs/b.md"]
    assert sorted((r["ref"], r["fault"]) for r in found.refused.collect()) == [("r2", "item"), ("r3", "malformed"), ("r9", "no changeset")]
    rows = [{"item": 1, "quota": "behaviour", "statement": "x"}, {"item": 0, "quota": "other", "statement": "x"}, {"item": 0, "quota": "behaviour", "statement": " "}, {"item": "z", "quota": "behaviour", "statement": "x"}, {"item": True, "quota": "behaviour", "statement": "x"}, {"item": 0, "statement": "x"}]
    _, _, faults = reports.read_authored(spark.createDataFrame([("r1", json.dumps({"requirements": rows}))], "ref string, text string"), bundle.items)
    assert sorted((r["place"], r["fault"]) for r in faults.collect()) == [(0, "item"), (1, "quota"), (2, "statement"), (3, "item"), (4, "item"), (5, "quota")]


def test_changesets_are_kept_and_read(spark):
    changesets = spark.createDataFrame([("r1", DIFF), ("r2", "")], "ref string, text string")
    texts = reports.changeset_texts(changesets)
    out = loaded(texts)
    assert out["r2"]["files"] == [] and [f["path"] for f in out["r1"]["files"]] == ["src/a.py"] and out["r1"]["files"][0]["hunks"][0]["candidate_identifiers"] == ["alpha", "beta"]
    refs, files, hunks, refused = reports.read_changesets(texts.withColumn("path", F.col("ref")))
    lines = trace.diff_lines(changesets)
    want = trace.diff_hunks(lines, trace.diff_files(lines)).where("path like 'src%'")
    pick = ["ref", "file", "hunk", "path", "lines", "identifiers", "old_start", "old_len", "new_start", "new_len"]
    assert sorted(map(tuple, hunks.select(pick).collect())) == sorted(map(tuple, want.select(pick).collect()))
    assert refs.count() == 2 and refused.count() == 0
    evidence = spark.createDataFrame([("src/a.py", "beta", "beta", "src/a.py", 2, 0)], "path string, query string, name string, symbol_path string, line int, place int")
    pick = ["ref", "item", "path", "symbol", "granularity", "start_line", "end_line"]
    assert reports.bundled_hunks(refs, files, hunks, evidence).items.select(pick).collect() == reports.bundled(changesets, evidence).items.select(pick).collect()


ANCHOR = {"file": "a.py", "lines": [1, 2], "granularity": "symbol", "status": "verified", "symbol": "f", "test": None}


def lift_text(ref, requirements=(), drifts=(), **more):
    return json.dumps({"version": "1", "changeset_ref": ref, "requirements": list(requirements), "drifts": list(drifts)} | more)


def test_lifts_are_read_or_refused(spark):
    need = {"id": "REQ-1", "quota": "behaviour", "statement": "s", "anchor": ANCHOR}
    loose = {"description": "d", "anchor": ANCHOR | {"status": "unverified", "symbol": None, "test": {"name": "t", "path": "p"}}}
    cut = lambda k: {"statement": "s", "anchor": {x: v for x, v in ANCHOR.items() if x != k}}
    texts = {
        "a": lift_text("r1", [need, need | {"anchor": ANCHOR | {"test": "p::q"}}], [loose]), "b": lift_text("r1", [need]), "c": lift_text("r2", version="2"), "d": lift_text("r3", version=1), "e": "{", "f": "[1]", "g": None, "h": "",
        "i": lift_text(""), "j": lift_text(5), "k": lift_text("r4", [{"id": "x"}]), "l": lift_text("r5", [cut("lines")]), "m": lift_text("r6", [], [cut("file")]), "n": lift_text("r7"), "o": lift_text("r8", [need]), "p": json.dumps({"version": "1", "changeset_ref": "r9"}),
        "q": lift_text("r10", [need | {"anchor": ANCHOR | {"lines": [1, None]}}]), "r": lift_text("r7", version="2"),
    }
    wanted = spark.createDataFrame([("o", "another"), ("a", "r1")], "path string, ref string")
    items, refused = reports.read_lifts(spark.createDataFrame(list(texts.items()), "path string, text string"), wanted)
    assert {r["path"]: r["fault"] for r in refused.collect()} == {
        "b": "repeated", "c": "version", "d": "version", "e": "malformed", "f": "malformed", "g": "malformed", "h": "malformed", "i": "no ref", "j": "no ref", "k": "malformed", "l": "malformed", "m": "malformed", "o": "other ref", "q": "malformed", "r": "version",
    }
    got = sorted((r["ref"], r["index"], r["origin"], r["quota"], r["statement"], r["path"], r["start_line"], r["end_line"], r["symbol"], r["verified"], r["anchor"]["test"]) for r in items.collect())
    assert got == [("r1", 0, "requirement", "behaviour", "s", "a.py", 1, 2, "f", True, None), ("r1", 1, "requirement", "behaviour", "s", "a.py", 1, 2, "f", True, "p::q"), ("r1", 2, "drift", None, "d", "a.py", 1, 2, None, False, "p::t")]


def test_verdicts_are_read_or_refused(spark):
    group = {"original": 0, "speclift": [0], "alignment_confidence": "media", "verdict": "SODDISFATTO", "verdict_confidence": "alta"}
    extra = {"speclift": 1, "verdict": "NON_DOCUMENTATO", "explanation": "e", "verdict_confidence": "bassa", "severity": "bassa", "detectability": "media"}
    text = lambda ref, groups, extras: json.dumps({"changeset_ref": ref, "groups": groups, "extras": extras, "open_questions": ["q"]})
    texts = {
        "a": text("r1", [group], [extra]), "b": text("r2", [group | {"verdict": "OTHER"}], []), "c": text("r3", [group | {"severity": "huge"}], []), "d": text("r4", [{k: v for k, v in group.items() if k != "original"}], []),
        "e": text("r5", [], [extra | {"speclift": None}]), "f": json.dumps({"changeset_ref": "r6", "groups": []}), "g": text("r7", [group | {"alignment_confidence": None}], []), "h": text("r8", [], []),
    }
    verdicts, asked, refused = reports.read_verdicts(spark.createDataFrame(list(texts.items()), "path string, text string"))
    assert {r["path"]: r["fault"] for r in refused.collect()} == dict.fromkeys("bcdefg", "malformed")
    assert sorted((r["ref"], r["original"], r["lifted"], r["verdict"], r["confidence"], r["alignment"]) for r in verdicts.collect() if r["original"] is not None) == [("r1", 0, [0], "SODDISFATTO", "alta", "media")]
    assert sorted((r["ref"], r["question"]) for r in asked.collect()) == [("r1", "q"), ("r8", "q")]
    again, _, refused = reports.read_verdicts(reports.verdict_texts(verdicts, asked.select("ref")).withColumn("path", F.col("ref")))
    assert sorted(map(str, again.collect())) == sorted(map(str, verdicts.collect())) and refused.count() == 0


def test_audits_over_kept_texts(spark):
    need = {"id": "REQ-1", "quota": "behaviour", "statement": "s", "anchor": ANCHOR}
    loose = {"description": "d", "anchor": ANCHOR | {"status": "unverified"}}
    texts = [(r, lift_text(r, [need], [loose])) for r in ("r1", "r2", "r3")]
    items, _ = reports.read_lifts(spark.createDataFrame(texts, "path string, text string"))
    original = spark.createDataFrame([("r1", 0, "REQ-A"), ("r1", 1, "REQ-B"), ("r3", 0, "REQ-C"), ("r4", 0, "REQ-D")], "ref string, index int, id string")
    verdicts = audit.placeholder_verdicts(original.where("ref <> 'r3'"), items.where("ref <> 'r3'"))
    grave = verdicts.withColumn("verdict", F.when((F.col("ref") == "r1") & (F.col("original") == 1), "DRIFTED").otherwise(F.col("verdict")))
    grave = grave.withColumns({c: F.when(F.col("verdict") == "DRIFTED", v).otherwise(F.col(c)) for c, v in {"severity": "alta", "detectability": "media", "explanation": "it went", "alignment": "bassa"}.items()})
    asked = spark.createDataFrame([("r1", 0, "who?"), ("r3", 0, "nobody")], "ref string, place int, question string")
    found = reports.audit_reports(original, items, grave, asked, spark.createDataFrame([("r1",), ("r2",), ("r3",)], "ref string"))
    assert sorted((r["ref"], r["side"], r["index"], r["fault"]) for r in found.refused.collect()) == [("r3", "lifted", 0, "uncovered"), ("r3", "lifted", 1, "uncovered"), ("r3", "original", 0, "uncovered")]
    out = loaded(found.reports)
    assert set(out) == {"r1", "r2"}
    one = out["r1"]
    assert [(r["original_ref"], r["verdict"], r["verdict_confidence"], r["risk"]) for r in one["records"]] == [("REQ-B", "DRIFTED", "bassa", {"severity": "alta", "detectability": "media", "risk": "alta"}), ("REQ-A", "SODDISFATTO", "media", None)]
    assert one["records"][0]["anchors"][0]["status"] == "unverified" and one["records"][0]["proposed"] and len(one["records"][0]["notes"]) == 2
    assert one["matrix"]["counts"] == {"SODDISFATTO": 1, "NON_DOCUMENTATO": 0, "MANCANTE": 0, "PARZIALE": 0, "DRIFTED": 1} and one["matrix"]["records_by_verdict"]["DRIFTED"] == ["REQ-B"]
    assert one["open_questions"] == ["who?"] and one["declared_gaps"] == [] and out["r2"]["declared_gaps"] == ["original_source: absent"]
    told, refused = reports.read_audits(found.reports.withColumn("path", F.col("ref")))
    assert refused.count() == 0
    pages = {r["ref"]: r["text"] for r in reports.audit_pages(told).collect()}
    assert "| DRIFTED | 1 |" in pages["r1"] and "### 1. REQ-B — **DRIFTED** _(proposed)_" in pages["r1"] and "- **Risk**: alta (severity alta, detectability media)" in pages["r1"] and pages["r1"].endswith("## Open questions\n\n- who?\n")
    assert "- original_source: absent\n" in pages["r2"] and "### 1. (undocumented) — **NON_DOCUMENTATO**" in pages["r2"]


def test_pages_of_lifts(spark, bundle, tree):
    pages = {r["ref"]: r["text"] for r in reports.lift_pages(reports.lift(bundle, tree).reports).collect()}
    assert pages["r2"] == "# Requirements of `r2`\n\n_No confirmed requirement._\n"
    assert "## REQ-000-behaviour · behaviour\n\nchange in beta (symbol)\n\n- **Anchor**: `src/a.py:1-3 [beta]` (verified)\n" in pages["r1"] and "- _(proposed)_ no requirement covers the change in src/a.py:10-10 — `src/a.py:10-10`\n" in pages["r1"]
    assert pages["r4"].count("anchor not verified: beta (src/a.py:1-3)") == 3 and pages["r4"].endswith("## Open questions\n\n- left out as documentation: docs/b.md\n")


def test_no_texts(spark):
    none = spark.createDataFrame([], "path string, ref string, text string")
    assert all(x.count() == 0 for x in (*reports.read_lifts(none), *reports.read_verdicts(none), *reports.read_audits(none), *reports.read_changesets(none), reports.changeset_texts(none)))
