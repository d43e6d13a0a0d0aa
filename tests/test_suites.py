"""Suites and baselines as TOML."""

from __future__ import annotations

import tomllib

from lodequery.sources import suites

TEXT = '''
[[case]]
query = """
two
lines"""
expected = ["a.py", "b.md"]
kind = "nl"
intent = "both"
[[case]]
query = " "
expected = ["x"]
[[case]]
query = "q"
expected = []
[[case]]
query = "r"
expected = ["a", 3]
[[case]]
query = "s"
expected = ["a"]
intent = "all"
[[graph_case]]
relation = "defines"
target = "f"
expected = []
[[graph_case]]
relation = "unknown"
target = "f"
expected = ["x"]
'''


def test_cases_and_their_faults(spark, tmp_path):
    (tmp_path / "one.toml").write_text(TEXT)
    (tmp_path / "bad.toml").write_text("[[case")
    (tmp_path / "empty.toml").write_text("")
    (tmp_path / "odd.toml").write_text("case = 3")
    rows = suites.read(spark, str(tmp_path)).collect()
    got = {(r["path"], r["form"], r["place"]): r["fault"] for r in rows}
    assert got == {
        ("one.toml", "case", 0): None, ("one.toml", "case", 1): "query", ("one.toml", "case", 2): "expected", ("one.toml", "case", 3): "expected", ("one.toml", "case", 4): "intent",
        ("one.toml", "graph_case", 0): None, ("one.toml", "graph_case", 1): "relation", ("bad.toml", "case", 0): "toml", ("odd.toml", "case", 0): "table",
    }
    first = next(r for r in rows if r["path"] == "one.toml" and r["form"] == "case" and not r["place"])
    assert (first["query"], first["expected"], first["intent"]) == ("two\nlines", ["a.py", "b.md"], "both")


def test_adding_amending_and_writing(spark):
    cases = suites.parsed(spark.createDataFrame([("one", TEXT), ("none", None)], "path string, text string")).where("fault is null")
    like = cases.drop("place", "fault")
    new = spark.createDataFrame([
        ("one", "case", "two\nlines", None, None, ["z"], None, "both"), ("one", "case", "new \\ \"q\"\t", None, None, ["n"], None, None), ("one", "graph_case", None, "defines", "f", ["y"], None, None),
        ("other", "graph_case", None, "who_calls", "g", [], None, None), ("one", "case", "two\nlines", None, None, ["z"], None, "code"),
    ], like.schema)
    after, clash = suites.added(cases, new.where("intent is null or intent = 'both'"))
    assert after.count() == 4 and clash.count() == 0
    assert [tuple(r) for r in suites.added(cases, new.where("intent = 'code'"))[1].collect()] == [("one", "two\nlines", "code", "both")]
    again, _ = suites.added(after, new.where("intent is null"))
    assert again.count() == 4
    changed = suites.amended(after, spark.createDataFrame([("one", "two\nlines", ["only"], None, "doc")], "path string, query string, expected array<string>, kind string, intent string"))
    text = {r["path"]: r["text"] for r in suites.text_of(changed).collect()}
    data = tomllib.loads(text["one"])
    assert data["case"] == [{"query": "two\nlines", "expected": ["only"], "kind": "nl", "intent": "doc"}, {"query": "new \\ \"q\"\t", "expected": ["n"]}]
    assert data["graph_case"] == [{"relation": "defines", "target": "f", "expected": []}] and tomllib.loads(text["other"])["graph_case"][0]["target"] == "g"


def test_baselines(spark):
    fused = '[fused_baseline]\nunion_hit_rate = 1.0\n[[fused_baseline.surface]]\nsurface = "code"\nmrr = 0.5\n[fused_baseline.surface.hit_rate]\n1 = 0.25\n'
    rows = spark.createDataFrame([("a", "provider = 'x'\nqueries = 3\nmrr = 0.75\n[hit_rate]\n1 = 0.5\n" + fused), ("g", "cases = 4\nmean_f1 = 0.9\n")], "path string, text string")
    assert {tuple(r) for r in suites.baselines(rows).collect()} == {
        ("a", "ir", None, "queries", 3.0), ("a", "ir", None, "mrr", 0.75), ("a", "ir", None, "hit_1", 0.5), ("a", "fused", None, "union_hit_rate", 1.0), ("a", "fused", "code", "mrr", 0.5), ("a", "fused", "code", "hit_1", 0.25),
        ("g", "graph", None, "cases", 4.0), ("g", "graph", None, "mean_f1", 0.9),
    }
