"""Files are parsed once for nodes and edges, and not in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodequery.operators import extraction


def test_files_are_parsed_once_and_by_several_tasks(spark):
    rows = [(f"p{i}.py", f"def f{i}():\n    f{i + 1}()\n", "code", "python") for i in range(30)] + [("a.md", "f3 says", "doc", "markdown"), ("n.py", None, "code", "python")]
    docs = spark.createDataFrame(rows, "path string, text string, doc_type string, language string").coalesce(1)
    assert extraction.facts(docs).select(F.spark_partition_id().alias("p")).distinct().count() > 1
    nodes, edges = extraction.extracted(docs)
    for made in (nodes, edges):
        assert "MapInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert nodes.count() == 62
    assert {(r["source"], r["target"]) for r in edges.where("type = 'calls'").collect()} == {(f"p{i}.py::f{i}", f"p{i + 1}.py::f{i + 1}") for i in range(29)}
