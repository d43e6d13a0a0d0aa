"""A kept index stores runs of blocks: how chunks and runs are made, what a compaction leaves, and that searches are those of all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodequery.operators import chunking, index, lexical
from lodequery.sources import versions


def files(spark, n, word="old", mtime=1):
    rows = [(f"d{i}.md", f"# Head {i}\n{word} alpha w{i % 7}\n## Sub\nbeta beta w{i % 3} {'a_b' if i % 5 == 0 else ''}", "doc", "markdown", mtime) for i in range(n)]
    return spark.createDataFrame(rows, "path string, text string, doc_type string, language string, mtime long")


def test_documents_are_chunked_where_they_are_read(spark):
    docs = files(spark, 5).withColumnRenamed("path", "doc_id")
    for made in (chunking.markdown_sections(docs), chunking.chunked(docs), lexical.runs(docs, first=0)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    text = "　\n# One \n####### no\n#\x1c\n### Three\x85\n## Two\n# \nend"
    got = chunking.markdown_sections(spark.createDataFrame([(1, text), (2, " \n\x1f"), (3, None)], "doc_id int, text string")).orderBy("id", "ordinal").collect()
    assert [(r["id"], r["ordinal"], r["level"], r["heading"], r["heading_path"], r["start_line"], r["end_line"]) for r in got] == [
        (1, 0, 1, "One", ["One"], 2, 4), (1, 1, 3, "Three", ["One", "Three"], 5, 5), (1, 2, 2, "Two", ["One", "Two"], 6, 8), (2, 0, 0, None, [], 1, 2),
    ]


def test_searches_of_runs_are_those_of_all_pairs(spark, tmp_path):
    at = f"file://{tmp_path}/i"
    index.build(files(spark, 40), at, vectors=False)
    now = files(spark, 40).where("substr(path, 2, 1) <> '3'").unionByName(files(spark, 6, "new", 2).withColumn("path", F.concat(F.lit("n/"), "path")))
    now = now.where("path not in ('d1.md', 'd2.md')").unionByName(files(spark, 3, "changed", 3).where("path <> 'd0.md'"))
    kept, _ = index.bring_up(now, at)
    asked = spark.createDataFrame([(1, "alpha w3"), (2, "old a_b"), (3, "changed beta"), (4, "nothing"), (5, "w1 w1")], "query_id long, query string")
    found = lambda rows: sorted(tuple(r) for r in rows.select("query_id", "id", "score", "rank").collect())
    for step in (kept, index.compact(spark, at)):
        pairs = found(lexical.ranked(lexical.scored(step.lexical(), asked), 7))
        plain = found(lexical.bm25(step.chunks, asked, 7, "chunk_id"))
        assert pairs == plain and found(index.search(step, asked, 7)) == plain and len(plain) > 20
    # a row for each term and block, not for each chunk; what was killed has no place any more
    own = versions.read(spark, at, "runs", index.opened(spark, at).segments, index.schema("runs")).where("term is not null")
    assert own.groupBy("block", "term").count().where("count > 1").count() == 0
    places = own.select("block", F.explode("places").alias("place"))
    assert places.join(index.opened(spark, at).alive("postings"), ["block", "place"], "left_anti").count() == 0
    assert own.agg(F.sum("total")).first()[0] == places.count()


def test_an_index_of_an_older_layout_is_built_anew(spark, tmp_path):
    at = f"file://{tmp_path}/i"
    kept = index.build(files(spark, 3), at, vectors=False)
    versions.committed(spark, at, kept.number, {"segments": kept.segments, "options": kept.options})
    assert index.opened(spark, at) is None
    made, counts = index.bring_up(files(spark, 3), at, vectors=False)
    assert counts["new"] == 3 and made.segments != kept.segments
