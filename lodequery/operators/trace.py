"""From unified diffs to evidence, requirements, checked anchors and drift, for batches of changesets.

A changeset is a row (ref, text). Files, hunks and evidence items are numbered from 0 within their changeset in
the order of the diff. Null and empty texts have no files; empty tables give empty results; a ref that repeats is
refused by no operator and its diffs' lines mix, so refs must be unique; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions import diff as D

#: The kinds of requirement that each evidence item should have.
QUOTAS = ("user_capability", "behaviour", "implementation")

snippet = D.snippet


def diff_lines(changesets: DataFrame) -> DataFrame:
    """Lines with their kind, file and hunk number; what stands before the first file is left out."""
    rows = changesets.select("ref", F.posexplode(D.lines_of(F.col("text"))).alias("n", "line")).withColumn("kind", D.line_kind(F.col("line")))
    count = lambda kind, *by: F.sum((F.col("kind") == kind).cast("int")).over(Window.partitionBy(*by).orderBy("n")).cast("int")
    rows = rows.withColumn("file", count("file", "ref") - 1).where("file >= 0")
    return rows.withColumn("hunk", count("hunk", "ref", "file") - 1)


def diff_files(lines: DataFrame) -> DataFrame:
    """ref, file, path, old_path (of renames), change_type and is_binary."""
    has = lambda kind: F.max(F.col("kind") == kind)
    real = lambda kind: (F.col("kind") == kind) & (D.named(F.col("line"), kind) != "/dev/null")
    last = lambda *kinds: F.max_by(F.coalesce(*(F.when(real(k), D.named(F.col("line"), k)) for k in kinds)), F.when(real(kinds[0]) | real(kinds[-1]), F.col("n")))
    old = F.coalesce(last("rename_from"), F.min_by(F.when(real("minus"), D.named(F.col("line"), "minus")), F.when(real("minus"), F.col("n"))))
    out = lines.groupBy("ref", "file").agg(last("rename_to", "plus").alias("path"), old.alias("old"), *(has(k).alias(f"_{k}") for k in ("rename_from", "rename_to", "new", "deleted", "binary")))
    renamed = F.col("_rename_from") | F.col("_rename_to")
    kind = F.when(renamed, "renamed").when(F.col("_new"), "added").when(F.col("_deleted"), "deleted").otherwise("modified")
    return out.select("ref", "file", F.coalesce("path", "old", F.lit("")).alias("path"), F.when(renamed, F.col("old")).alias("old_path"), kind.alias("change_type"), F.col("_binary").alias("is_binary"))


def diff_hunks(lines: DataFrame, files: DataFrame) -> DataFrame:
    """ref, file, hunk, path, ranges, body lines and the distinct names declared, by first appearance; binary files have none."""
    heads = lines.where("kind = 'hunk'").select("ref", "file", "hunk", *(c.alias(name) for name, c in D.ranges(F.col("line")).items()))
    own = D.names_in(F.col("line"), F.col("kind"))
    inside = lines.where("hunk >= 0 and kind in ('hunk', 'body')").select("ref", "file", "hunk", F.struct("n", "kind", "line", own.alias("names")).alias("x"))
    rows = inside.groupBy("ref", "file", "hunk").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.transform(F.filter("x", lambda r: r["kind"] == "body"), lambda r: r["line"])
    rows = rows.select("ref", "file", "hunk", body.alias("lines"), F.array_distinct(F.flatten(F.transform("x", lambda r: r["names"]))).alias("identifiers"))
    return rows.join(heads, ["ref", "file", "hunk"]).join(files.where("not is_binary").select("ref", "file", "path"), ["ref", "file"])


def read_diffs(changesets: DataFrame, whole: bool = True) -> DataFrame:
    """What diff_files and diff_hunks say of each changeset as one row, ref and files (diff.files_of), read where it lies: no line of it is shuffled."""
    return changesets.select("ref", D.files_of(F.col("text"), whole).alias("files"))


def read_files(diffs: DataFrame) -> DataFrame:
    """The files of read_diffs() as diff_files gives them."""
    return diffs.select("ref", F.explode("files").alias("f")).select("ref", *(f"f.{c}" for c in ("file", "path", "old_path", "change_type", "is_binary")))


def read_hunks(diffs: DataFrame) -> DataFrame:
    """The hunks of read_diffs() as diff_hunks gives them; of diffs that aren't whole with a snippet in place of lines."""
    return diffs.where("ref is not null").select("ref", F.explode("files").alias("f")).select("ref", "f.file", "f.path", F.explode("f.hunks").alias("h")).select("ref", "file", "h.*", "path")


def source_files(files: DataFrame, include_docs: bool = False) -> DataFrame:
    """Files with the reason they are left out; null for those that stay."""
    return files.withColumn("reason", D.excluded_reason(F.col("path"), include_docs))


def located(hunks: DataFrame, evidence: DataFrame, most: int = 4) -> DataFrame:
    """Symbols of each hunk: ref, file, hunk, place, path, name, symbol_path, line.

    evidence gives for (path, query) the symbols (name, symbol_path, line, place) found for it. A hunk
    looks up its identifiers; a symbol found twice for it counts where it comes first. Hunks without lines have a snippet.
    """
    queries = D.identifier_queries(F.col("identifiers"), snippet(F.col("lines")) if "lines" in hunks.columns else F.col("snippet"), most)
    asked = hunks.select("ref", "file", "hunk", "path", F.posexplode(queries).alias("q", "query"))
    rows = asked.join(evidence.withColumnRenamed("place", "e"), ["path", "query"])
    first = rows.groupBy("ref", "file", "hunk", "path", "name", "symbol_path", "line").agg(F.min(F.struct("q", "e")).alias("place"))
    return first.select("ref", "file", "hunk", F.col("place.q").alias("q"), F.col("place.e").alias("e"), "path", "name", "symbol_path", "line")


def merged(rows: DataFrame, *by: str) -> DataFrame:
    """Hunks (columns of diff_hunks) as one for each group: ranges span all, lines (if hunks have them) follow each other, names by first appearance."""
    long = [c for c in ("lines",) if c in rows.columns]
    end = lambda side: F.max(F.col(f"{side}_start") + F.greatest(F.col(f"{side}_len") - 1, F.lit(0)))
    rows = rows.groupBy(*by).agg(
        F.min("old_start").alias("old_start"), end("old").alias("old_end"), F.min("new_start").alias("new_start"), end("new").alias("new_end"), F.min("new_len").alias("least"), F.max("new_len").alias("new_len"),
        F.count("*").alias("hunks"), F.array_sort(F.collect_list(F.struct("hunk", *long, "identifiers"))).alias("x"),
    )
    one = F.col("hunks") == 1
    return rows.select(
        *by, "hunks", "old_start", "old_end", "new_start", F.when(one & (F.col("new_len") == 0), F.col("new_start")).otherwise(F.col("new_end")).alias("new_end"),
        *(F.flatten(F.transform("x", lambda h: h[c])).alias(c) for c in long), F.array_distinct(F.flatten(F.transform("x", lambda h: h["identifiers"]))).alias("identifiers"), F.col("x")[0]["hunk"].alias("first_hunk"),
    )


def evidence_items(hunks: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence items and unresolved hunks.

    A file's hunks are grouped by the symbols they have in that same file, in order of first appearance; those
    with new lines but no such symbol make one more item of granularity `hunk`; pure deletions stay unresolved.
    Items: ref, item, file, path, symbol, granularity, start_line, end_line, hunks, identifiers, lines (if hunks have them), cross
    (names of symbols in other files that the file's hunks found).
    """
    same = symbols.where("symbol_path = path").groupBy("ref", "file", "hunk", "name").agg(F.min(F.struct("q", "e")).alias("at"))
    cross = symbols.where("symbol_path <> path").groupBy("ref", "file").agg(F.array_sort(F.collect_set(F.concat_ws("@", "name", "symbol_path"))).alias("cross"))
    group = hunks.join(same.withColumnRenamed("name", "symbol"), ["ref", "file", "hunk"])
    first = group.groupBy("ref", "file", "path", "symbol").agg(F.min(F.struct("hunk", "at")).alias("at"))
    by_symbol = merged(group, "ref", "file", "path", "symbol").join(first, ["ref", "file", "path", "symbol"]).withColumn("granularity", F.lit("symbol"))
    rest = hunks.join(same.select("ref", "file", "hunk").distinct(), ["ref", "file", "hunk"], "left_anti")
    left = merged(rest.where("new_len > 0"), "ref", "file", "path").withColumn("symbol", F.lit(None).cast("string")).withColumn("at", F.lit(None).cast(first.schema["at"].dataType)).withColumn("granularity", F.lit("hunk"))
    rows = by_symbol.unionByName(left).join(cross, ["ref", "file"], "left")
    item = F.row_number().over(Window.partitionBy("ref").orderBy("file", F.col("granularity") == "hunk", "at")) - 1
    items = rows.withColumn("item", item).select(
        "ref", "item", "file", "path", "symbol", "granularity", F.col("new_start").alias("start_line"), F.col("new_end").alias("end_line"), "hunks", "identifiers", *(c for c in ("lines",) if c in rows.columns),
        F.coalesce("cross", F.array().cast("array<string>")).alias("cross"),
    )
    return items, rest.where("new_len = 0")


def placeholder_requirements(items: DataFrame, quotas: tuple[str, ...] = QUOTAS) -> DataFrame:
    """One requirement an item and quota: ref, id, quota, item, statement and the item's anchor."""
    target = F.coalesce("symbol", "path")
    rows = items.withColumn("quota", F.explode(F.array(*map(F.lit, quotas))))
    return rows.select("ref", F.concat(F.lit("REQ-"), F.lpad(F.col("item").cast("string"), F.greatest(F.length(F.col("item").cast("string")), F.lit(3)), F.lit("0")), F.lit("-"), "quota").alias("id"), "quota", "item", F.concat(F.lit("change in "), target, F.lit(" ("), "granularity", F.lit(")")).alias("statement"), "path", "symbol", "start_line", "end_line")


def strangers(requirements: DataFrame, items: DataFrame) -> DataFrame:
    """Requirements whose anchor is none of the bundle's; a lift with any is refused."""
    anchor = ["ref", "path", "start_line", "end_line"]
    own = items.select(*anchor, F.coalesce("symbol", F.lit("")).alias("_s")).distinct()
    return requirements.withColumn("_s", F.coalesce("symbol", F.lit(""))).join(own, [*anchor, "_s"], "left_anti").drop("_s")


def missing_quotas(items: DataFrame, requirements: DataFrame, quotas: tuple[str, ...] = QUOTAS) -> DataFrame:
    """ref, item, quota that an item with some requirement lacks; items without any are drift instead."""
    some = requirements.select("ref", "item").distinct()
    wanted = items.select("ref", "item").join(some, ["ref", "item"], "left_semi").withColumn("quota", F.explode(F.array(*map(F.lit, quotas))))
    return wanted.join(requirements.select("ref", "item", "quota"), ["ref", "item", "quota"], "left_anti")


def drift(items: DataFrame, unresolved: DataFrame, confirmed: DataFrame, more: bool = False) -> DataFrame:
    """What no confirmed requirement covers: items, and hunks without evidence, each with the lines it concerns.

    more adds granularity and place, a struct that orders items before hunks and each as the diff has them.
    """
    open_items = items.join(confirmed.select("ref", "item").distinct(), ["ref", "item"], "left_anti")
    line = F.when(F.col("new_start") == 0, F.col("old_start")).otherwise(F.col("new_start"))
    place = lambda what, a, b: F.struct(F.lit(what).alias("what"), a.cast("int").alias("a"), b.cast("int").alias("b")).alias("place")
    a = open_items.select("ref", F.lit("item").alias("what"), "path", "symbol", "start_line", "end_line", "granularity", place(0, F.col("item"), F.lit(0)))
    b = unresolved.select("ref", F.lit("hunk").alias("what"), "path", F.lit(None).cast("string").alias("symbol"), line.alias("start_line"), line.alias("end_line"), F.lit("hunk").alias("granularity"), place(1, F.col("file"), F.col("hunk")))
    return a.unionByName(b) if more else a.unionByName(b).drop("granularity", "place")


def verified(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """Anchors (anchor, path, start_line, end_line, symbol, test_path, covers) with whether the tree bears them out.

    lines: the tree's lines (path, n from 1, line). The file must have the lines, one of its lines the
    symbol, and one of the test's lines what the test covers. Joins are on paths and only counts come back.
    """
    sizes = lines.groupBy("path").agg(F.max("n").alias("size"))
    holds = lambda path, text: anchors.select("anchor", F.col(path).alias("path"), F.col(text).alias("_t")).where("path is not null and _t is not null").join(lines, "path").where(F.contains("line", F.col("_t"))).select("anchor").distinct()
    mark = lambda rows, name: rows.withColumn(name, F.lit(True))
    out = anchors.join(sizes, "path", "left").join(mark(holds("path", "symbol"), "_symbol"), "anchor", "left").join(mark(holds("test_path", "covers"), "_test"), "anchor", "left")
    ok = F.coalesce((F.col("start_line") >= 1) & (F.col("start_line") <= F.col("end_line")) & (F.col("end_line") <= F.col("size")), F.lit(False))
    ok &= (F.col("symbol").isNull() | F.col("_symbol").isNotNull()) & (F.col("test_path").isNull() | F.col("_test").isNotNull())
    return out.select("anchor", "path", "start_line", "end_line", "symbol", ok.alias("verified"))


def tests_of(hits: DataFrame) -> DataFrame:
    """Of ranked hits (symbol, rank, path, chunk_id) those in tests, the first of each path: symbol, test_path, name, chunk_id."""
    rows = hits.where(D.is_test_path(F.col("path"))).groupBy("symbol", F.col("path").alias("test_path")).agg(F.min_by("chunk_id", "rank").alias("chunk_id"))
    return rows.withColumn("name", F.regexp_replace(F.element_at(F.split("test_path", "/"), -1), r"(?<=.)\.[^.]*$", ""))
