"""Hygiene of a tree of linked Markdown pages: inventory, lint, debt of undistilled names, pending work, ritual checks.

Pages are rows (rel_path, text). Null texts read as empty ones; an empty table gives empty results; a path that repeats
counts as one page for links and is listed as often as it is there; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions import wiki as W
from lodequery.functions.text import excluded

#: Fields that a page's frontmatter must have.
REQUIRED = ("title", "type")


def pages(files: DataFrame, index: str = "index.md", log: str = "log.md", log_dir: str = "log") -> DataFrame:
    """Content pages of all files: .md but the root's index and log and the folder of log partitions."""
    head = F.element_at(F.split("rel_path", "/"), 1)
    return linkable(files).where(~F.col("rel_path").isin(index, log) & (head != log_dir))


def linkable(files: DataFrame) -> DataFrame:
    """All files that a link can point at: every .md."""
    return files.where(F.endswith("rel_path", F.lit(".md")))


def audit_corpus(files: DataFrame, index: str = "index.md") -> DataFrame:
    """The files an audit reads: every .md but the root's index; log partitions stay."""
    return linkable(files).where(F.col("rel_path") != index)


def inventory(files: DataFrame, areas: dict[str, str]) -> DataFrame:
    """A row of metadata for each page."""
    fields = files.select("rel_path", "text", W.frontmatter(F.col("text")).alias("f"))
    value = lambda k: W.scalar(F.col("f"), k).alias(k)
    tags = F.filter(F.coalesce(F.try_element_at("f", F.lit("tags"))["values"], F.array().cast("array<string>")), lambda x: x != "")
    return fields.select(
        "rel_path", W.area(F.col("rel_path"), areas).alias("area"), value("type"), value("title"), value("status"), tags.alias("tags"),
        W.has_frontmatter(F.col("text")).alias("frontmatter_present"), W.wikilinks(F.col("text")).alias("wikilinks"),
    )


def targets(page_rows: DataFrame, linkable_rows: DataFrame) -> DataFrame:
    """alias and the path it stands for: a page before other files, and of several the first by path."""
    forms = lambda rows, rank: rows.select(F.explode(W.aliases(F.col("rel_path"))).alias("alias"), F.lit(rank).alias("rank"), "rel_path")
    both = forms(page_rows, 0).unionByName(forms(linkable_rows, 1))
    return both.groupBy("alias").agg(F.min(F.struct("rank", "rel_path"))["rel_path"].alias("target_path"))


def links(files: DataFrame) -> DataFrame:
    """A row (rel_path, target, place) for each distinct wikilink of a file, place by first appearance."""
    return files.select("rel_path", F.posexplode(W.wikilinks(F.col("text"))).alias("place", "target"))


def resolved(link_rows: DataFrame, target_rows: DataFrame) -> DataFrame:
    """Links with the path their target stands for; null where there is none."""
    return link_rows.join(target_rows.withColumnRenamed("alias", "target"), "target", "left").select("rel_path", "target", "place", "target_path")


def lint(files: DataFrame, index: str = "index.md", required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """rel_path, finding and detail: broken-link (the target), orphan, missing-frontmatter (the fields), stub.

    A page is no orphan if another page or the index links to it.
    """
    own = pages(files, index)
    to = targets(own, linkable(files))
    page_links = resolved(links(own), to)
    index_links = resolved(links(files.where(F.col("rel_path") == index)), to)
    referenced = page_links.where("target_path <> rel_path").select("target_path").union(index_links.select("target_path")).where("target_path is not null").distinct()
    fields = own.select("rel_path", W.frontmatter(F.col("text")).alias("f"))
    lack = W.missing_required(F.col("f"), required)
    rows = lambda df, finding, detail: df.select("rel_path", F.lit(finding).alias("finding"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    return (
        rows(page_links.where("target_path is null"), "broken-link", F.col("target"))
        .unionByName(rows(own.join(referenced, own["rel_path"] == referenced["target_path"], "left_anti"), "orphan", none))
        .unionByName(rows(fields.where(F.size(lack) > 0), "missing-frontmatter", F.array_join(lack, ",")))
        .unionByName(rows(fields.where(F.lower(W.stripped(W.scalar(F.col("f"), "status"))) == "stub"), "stub", none))
    )


def validated(page_rows: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """rel_path, the required fields a page lacks and whether its name breaks the rule, of pages with either fault."""
    out = page_rows.select("rel_path", W.missing_required(W.frontmatter(F.col("text")), required).alias("missing"), (~W.is_kebab(F.col("rel_path"))).alias("bad_name"))
    return out.where((F.size("missing") > 0) | F.col("bad_name"))


def reconciled(page_rows: DataFrame) -> DataFrame:
    """Pages whose status is superseded: rel_path, updated, superseded_by."""
    f = page_rows.select("rel_path", W.frontmatter(F.col("text")).alias("f"))
    value = lambda k: W.scalar(F.col("f"), k)
    return f.where(F.lower(W.stripped(value("status"))) == "superseded").select("rel_path", value("updated").alias("updated"), value("superseded_by").alias("superseded_by"))


def distill_audit(files: DataFrame, threshold: int = 2, index: str = "index.md", stopwords: tuple[str, ...] = W.STOPWORDS) -> DataFrame:
    """Names without a page that `threshold` files or more refer to by a link or as an identifier in inline code.

    norm, points (number of files), signal (wikilink, prose or both), sample_refs (the first three files), in order
    of falling points, then name. Counts are partly aggregated and only three files a name are ever gathered.
    """
    corpus = audit_corpus(files, index)
    named = corpus.select("rel_path", F.explode(W.wikilinks(F.col("text"))).alias("name"), F.lit("wikilink").alias("signal"))
    named = named.unionByName(corpus.select("rel_path", F.explode(W.prose_identifiers(F.col("text"), stopwords)).alias("name"), F.lit("prose").alias("signal")))
    named = named.select(W.normal_name(F.col("name")).alias("norm"), "rel_path", "signal").where((F.col("norm") != "") & ~F.col("norm").isin(*stopwords))
    homes = pages(files, index).select(W.normal_name(F.col("rel_path")).alias("norm")).distinct()
    points = named.join(homes, "norm", "left_anti").groupBy("norm", "rel_path").agg(F.min("signal").alias("a"), F.max("signal").alias("b"))
    totals = points.groupBy("norm").agg(F.count("*").alias("points"), F.min("a").alias("a"), F.max("b").alias("b")).where(F.col("points") >= threshold)
    first = points.withColumn("r", F.row_number().over(Window.partitionBy("norm").orderBy("rel_path"))).where("r <= 3")
    samples = first.groupBy("norm").agg(F.sort_array(F.collect_list("rel_path")).alias("sample_refs"))
    signal = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("both").alias("signal")
    return totals.join(samples, "norm").select("norm", "points", signal, "sample_refs").orderBy(F.desc("points"), "norm")


def in_scope(path: Column, sources: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Whether a path lies in one of the source folders and no segment below that folder is excluded."""
    inside = F.lit(False)
    for source in reversed(sources):
        base = source.strip("/")
        below = F.when(path == base, F.lit("")).when(F.startswith(path, F.lit(base + "/")), F.substring(path, F.lit(len(base) + 2), F.length(path)))
        inside = F.when(below.isNotNull(), ~excluded(below, exclude)).otherwise(inside)
    return inside


def coverage(logs: DataFrame) -> DataFrame:
    """Distinct (path, content_id) that any block of any log covers."""
    return logs.select(F.explode(W.covered_items(F.col("text"))).alias("c")).select("c.path", "c.content_id").distinct()


def pending(current: DataFrame, covered: DataFrame) -> DataFrame:
    """Rows (path, content_id) that no block covers as they are now."""
    return current.select("path", "content_id").join(covered, ["path", "content_id"], "left_anti")


def pending_by_clock(files: DataFrame, logs: DataFrame) -> DataFrame:
    """Files (path, mtime) newer than the newest log (mtime); all of them where there is no log."""
    anchor = logs.agg(F.max("mtime").alias("anchor"))
    return files.join(F.broadcast(anchor)).where(F.col("anchor").isNull() | (F.col("mtime") > F.col("anchor"))).select("path", "mtime")


def shown(paths: DataFrame, limit: int = 10) -> DataFrame:
    """The first `limit` paths and on each row the number of all and of those left out."""
    n = paths.agg(F.count("*").alias("pending"))
    return paths.orderBy("path").limit(limit).join(F.broadcast(n)).select("path", "pending", F.greatest(F.col("pending") - limit, F.lit(0)).alias("truncated"))


def legacy_entries(logs: DataFrame, today: str, log_format: str) -> DataFrame:
    """Logs (path, text, untracked) honoured without a block: today's, not yet delivered, with an entry and no block."""
    return logs.where((F.col("path") == today) & F.col("untracked") & ~W.has_block(F.col("text")) & W.has_entry(F.col("text"), log_format)).select("path")


def stale_recording(touched: DataFrame, today: str) -> DataFrame:
    """The last touched log that isn't today's, as one row; null where there is none."""
    return touched.where(F.col("path") != today).agg(F.max("path").alias("stale_recording"))


def perimeter(kind: str, sources: DataFrame) -> DataFrame:
    """kind, its sources (place, name, ref, paths) in order, and the scope's name derived from them."""
    one = sources.agg(F.array_sort(F.collect_list(F.struct("place", "name", "ref", "paths"))).alias("sources"))
    ref = F.coalesce(F.get(F.filter("sources", lambda x: x["name"] == "committed"), F.lit(0))["ref"], F.lit(""))
    suffix = F.when(F.exists("sources", lambda x: x["name"] == "worktree"), "+worktree").otherwise("")
    total = F.aggregate("sources", F.lit(0).cast("long"), lambda a, x: a + x["paths"])
    scope = F.concat(F.lit("explicit:"), total.cast("string")) if kind == "explicit" else F.concat(F.lit("git:"), ref, suffix)
    return one.select(F.lit(kind).alias("kind"), F.to_json("sources").alias("sources"), scope.alias("scope"))


def log_segments(logs: DataFrame) -> DataFrame:
    """Entries of logs (rel_path, text): day, entry (its number in the log, from 1) and text, begun by `## [yyyy-mm-dd]` lines.

    What stands before a log's first entry is left out. A log is one text, so its lines are one row's.
    """
    at = logs.select("rel_path", F.posexplode(W.lines_of(F.col("text"))).alias("n", "line"))
    day = F.regexp_extract("line", r"^## \[(\d{4}-\d{2}-\d{2})\]", 1)
    order = Window.partitionBy("rel_path").orderBy("n")
    at = at.withColumn("day", day).withColumn("entry", F.sum((F.col("day") != "").cast("long")).over(order)).where("entry > 0")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return at.groupBy("rel_path", "entry").agg(F.max("day").alias("day"), F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", "").alias("text"))


def partitions(segments: DataFrame) -> DataFrame:
    """One row a day: its entries' texts in order, parted by blank lines, and their number."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("rel_path", "entry", "text"))), lambda x: x["text"])
    return segments.groupBy("day").agg(F.count("*").alias("entries"), F.array_join(texts, "\n\n").alias("text"))


def new_cross_links(changed: DataFrame, base: DataFrame, target_rows: DataFrame) -> DataFrame:
    """Links between changed pages that their text at the base (rel_path, text) didn't have: rel_path, target, target_path."""
    fresh = links(changed).join(links(base).select("rel_path", "target"), ["rel_path", "target"], "left_anti")
    found = resolved(fresh, target_rows).where("target_path is not null and target_path <> rel_path")
    return found.join(changed.select(F.col("rel_path").alias("target_path")), "target_path", "left_semi").select("rel_path", "target", "target_path")


def distill_groups(cross: DataFrame, added: DataFrame, homes: tuple[str, ...], least: int = 2) -> DataFrame:
    """One row (pages, shared_new_backlinks) if `least` or more new cross links join two or more pages and no page was added to a home folder."""
    ends = cross.select(F.col("rel_path").alias("page")).union(cross.select("target_path")).distinct().agg(F.count("*").alias("pages"))
    new_home = added.where(F.element_at(F.split("rel_path", "/"), 1).isin(*homes)).agg((F.count("*") > 0).alias("distilled"))
    n = cross.agg(F.count("*").alias("shared_new_backlinks"))
    return ends.join(n).join(new_home).where((F.col("shared_new_backlinks") >= least) & (F.col("pages") >= 2) & ~F.col("distilled")).select("pages", "shared_new_backlinks")


def drift(changed: DataFrame, page_rows: DataFrame, target_rows: DataFrame, hub: int = 8) -> DataFrame:
    """rel_path, signal and detail of pages that a step may have left behind, one row a page.

    stale-updated: a changed page whose `updated` lies before the latest among changed pages.
    neighbor-of-change: an unchanged page that a changed page with at most `hub` links links to; the detail is the first such page.
    """
    dated = changed.select("rel_path", W.stripped(W.scalar(W.frontmatter(F.col("text")), "updated")).alias("updated")).where("updated <> ''")
    newest = dated.agg(F.max("updated").alias("newest"))
    stale = dated.join(F.broadcast(newest)).where("updated < newest").select("rel_path", F.lit("stale-updated").alias("signal"), F.concat_ws(" < ", "updated", "newest").alias("detail"))
    quiet = changed.where(F.size(W.wikilinks(F.col("text"))) <= hub)
    near = resolved(links(quiet), target_rows).where("target_path is not null")
    near = near.join(changed.select(F.col("rel_path").alias("target_path")), "target_path", "left_anti").join(page_rows.select(F.col("rel_path").alias("target_path")).distinct(), "target_path", "left_semi")
    near = near.groupBy("target_path").agg(F.min("rel_path").alias("detail"))
    return stale.unionByName(near.select(F.col("target_path").alias("rel_path"), F.lit("neighbor-of-change").alias("signal"), "detail"))
