"""Changes of a tree of pages as rows: moved pages with the links to them, log entries with what they cover, index rows.

An edit is a row (rel_path, begin, end, text): the characters of a page from begin (from 0) to end give way to text. Edits of a page don't overlap; they are
applied from the last to the first in one expression, so that places stay true. A dry run is the edits themselves.

Null texts are empty; paths are unique; moves of one batch have distinct sources and are made at once, from the tree as it was; where two sources share a form of
link it means the first by path; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodequery.functions import wiki as W
from lodequery.operators import wiki
from lodequery.sources import store

#: Links between pages, links to a path, how such a path begins that names no page, and the ends of a block of what is covered.
WIKILINK, PATH_LINK = r"\[\[([^\[\]|#]+)((?:[#|][^\[\]]*)?)\]\]", r"\]\(([^)]+)\)"
FOREIGN = r"^([#/<]|mailto:)|://"
OPENING, CLOSING = "<!-- covers/1", "-->"


def spans(text: Column, pattern: str) -> Column:
    """begin, end and text of all matches of a pattern, from what stands between them."""
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern)
    none = F.array().cast("array<struct<begin: int, end: int, text: string>>")
    # split and extract see the same matches, so the i-th match stands after the first i + 1 parts and i matches

    def place(done: Column, x: Column) -> Column:
        begin = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0)) + F.length(x["before"])
        return F.concat(done, F.array(F.struct(begin.alias("begin"), (begin + F.length(x["match"])).alias("end"), x["match"].alias("text"))))

    return F.aggregate(F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("before"), found.alias("match")), none, place)


def applied(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages (rel_path, text) with their edits made."""
    own = edits.groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("begin", "end", F.col("text").alias("new"))), asc=False).alias("e"))
    put = lambda done, x: F.concat(F.substring(done, F.lit(1), x["begin"]), x["new"], F.substring(done, x["end"] + 1, F.length(done)))
    rows = pages.join(own, "rel_path", "left")
    return rows.select("rel_path", F.when(F.col("e").isNull(), F.col("text")).otherwise(F.aggregate("e", F.coalesce("text", F.lit("")), put)).alias("text"))


def checked(files: DataFrame, moves: DataFrame) -> DataFrame:
    """src, dest and status of moves (src, dest): moved; recovered (the page lies at its destination already, its links are brought up); collision (both are
    there); missing (neither is); invalid (a path that is no .md below the root)."""
    known = files.select("rel_path").distinct()
    at = lambda rows, c: rows.join(known.select(F.col("rel_path").alias(c), F.lit(True).alias(f"_{c}")), c, "left")
    clean = lambda c: F.trim(F.replace(F.col(c), F.lit("\\"), F.lit("/")))
    rows = at(at(moves.select(clean("src").alias("src"), clean("dest").alias("dest")), "src"), "dest")
    bad = lambda c: F.col(c).isNull() | ~F.endswith(c, F.lit(".md")) | F.startswith(c, F.lit("/")) | F.array_contains(F.split(c, "/"), "..")
    status = F.when(bad("src") | bad("dest"), "invalid").when(F.col("_src") & F.col("_dest") & (F.col("src") != F.col("dest")), "collision")
    return rows.select("src", "dest", status.when(F.col("_src"), "moved").when(F.col("_dest"), "recovered").otherwise("missing").alias("status"))


def move_edits(files: DataFrame, moves: DataFrame, index: str = "index.md") -> DataFrame:
    """Edits of the pages and the index (not of log partitions, which are history) that make links to moved pages point at where they go.

    A wikilink keeps its form (path, path without .md, file name) and what follows # or |, and the backslash before it; a relative link keeps its #part.
    """

    @F.pandas_udf(StringType())
    def meant(page: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([posixpath.normpath(posixpath.join(posixpath.dirname(p), b)) for p, b in zip(page, base, strict=True)], dtype=object)

    @F.pandas_udf(StringType())
    def relative(dest: pd.Series, page: pd.Series) -> pd.Series:
        return pd.Series([posixpath.relpath(d, posixpath.dirname(p) or ".") for d, p in zip(dest, page, strict=True)], dtype=object)

    good = checked(files, moves).where(F.col("status").isin("moved", "recovered")).select("src", "dest")
    texts = wiki.pages(files, index).unionByName(files.where(F.col("rel_path") == index)).select("rel_path", F.coalesce("text", F.lit("")).alias("text"))
    form = lambda c: F.array(F.col(c), W.without_md(F.col(c)), W.without_md(W.name_of(F.col(c))))
    forms = good.select("src", F.explode(F.arrays_zip(form("src").alias("target"), form("dest").alias("new"), F.array(F.lit(0), F.lit(-1), F.lit(-2)).alias("rank"))).alias("x"))
    forms = forms.groupBy("x.target").agg(F.min_by("x.new", F.struct("src", "x.rank")).alias("new"))
    links = texts.select("rel_path", F.explode(spans(F.col("text"), WIKILINK)).alias("x")).select("rel_path", "x.*")
    written = W.stripped(F.regexp_extract("text", WIKILINK, 1))  # in a table it may end in the backslash that guards the |
    links = links.withColumn("target", W.stripped(F.regexp_replace(written, r"\\+$", ""))).join(forms, "target")
    first = links.select("rel_path", "begin", "end", F.concat(F.lit("[["), "new", F.regexp_extract(written, r"(\\*)$", 1), F.regexp_extract("text", WIKILINK, 2), F.lit("]]")).alias("text"))
    own = texts.select("rel_path", F.explode(spans(F.col("text"), PATH_LINK)).alias("x")).select("rel_path", "x.*", W.stripped(F.regexp_extract("x.text", PATH_LINK, 1)).alias("raw"))
    base = F.substring_index("raw", "#", 1)
    own = own.where(~F.rlike("raw", F.lit(FOREIGN)) & (base != "")).withColumn("src", meant("rel_path", base)).join(good, "src")
    part = F.substring(F.col("raw"), F.length(base) + 1, F.length("raw"))
    second = own.select("rel_path", "begin", "end", F.concat(F.lit("]("), relative("dest", "rel_path"), part, F.lit(")")).alias("text"))
    return first.unionByName(second)


def moved(files: DataFrame, moves: DataFrame, index: str = "index.md") -> DataFrame:
    """The tree (rel_path, text) after the moves and the edits they bring."""
    rows = applied(files.select("rel_path", "text"), move_edits(files, moves, index))
    names = checked(files, moves).where("status = 'moved'").select(F.col("src").alias("rel_path"), "dest")
    return rows.join(names, "rel_path", "left").select(F.coalesce("dest", "rel_path").alias("rel_path"), "text")


# ---- logs --------------------------------------------------------------------------------------

ENTRIES = "day string, heading string, body string, covers array<struct<path: string, content_id: string>>, number long"


def entries(spark: SparkSession, at: str) -> DataFrame:
    """The log kept at a path: day, heading, body, covers (what was pending as the entry was written) and number, in the order of writing."""
    return store.kept(spark, at, spark.createDataFrame([], ENTRIES))


def appended(new: DataFrame, at: str, current: DataFrame) -> int:
    """Appends entries (day, op, title, body and, where several come at once, place) whose heading their day doesn't have; how many.

    The first of them covers the rows of current (path, content_id) that no entry covers yet, so that entries of one day compose. Of two
    writers the later looks again at what the first has left: an entry is there once, and nothing is covered twice.
    """
    spark, counts = new.sparkSession, []
    place = F.col("place").cast("int") if "place" in new.columns else F.lit(0)
    heading = F.concat(F.lit("## ["), "day", F.lit("] "), "op", F.lit(" | "), "title")
    rows = new.select("day", F.trim(heading).alias("heading"), W.stripped(F.coalesce("body", F.lit(""))).alias("body"), place.alias("_z"))
    rows = rows.groupBy("day", "heading").agg(F.min(F.struct("_z", "body")).alias("x")).select("day", "heading", "x.body", F.col("x._z").alias("_z"))

    def make(known: DataFrame) -> DataFrame:
        fresh = rows.join(known.select("day", "heading"), ["day", "heading"], "left_anti")
        done = known.select(F.explode("covers").alias("c")).select("c.path", "c.content_id")
        left = wiki.pending(current, done).agg(F.array_sort(F.collect_set(F.struct("path", "content_id"))).alias("left"))  # the work of one session
        begin = known.agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]
        found = fresh.orderBy("day", "_z", "heading").coalesce(1).withColumn("number", F.monotonically_increasing_id() + begin + 1)
        out = found.join(left).select("day", "heading", "body", F.when(F.col("number") == begin + 1, F.col("left")).otherwise(F.slice("left", 1, 0)).alias("covers"), "number")
        counts.append(fresh.count())
        return out

    store.inserted_by(spark, at, entries(spark, at), make)
    return counts[-1]


def covers_block(covers: Column) -> Column:
    """The block that tells what an entry covers; empty for nothing."""
    lines = F.array_join(F.transform(covers, lambda c: F.concat(c["path"], F.lit("@"), c["content_id"])), "\n")
    return F.when(F.size(covers) == 0, "").otherwise(F.concat(F.lit(f"{OPENING}\n"), lines, F.lit(f"\n{CLOSING}")))


def partitions(kept: DataFrame, folder: str = "log") -> DataFrame:
    """rel_path and text of the daily files of a log: entries parted by a blank line, each with its body and its block."""
    text = F.array_join(F.filter(F.array("heading", "body", covers_block(F.col("covers"))), lambda x: x != ""), "\n\n")
    days = kept.select("day", "number", text.alias("t")).groupBy("day").agg(F.array_sort(F.collect_list(F.struct("number", "t"))).alias("x"))
    body = F.concat(F.array_join(F.transform("x", lambda x: x["t"]), "\n\n"), F.lit("\n"))
    return days.select(F.concat(F.lit(f"{folder}/"), "day", F.lit(".md")).alias("rel_path"), body.alias("text"))


def log_index(kept: DataFrame) -> DataFrame:
    """One row with the text of the list of all days, sorted."""
    days = kept.select("day").distinct().agg(F.sort_array(F.collect_set("day")).alias("d"))
    lines = F.transform("d", lambda x: F.concat(F.lit("- ["), x, F.lit("]("), x, F.lit(".md)\n")))
    return days.select(F.concat(F.lit("# Log Index\n\nDaily partitions (chronological):\n\n"), F.array_join(lines, "")).alias("text"))


def index_rows(pages: DataFrame, at: str, by: tuple[str, ...] = ("rel_path",)) -> DataFrame:
    """The index kept at a path, a line for each page, after pages (rel_path, line) took the place of those they have there.

    by: the columns that tell pages apart, where several pages have one path.
    """
    rows = pages.select(*dict.fromkeys((*by, "rel_path", "line")))
    return store.upserted(rows, at, list(by)).select("rel_path", "line")
