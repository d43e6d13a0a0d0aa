"""An index that is kept and brought up: files, chunks, vectors, postings and facts of code, in immutable segments.

build() and bring_up() take the files as they are now (path, text, doc_type, language, mtime). bring_up() tells new, modified and deleted files
from the kept ones, and chunks, tokenises, embeds and parses the new and modified ones only; they become one more segment, together with the paths whose
rows of earlier segments are dead. A term's document frequency is a sum over segments: a segment has the counts of its own chunks less
those of the chunks it kills. So a segment's size follows what changed.
compact() makes one segment of all that is alive. Every step is one version of the folder (sources/versions.py): readers see
all of it or nothing, two writers can't mix, another session opens what one has built.

A segment's chunks are taken in blocks of some thousands; its runs (a term's places in a block) are dealt into folders by term, and a query reads those
of its terms. Postings name the chunk at each place; places whose path a later segment killed are left out when read. Nodes and edges of the code graph are joins over the facts of all files that are alive, so an unchanged file isn't parsed again.

Cases: paths are unique (of several rows of a path the one of latest mtime, then of largest hash, counts); null texts are empty and give no chunk;
files without chunks are kept in the manifest; rows without path are left out; empty tables give an empty index; bringing up a folder without an
index builds it; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodequery.functions import embed
from lodequery.operators import chunking, extraction, graph, incremental, lexical, retrieve, wiki
from lodequery.sources import versions

#: Changes when chunks, terms or vectors of equal texts do.
LOGIC = "1"
#: Changes when the tables do; an index of another layout is as none, and is built anew.
LAYOUT = 2
TABLES = {
    "files": "path string, mtime long, content_hash string, logic_version string, doc_type string, language string",
    "chunks": "path string, chunk_id string, ordinal int, chunker string, start_line int, end_line int, heading_path array<string>, symbol string, node_type string, qualname string, doc_type string, language string, text string",
    "vectors": "path string, chunk_id string, doc_type string, vector array<double>",
    "runs": "block long, term string, total long, ids array<string>, lens array<int>, places array<int>, tfs array<int>, bucket int",
    "postings": "path string, id string, len int, block long, place int",
    "df": "term string, n long, bucket int",
    "sizes": "chunks long, tokens long",
    "facts": extraction.FACTS,
    "gone": "path string",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


@dataclass
class Kept:
    """One version of an index."""

    spark: SparkSession
    at: str
    number: int
    segments: list[str]
    options: dict

    def every(self, table: str) -> DataFrame:
        """The rows of all segments, with _seg."""
        return versions.read(self.spark, self.at, table, self.segments, schema(table))

    def alive(self, table: str) -> DataFrame:
        """The rows of a table by path that no later segment has killed."""
        rows = self.every(table)
        return (versions.alive(rows, self.every("gone"), ["path"]) if len(self.segments) > 1 else rows).drop("_seg")

    @property
    def files(self) -> DataFrame:
        return self.alive("files")

    @property
    def chunks(self) -> DataFrame:
        return self.alive("chunks")

    @property
    def vectors(self) -> DataFrame:
        return self.alive("vectors")

    def lexical(self) -> lexical.Index:
        """Postings, terms, sizes, runs and the chunks that are alive, as lexical.best() and lexical.scored() take them."""
        sizes = self.every("sizes").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n"), (F.sum("tokens") / F.sum("chunks")).alias("avgdl"))
        counts = self.every("df").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        docs, runs = self.alive("postings").drop("path"), self.every("runs").where("term is not null").select("block", "term", "places", "tfs", "bucket")
        each = runs.select("block", "term", "bucket", F.explode(F.arrays_zip("places", "tfs")).alias("x")).select("block", F.col("x.places").alias("place"), "term", F.col("x.tfs").cast("long").alias("tf"), "bucket")
        return lexical.Index(each.join(docs, ["block", "place"]).select("id", "len", "term", "tf", "bucket"), lexical.weighted(counts, sizes), sizes, runs, docs)

    def graph(self, most: int = 2) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the code among the files."""
        docs = self.files.select("path", "doc_type", "language")
        texts = self.chunks.where("doc_type = 'doc'").select(F.col("path").alias("doc_id"), "text")
        return extraction.joined(docs, self.alive("facts"), texts, most)


def opened(spark: SparkSession, at: str) -> Kept | None:
    """The index as it is now; None where there is none."""
    number, state = versions.last(spark, at)
    return Kept(spark, at, number, state["segments"], state["options"]) if state.get("layout") == LAYOUT else None


def current(files: DataFrame) -> DataFrame:
    """The files with their state, one row a path. Texts are shuffled only where paths repeat."""
    text = F.coalesce("text", F.lit(""))
    rows = files.where("path is not null").select("path", F.col("mtime").cast("long").alias("mtime"), F.sha2(text, 256).alias("content_hash"), F.lit(LOGIC).alias("logic_version"), "doc_type", "language", text.alias("text"))
    if not lexical.repeats(rows, "path"):
        return rows
    last = F.max_by(F.struct(*rows.columns), F.struct(F.coalesce("mtime", F.lit(-(2**63))), "content_hash"))
    return rows.groupBy("path").agg(last.alias("x")).select("x.*")


def _written(kept: Kept | None, spark: SparkSession, at: str, seen: int, fresh: DataFrame, gone: DataFrame, segments: list[str], options: dict) -> Kept:
    """Writes the fresh files, and what follows from them, as a segment that kills the gone paths, and commits it after `segments`."""
    seg = versions.new_segment(seen)
    put = lambda rows, table, *by: versions.write(rows.select(schema(table).fieldNames()), at, table, seg, *by)
    own = lambda table: versions.read(spark, at, table, [seg], schema(table)).drop("_seg")
    put(gone.select("path").distinct(), "gone")
    put(fresh, "files")
    texts = fresh.select(F.col("path").alias("doc_id"), "text", "doc_type", "language")
    chunks = chunking.chunked(texts, options["size"], options["overlap"], options["most_tokens"], carried=("doc_type", "language"))
    put(chunks.withColumnRenamed("id", "path"), "chunks")
    if options["vectors"]:
        put(embed.hashed(own("chunks").select("path", "chunk_id", "doc_type", "text")).drop("text"), "vectors")
    else:
        put(own("chunks").select("path", "chunk_id", "doc_type", F.lit(None).cast("array<double>").alias("vector")).where("false"), "vectors")
    put(extraction.facts(fresh), "facts")
    put(lexical.dealt(lexical.runs(own("chunks"), "chunk_id", first=(seen + 1) << 48)), "runs", "bucket")
    told = own("runs").where(F.col("term").isNull() & (F.col("bucket") == lexical.bucket_of(F.lit(None).cast("string"))))
    told = told.select("block", F.posexplode(F.arrays_zip("ids", "lens")).alias("place", "x"))
    put(told.select(F.regexp_replace("x.ids", "#[0-9]+$", "").alias("path"), F.col("x.ids").alias("id"), F.col("x.lens").alias("len"), "block", "place"), "postings")
    count = lambda rows, sign: rows.where("term is not null").groupBy("term").agg((sign * F.sum("total")).alias("n"))
    size = lambda rows, sign: rows.agg((sign * F.count("*")).alias("chunks"), (sign * F.coalesce(F.sum("len"), F.lit(0))).alias("tokens"))
    term_n, sizes = count(own("runs"), 1), size(own("postings"), 1)
    if kept is not None and segments:  # what the killed chunks had; changed texts alone are tokenised again
        dead = lambda table: kept.alive(table).join(own("gone"), "path", "left_semi")
        term_n = term_n.unionByName(count(lexical.runs(dead("chunks"), "chunk_id"), -1)).groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")
        sizes = sizes.unionByName(size(dead("postings"), -1)).agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens"))
    put(lexical.dealt(term_n), "df", "bucket")
    put(sizes, "sizes")
    versions.committed(spark, at, seen, {"segments": [*segments, seg], "options": options, "layout": LAYOUT})
    return opened(spark, at)


def build(files: DataFrame, at: str, size: int = 1600, overlap: int = 200, most_tokens: int = 8191, vectors: bool = True) -> Kept:
    """The index of the files, in place of what was there."""
    spark = files.sparkSession
    seen, _ = versions.last(spark, at)
    nothing = spark.createDataFrame([], schema("gone"))
    return _written(None, spark, at, seen, current(files), nothing, [], {"size": size, "overlap": overlap, "most_tokens": most_tokens, "vectors": vectors, "runs": 0})


def bring_up(files: DataFrame, at: str, reconcile_every: int = 0, **options) -> tuple[Kept, dict]:
    """The index after a run over the files as they are now, and how many paths were new, modified, deleted and unchanged.

    Without an index, and at the last of every `reconcile_every` runs (0: never), all is built anew with the kept options.
    """
    spark = files.sparkSession
    kept = opened(spark, at)
    now = current(files)
    if kept is None:
        made = build(files, at, **options)
        return made, {"new": made.files.count(), "modified": 0, "deleted": 0, "unchanged": 0}
    classes = incremental.classified(kept.files.select("path", "mtime", "content_hash", "logic_version"), now).persist()  # texts are hashed once for it
    try:
        return _brought_up(kept, now, classes, reconcile_every)
    finally:
        classes.unpersist()


def _brought_up(kept: Kept, now: DataFrame, classes: DataFrame, reconcile_every: int) -> tuple[Kept, dict]:
    spark, at = kept.spark, kept.at
    counts = incremental.counters(classes).first().asDict()
    if not counts["new"] + counts["modified"] + counts["deleted"] and not reconcile_every:
        return kept, counts
    runs = kept.options["runs"] + 1
    if reconcile_every and runs >= reconcile_every:
        return build(now, at, **{k: v for k, v in kept.options.items() if k != "runs"}), counts
    fresh = now.join(classes.where("class in ('new', 'modified')").select("path"), "path", "left_semi")
    gone = classes.where("class in ('modified', 'deleted')").select("path")
    return _written(kept, spark, at, kept.number, fresh, gone, kept.segments, kept.options | {"runs": runs}), counts


def compact(spark: SparkSession, at: str) -> Kept:
    """The same index with one segment; nothing is chunked, tokenised, embedded or parsed again."""
    kept = opened(spark, at)
    seg = versions.new_segment(kept.number)
    for table in ("files", "chunks", "vectors", "facts", "postings"):
        versions.write(kept.alive(table), at, table, seg)
    runs = kept.every("runs").where("term is not null").select("block", "term", "total", "places", "tfs")
    runs = lexical.thinned(runs, kept.alive("postings")) if len(kept.segments) > 1 else runs
    none = {c: F.lit(None).cast(t) for c, t in (("ids", "array<string>"), ("lens", "array<int>"))}  # postings have the chunks of places
    versions.write(lexical.dealt(runs.withColumns(none).select("block", "term", "total", "ids", "lens", "places", "tfs")), at, "runs", seg, "bucket")
    versions.write(lexical.dealt(kept.every("df").groupBy("term").agg(F.sum("n").alias("n")).where("n > 0")), at, "df", seg, "bucket")
    versions.write(kept.every("sizes").agg(F.sum("chunks").alias("chunks"), F.sum("tokens").alias("tokens")), at, "sizes", seg)
    versions.write(spark.createDataFrame([], schema("gone")), at, "gone", seg)
    versions.committed(spark, at, kept.number, {"segments": [seg], "options": kept.options, "layout": LAYOUT})
    return opened(spark, at)


def swept(spark: SparkSession, at: str) -> int:
    """Deletes segments that the last version doesn't use."""
    return versions.swept(spark, at, list(TABLES))


def search(kept: Kept, queries: DataFrame, k: int, doc_type: str | None = None) -> DataFrame:
    """query_id, id, score, rank: BM25 over the kept chunks for queries (query_id, query), of one doc_type where it is given."""
    keep = None if doc_type is None else kept.chunks.where(F.col("doc_type") == doc_type).select(F.col("chunk_id").alias("id"), F.lit("").alias("flow"))
    return lexical.ranked(lexical.best(kept.lexical(), queries, max(k, 0), keep).select("query_id", "id", "score"), k)


class Absent(LookupError):
    """There is no index in the folder."""


def existing(spark: SparkSession, at: str) -> Kept:
    """The index as it is now; Absent where there is none, before anything is asked of it."""
    kept = opened(spark, at)
    if kept is None:
        raise Absent(f"no index in {at}")
    return kept


def nearest(kept: Kept, queries: DataFrame, k: int, doc_type: str | None = None) -> DataFrame:
    """query_id, id, score, rank: cosine over the kept vectors for queries (query_id, query), of one doc_type where it is given."""
    rows = kept.vectors if doc_type is None else kept.vectors.where(F.col("doc_type") == doc_type)
    asked = embed.hashed(queries.select("query_id", F.col("query").alias("text"))).select("query_id", "vector")
    return retrieve.dense(rows.select("chunk_id", "vector"), asked, k, "chunk_id", "vector")


def hybrid(kept: Kept, queries: DataFrame, k: int, doc_type: str | None = None, pool: int = 30, least: float | None = None, dedup: bool = True) -> DataFrame:
    """Both searches of a kept index, fused as retrieve.hybrid() does; the index must have been built with vectors."""
    if not kept.options["vectors"]:
        raise ValueError("the index was built without vectors")
    entries = kept.chunks.select(F.col("chunk_id").alias("id"), "text")
    return retrieve.hybrid(search(kept, queries, pool, doc_type), nearest(kept, queries, pool, doc_type), entries, k, pool, least=least, dedup=dedup)


def build_pages(files: DataFrame, at: str, enabled: bool = True, **options) -> Kept | None:
    """The Markdown pages of a tree (rel_path, text) as an index of their own, built anew; nothing is read or written where it is not enabled."""
    if not enabled:
        return None
    pages = wiki.linkable(files)
    none = F.lit(None)
    mtime = F.col("mtime") if "mtime" in files.columns else none
    return build(pages.select(F.col("rel_path").alias("path"), "text", F.lit("doc").alias("doc_type"), F.lit("markdown").alias("language"), mtime.cast("long").alias("mtime")), at, **options)
