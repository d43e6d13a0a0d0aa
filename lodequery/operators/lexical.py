"""BM25 retrieval for batches of queries over a stored index of postings.

Documents are taken in blocks of some thousands, as they are read. A block's postings are runs: a row for each of its terms, with the documents
that have it. Runs are shuffled once, into a folder for each bucket of terms, sorted by term. Statistics are sums by term with partial
aggregation. The buckets that a batch of queries has are filtered before the join, so other folders aren't read. No hot term gathers rows in
one task: the runs of the batch's terms are dealt by block, where every query's sums over the block's documents are one product of matrices
and only its k best are kept (best()); scored() gives all pairs.

An index lives in a versioned folder (sources/versions.py) whose name is that of the table's files and of what is taken of them: whichever session
asks first builds it, others that share the folder open it. index.py holds the form that is brought up by segments.

Null texts count as one empty token, as do texts without any; a document id that repeats counts as one document of several texts' postings; queries without tokens have
no hits; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodequery.functions.text import indexed_tokens, tokens
from lodequery.sources import store, versions

#: Fixed values of the Okapi form.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Folders that postings are dealt into by term.
BUCKETS = 32
#: Documents of a block at most.
BLOCK = 8192
#: What a text's bytes in lower case become before it is parted at spaces: all but the signs of tokens are spaces.
SIGNS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for c in range(256))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def dealt(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with a term, with its bucket, sorted by term; where there are more partitions than buckets, several tasks share a bucket of postings by id."""
    n = max(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = [c for c in ("id", "block") if c in rows.columns]
    by = ("bucket", F.pmod(F.xxhash64(own[0]), F.lit(4 * -(-n // buckets)))) if own else ("bucket",)  # four shares a bucket: hashes of buckets alone meet in one task
    return rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartition(n if len(by) > 1 else buckets, *by).sortWithinPartitions("bucket", "term")


def repeats(docs: DataFrame, id_: str) -> bool:
    """Whether an id has several rows."""
    return not docs.groupBy(id_).count().where("count > 1").isEmpty()


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, len (tokens of the document), term and tf for all rows; texts are shuffled by id, tokens aren't."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't made smaller: tokens are many times the text's rows
    rows = docs.select(F.col(id_).alias("id"), F.col(text).alias("text")).repartition(n, "id").select("id", indexed_tokens(F.col("text")).alias("t"))
    # explode_outer: every row has a token, and no filter on that, which would tokenise all texts once more, is put under the shuffle
    return rows.select("id", F.size("t").alias("len"), F.explode_outer("t").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def plain(text: bytes) -> bytes:
    """A text in lower case as its tokens, as functions.text.indexed_tokens() has them in another order, parted at spaces."""
    words = text.translate(SIGNS)
    if b"_" in words:
        words += b" " + b" ".join(part for w in words.split() if b"_" in w for part in w.split(b"_") if part)
    return words.strip()


def blocks(batch: pa.RecordBatch, most_rows: int = BLOCK, most_bytes: int = 2**25) -> Iterator[pa.RecordBatch]:
    """A batch (id, text) in slices of so many rows and about so many bytes of text at most."""
    ends, begin = np.cumsum(pc.binary_length(batch["text"]).to_numpy(), dtype=np.int64), 0
    while begin < len(batch):
        n = np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most_bytes) - begin
        n = int(min(max(n, 1), most_rows))
        yield batch.slice(begin, n)
        begin += n


def _runs(first: int | None):
    """A function of blocks of documents (id, text as bytes) that gives their runs, and without a term each block's documents with the sum of their tokens.

    first: None, or the number of the first block of the first task; runs then have places in the block instead of ids and lens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (first or 0) + (TaskContext.get().partitionId() << 32)
        for ids, texts in (b.columns for batch in batches for b in blocks(batch)):
            words = pc.ascii_split_whitespace(pa.array([plain(t) for t in texts.to_pylist()], pa.binary()).cast(pa.string()))
            lens, each = pc.list_value_length(words).to_numpy(), np.arange(len(ids))
            terms = words.flatten().dictionary_encode()
            key = terms.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(each, lens)
            key.sort()
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            code, doc = np.divmod(key[begin], len(ids))
            tf, size = np.diff(begin, append=len(key)), np.bincount(code, minlength=len(terms.dictionary))
            doc, tf = np.concatenate([doc, each]), np.concatenate([tf, np.zeros(len(ids), np.int64)])
            ends = np.concatenate([[0], np.cumsum(size), [len(doc)]])
            lists = lambda values, at=ends: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32)))
            if first is None:
                held = {"ids": lists(ids.take(pa.array(doc))), "lens": lists(lens[doc])}
            else:
                once = np.concatenate([np.zeros(len(size) + 1, np.int64), [len(ids)]])
                held = {"ids": lists(ids, once), "lens": lists(lens, once), "places": lists(doc)}
            out = {"block": pa.array(np.full(len(size) + 1, number)), "term": pa.concat_arrays([terms.dictionary, pa.nulls(1, pa.string())]), "total": pa.array(np.append(size, lens.sum(dtype=np.int64)))} | held | {"tfs": lists(tf)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))
            number += 1

    return run


def runs(docs: DataFrame, id_: str = "doc_id", text: str = "text", first: int | None = None) -> DataFrame:
    """The runs of documents whose ids don't repeat: block, term, total, ids, lens and tfs or, with a first number for their blocks, places and tfs; texts are
    neither shuffled nor tokenised by the engine."""
    rows = docs.select(F.col(id_).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_runs(first), f"block long, term string, total long, ids array<{kind}>, lens array<int>, {'' if first is None else 'places array<int>, '}tfs array<int>")


def _thinned(table: pa.Table, keep: np.ndarray) -> dict[str, pa.Array]:
    """Of runs (places, tfs): places and tfs as lists of those places that keep has, and `flat`, these places one after the other."""
    places, tfs = (pc.list_flatten(table[c]).combine_chunks() for c in ("places", "tfs"))
    at, n = places.to_numpy(), pc.list_value_length(table["places"]).to_numpy()
    held = (at < len(keep)) & keep[np.minimum(at, len(keep) - 1)] if len(keep) else np.zeros(len(at), bool)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[held], minlength=len(n)))]).astype(np.int32))
    mask = pa.array(held)
    return {"ends": ends, "flat": at[held], "places": pa.ListArray.from_arrays(ends, places.filter(mask)), "tfs": pa.ListArray.from_arrays(ends, tfs.filter(mask))}


def thinned(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Runs of places without those that docs (block, place) don't have; a block's runs meet its documents in one task."""
    names = ["block", "term", "total", "places", "tfs"]

    def work(own: pa.Table, docs: pa.Table) -> pa.Table:
        at = docs["place"].to_numpy()
        keep = np.zeros(int(at.max()) + 1 if len(at) else 0, bool)
        keep[at] = True
        left = _thinned(own, keep)
        total = np.diff(left["ends"].to_numpy())
        out = pa.table({"block": own["block"], "term": own["term"], "total": pa.array(total.astype(np.int64)), "places": left["places"], "tfs": left["tfs"]})
        return out.filter(pa.array(total > 0))

    return rows.select(names).groupBy("block").cogroup(docs.select("block", "place").groupBy("block")).applyInArrow(work, "block long, term string, total long, places array<int>, tfs array<int>")


def gathered(post: DataFrame, n_blocks: int, markers: bool = True) -> DataFrame:
    """The same rows of postings (id, len, term, tf), an id's in one block."""
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block")
    lists = lambda rows: rows.agg(F.collect_list(F.struct("id", "len", "tf")).alias("l"), F.sum("total").alias("total"))
    rows = lists(post.select(block, "term", "id", "len", F.col("tf").cast("int").alias("tf"), F.lit(1).cast("long").alias("total")).groupBy("block", "term"))
    if markers:
        each = post.groupBy("id").agg(F.max("len").alias("len"))
        rows = rows.unionByName(lists(each.select(block, F.lit(None).cast("string").alias("term"), "id", "len", F.lit(0).alias("tf"), F.col("len").cast("long").alias("total")).groupBy("block", "term")))
    return rows.select("block", "term", "total", F.col("l.id").alias("ids"), F.col("l.len").alias("lens"), F.col("l.tf").alias("tfs"))


def weighted(df: DataFrame, size: DataFrame) -> DataFrame:
    """term, df and idf (a negative one becomes EPSILON times the mean of all), of df by term and one row of n."""
    raw = df.join(F.broadcast(size)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


@dataclass
class Index:
    """Postings (id, len, term, tf and, where they are dealt into folders, bucket), terms (term, df, idf), sizes (one row: n, avgdl), and runs where these are what is stored;
    docs (id, len, block, place) where runs have places: those that may come back."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame
    runs: DataFrame | None = None
    docs: DataFrame | None = None


def shared(spark: SparkSession) -> str:
    """The folder that the session shares with its executors; a temporary one only in local sessions that name none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lodequery-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _schemas(id_type: str) -> dict[str, StructType]:
    read = StructType.fromDDL
    return {"runs": read(f"block long, term string, total long, ids array<{id_type}>, lens array<int>, tfs array<int>, bucket int"), "terms": read("term string, df long, idf double"), "sizes": read("n long, avgdl double")}


def opened(spark: SparkSession, path: str) -> Index | None:
    """The index kept in a folder; None where there is none."""
    _, state = versions.last(spark, path)
    if not state:
        return None
    part = {t: versions.read(spark, path, t, [state["segment"]], schema).drop("_seg") for t, schema in _schemas(state["id"]).items()}
    each = F.explode(F.arrays_zip("ids", "lens", "tfs")).alias("x")
    post = part["runs"].where("term is not null").select("term", "bucket", each).select(F.col("x.ids").alias("id"), F.col("x.lens").alias("len"), "term", F.col("x.tfs").cast("long").alias("tf"), "bucket")
    return Index(post, part["terms"], part["sizes"], part["runs"])


def built(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text") -> Index:
    """The index of docs, written to path; where another writer commits first, that one's index of the same documents stands."""
    spark, (seen, _) = docs.sparkSession, versions.last(docs.sparkSession, path)
    kind, segment = docs.select(id_).schema.fields[0].dataType.simpleString(), versions.new_segment(seen)
    schemas = _schemas(kind)
    rows = gathered(postings(docs, id_, text), -(-docs.count() // BLOCK) or 1) if repeats(docs, id_) else runs(docs, id_, text)
    versions.write(dealt(rows), path, "runs", segment, "bucket")
    kept = versions.read(spark, path, "runs", [segment], schemas["runs"])
    blocks = kept.where("term is null").select(F.size("ids").alias("n"), "total")
    versions.write(blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), (F.sum("total") / F.sum("n")).alias("avgdl")), path, "sizes", segment)
    df = kept.where("term is not null").groupBy("term").agg(F.sum("total").alias("df"))
    versions.write(weighted(df, versions.read(spark, path, "sizes", [segment], schemas["sizes"])), path, "terms", segment)
    try:
        versions.committed(spark, path, seen, {"segment": segment, "id": kind})
    except versions.Conflict:
        pass
    return opened(spark, path)


def indexed(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> Index:
    """The index of a table of files, opened where a session has built it for these files, else built; other rows are indexed anew."""
    spark, state = docs.sparkSession, store.token(docs.select(id_, text))
    if state is None:
        return built(docs, f"{shared(spark)}/runs-{uuid.uuid4().hex}", id_, text)
    path = f"{shared(spark)}/runs-{state}"
    return opened(spark, path) or built(docs, path, id_, text)


def query_terms(queries: DataFrame, id_: str = "query_id", text: str = "query") -> DataFrame:
    """query_id, term and how often the query has it."""
    return queries.select(F.col(id_).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def score_of(tf: Column, length: Column, avgdl: Column, idf: Column, k1: float = K1, b: float = B) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl))


def ranked(rows: DataFrame, k: int, score: str = "score", id_: str = "id", by: str = "query_id") -> DataFrame:
    """The k best rows of each query by falling score, then id, with rank from 1. None for k <= 0."""
    order = Window.partitionBy(by).orderBy(F.desc(score), id_)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scored(index: Index, queries: DataFrame, keep: DataFrame | None = None, digits: int = 6, most_broadcast: int = 200_000) -> DataFrame:
    """query_id, id, score of documents that share a token with the query; keep: the documents (id) that may come back.

    Up to `most_broadcast` terms of queries are broadcast to the postings; more are joined by a shuffle.
    """
    terms, hits = query_terms(queries), index.postings
    found = terms.select(bucket_of(F.col("term")).alias("bucket")).groupBy("bucket").count().collect()  # BUCKETS rows at most
    if sum(r["count"] for r in found) <= most_broadcast:
        terms = F.broadcast(terms)
    terms = index.terms.select("term", "idf").join(terms, "term")
    if sum(r["count"] for r in found) <= most_broadcast:
        terms = F.broadcast(terms)
    if "bucket" in hits.columns:
        hits = hits.where(F.col("bucket").isin([r["bucket"] for r in found]))
    hits = hits if keep is None else hits.join(keep.select("id"), "id", "left_semi")
    hits = hits.join(terms.select("term").distinct(), "term", "left_semi").repartition("id")  # a document's sums, for each query, are then made where its postings are
    part = F.col("times") * score_of(F.col("tf"), F.col("len"), F.col("avgdl"), F.col("idf"))
    return hits.join(terms, "term").join(F.broadcast(index.sizes)).groupBy("query_id", "id").agg(F.round(F.sum(part), digits).alias("score"))


def _named(rows: pa.Table) -> pa.Table:
    """A block's rows with ids and lens in the place of places, which are those of its documents' rows; places without a document are left out."""
    told, held = rows.filter(pc.is_null(rows["asked"])), rows.filter(pc.is_valid(rows["asked"]))
    ids, lens, at = (pc.list_flatten(told[c]).combine_chunks() for c in ("ids", "lens", "places"))
    at = at.to_numpy()
    row = np.full(int(at.max()) + 1 if len(at) else 0, -1)
    row[at] = np.arange(len(at))
    left = _thinned(held, row >= 0)
    own = pa.array(row[left["flat"]])
    lists = {"ids": pa.ListArray.from_arrays(left["ends"], ids.take(own)), "lens": pa.ListArray.from_arrays(left["ends"], lens.take(own)), "tfs": left["tfs"]}
    out = pa.table({c: lists.get(c, held[c]) for c in held.column_names if c != "places"})
    return pa.concat_tables([out, told.drop_columns(["places"]).select(out.column_names).cast(out.schema)])


def _bests(k: int, digits: int, flowing: bool, placed: bool = False):
    """A function of one block's rows for some queries: the k best documents of each query (and flow).

    Rows are runs with the queries that ask for their term (asked: query_id, w) or, without these, a flow's documents of the block. placed: runs have places, and
    all documents that may come back have such rows.
    """

    def best(rows: pa.Table) -> pa.Table:
        rows = _named(rows.combine_chunks()).combine_chunks() if placed else rows.combine_chunks()
        held = rows.filter(pc.is_valid(rows["asked"]))
        flat = lambda t, c: pc.list_flatten(t[c]).combine_chunks()
        at = lambda t, c: np.repeat(np.arange(len(t)), pc.list_value_length(t[c]).to_numpy())
        ids, asked = flat(held, "ids"), flat(held, "asked")
        values = pc.unique(ids)
        values = values.take(pc.sort_indices(values, null_placement="at_start"))  # a stable sort by score then leaves ties by id
        doc, run = pc.index_in(ids, values).to_numpy(), at(held, "ids")
        tf, length = flat(held, "tfs").to_numpy().astype(np.float64), flat(held, "lens").to_numpy()
        avgdl = held["avgdl"][0].as_py() if len(held) else 1.0
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))
        queries = pc.unique(asked.field("query_id"))
        who, w = pc.index_in(asked.field("query_id"), queries).to_numpy(), pc.fill_null(asked.field("w"), 0.0).to_numpy()  # a term in more postings than documents has no weight
        n_runs, n_queries = len(held), len(queries)
        weight, meets = np.zeros((n_runs, n_queries)), np.zeros((n_runs, n_queries), np.float32)
        weight[at(held, "asked"), who], meets[at(held, "asked"), who] = w, 1
        if flowing:
            told = rows.filter(pc.is_null(rows["asked"]))
            own = [(name, np.unique(pc.drop_null(pc.index_in(flat(told.slice(i, 1), "ids"), values)).to_numpy())) for i, name in enumerate(told["flow"].to_pylist())]
        else:
            own = [(None, np.arange(len(values)))]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), None)]
        step = max(1, 4_000_000 // max(n_runs, 1))
        score = np.full((n_queries, len(values)), -np.inf)
        order = np.argsort(doc, kind="stable")
        doc, run, part = doc[order], run[order], part[order]
        for begin in range(0, len(values), step):
            n = min(step, len(values) - begin)
            of = slice(*np.searchsorted(doc, [begin, begin + n]))
            cells = np.bincount((doc[of] - begin) * np.int64(n_runs) + run[of], part[of], n * n_runs).reshape(n, n_runs)
            s = cells @ weight
            shared = s > 0 if (w > 0).all() else (cells > 0).astype(np.float32) @ meets > 0
            score[:, begin : begin + n] = np.where(shared, np.rint(s * 10.0**digits) / 10.0**digits, -np.inf).T
        for name, docs in own:
            s = score[:, docs]
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            found = np.take_along_axis(s, top, axis=1)
            q, j = np.nonzero(found > -np.inf)
            out.append((q, docs[top[q, j]], found[q, j], name))
        q, d, s = (np.concatenate([x[i] for x in out]) for i in range(3))
        columns = {"query_id": queries.take(pa.array(q)), "id": values.take(pa.array(d)), "score": pa.array(s)}
        if flowing:
            columns["flow"] = pa.concat_arrays([pa.array([x[3]] * len(x[0]), pa.string()) for x in out])
        return pa.table(columns)

    return best


def best(index: Index, queries: DataFrame, k: int, flows: DataFrame | None = None, digits: int = 6, query_block: int = 256, most_broadcast: int = 200_000) -> DataFrame:
    """query_id, id, score of, among others, the k best documents of each query that share a token with it; with flows (id, flow), of each flow, and flow.

    Queries are dealt into parts of about `query_block`; a task scores a block's documents for one of them and keeps its k best, so that at most k rows
    a query and block are shuffled. A document in several flows stands in each, one in none in none.
    """
    terms = query_terms(queries)
    found = terms.select(bucket_of(F.col("term")).alias("bucket")).groupBy("bucket").count().collect()  # BUCKETS rows at most
    n_parts = max(1, -(-queries.count() // query_block))
    small = F.broadcast if sum(r["count"] for r in found) <= most_broadcast else (lambda df: df)
    part = F.pmod(F.xxhash64("query_id"), F.lit(n_parts)).cast("int").alias("part")
    asked = index.terms.select("term", "idf").join(small(terms), "term").select(part, "term", F.struct("query_id", (F.col("times") * F.col("idf")).alias("w")).alias("x")).groupBy("part", "term").agg(F.collect_list("x").alias("asked"))
    rows = index.runs if index.runs is not None else index.postings
    if "bucket" in rows.columns:
        rows = rows.where(F.col("bucket").isin([r["bucket"] for r in found]))
    if index.runs is None:  # an index that keeps postings: those of the queries' terms are gathered into blocks
        n_blocks = -(-(index.sizes.first()["n"] or 0) // BLOCK) or 1
        rows = gathered(rows.join(small(terms.select("term").distinct()), "term", "left_semi"), n_blocks, markers=False)
    placed = index.docs is not None
    lists = ["ids", "lens", "places", "tfs"] if placed else ["ids", "lens", "tfs"]
    if placed:
        rows = rows.where("term is not null").withColumns({c: F.lit(None).cast(t) for c, t in (("ids", f"array<{index.docs.schema['id'].dataType.simpleString()}>"), ("lens", "array<int>"))})
    hits = rows.join(small(asked), "term").join(F.broadcast(index.sizes.select("avgdl"))).select("block", "part", *lists, "asked", "avgdl", F.lit(None).cast("string").alias("flow"))
    if placed or flows is not None:
        if placed:
            own = index.docs.withColumn("flow", F.lit(None).cast("string")) if flows is None else index.docs.join(flows.select("id", "flow"), "id")
        elif index.runs is None:
            own = flows.select("id", "flow", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"))
        else:
            own = index.runs.where("term is null").select("block", F.explode("ids").alias("id")).join(flows.select("id", "flow"), "id")
        if placed:
            own = own.groupBy("block", "flow").agg(F.collect_list(F.struct("id", "len", "place")).alias("l")).select("block", "flow", F.col("l.id").alias("ids"), F.col("l.len").alias("lens"), F.col("l.place").alias("places"))
        else:
            own = own.groupBy("block", "flow").agg(F.collect_list("id").alias("ids"))
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
        none = lambda c: F.col(c) if c in own.columns else F.lit(None).cast(hits.schema[c].dataType).alias(c)
        hits = hits.unionByName(own.select(*map(none, hits.columns)))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    out = f"query_id {kind(terms, 'query_id')}, id {kind(index.postings, 'id')}, score double" + (", flow string" if flows is not None else "")
    return hits.groupBy("block", "part").applyInArrow(_bests(k, digits, flows is not None, placed), out)


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_: str = "doc_id", text: str = "text", keep: Column | None = None, digits: int = 6, index: Index | None = None) -> DataFrame:
    """query_id, id, score, rank: documents that share a token with the query, even those of score 0 or less.

    keep filters documents before the cut, not the statistics. Scores are rounded before ranking, so
    that equal ones tie by id on every machine.
    """
    index = indexed(docs, id_, text) if index is None else index
    own = None if keep is None else docs.where(keep).select(F.col(id_).alias("id"), F.lit("").alias("flow"))
    return ranked(best(index, queries, max(k, 0), own, digits).select("query_id", "id", "score"), k)
