"""N-gram Jaccard self join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Equal sets are one class of copies from the start. Each class
gets 128 MinHash values of 16 bits; classes that agree on one of 32 bands of four values are candidates.
Candidate pairs are compared value by value in steps of 32: with a uniform prior, m agreements among n
values give the similarity a Beta posterior, and the pair is dropped as soon as the probability of
reaching the threshold is below `tolerance`. Pairs that are left are verified exactly on their shingles.

To keep shuffles small and no group large, this runs in two rounds. Round one reads the buckets (only
ids and signatures, in blocks of `bucket_block` members) and keeps a spanning forest of the pairs that
survive. Round two takes each connected group of survivors, in pairs of smaller blocks since it holds
whole sets, prunes its pairs again, verifies
the rest on whole sets and counts links. Every pair that survives in any bucket lies inside one group,
so none is lost; a group of many thousand near copies is spread over many tasks, and copies count by weight.

A pair of similarity 0.8 shares no band with a probability of 5e-8 and is pruned with about `tolerance`.

Cases: words are split at white space and compared with A-Z in lower case; texts of one to four words
have one shingle of all words; null texts and texts without words have no links and are classes of their
own; repeated rows count as copies; null doc_id is kept (class_id is null only if all members' ids are
null); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodequery.llm.common import Words, aside, cut, text_batches

VALUES, ROWS = 128, 4
_ODD = (np.random.default_rng(11).integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = np.random.default_rng(12).integers(0, 2**32, VALUES, dtype=np.uint32)[:, None]


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, empty for a text without words."""
    w = Words(texts, lower=True)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w.types), np.uint64, len(w.types))
    words = hashed[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    for a, b in zip(w.starts[:-1], w.starts[1:], strict=True):
        own = words[a:b]
        if len(own) == 0:
            yield own
            continue
        size = min(n, len(own))
        rolled = np.zeros(len(own) - size + 1, np.uint64)
        for i in range(size):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - size + 1 + i]
            rolled ^= rolled >> np.uint64(29)
        yield np.unique(rolled)


def key_of(shingles: np.ndarray) -> bytes | None:
    """128-bit id of a set; None for the empty set."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signature(shingles: np.ndarray, step: int = 4096) -> np.ndarray:
    """The MinHash values of a set, 16 bits each."""
    least = np.full(VALUES, 2**32 - 1, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), step):
        hashed = _ODD * short[None, i : i + step]
        hashed += _ADD
        np.minimum(least, hashed.min(axis=1), out=least)
    return ((least * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def least_agreements(threshold: float, tolerance: float, step: int = 32) -> list[tuple[int, int]]:
    """(n, m): of n values at least m must agree, or the posterior of reaching the threshold is below tolerance."""
    out = []
    for n in range(step, VALUES + 1, step):
        below, m = 0.0, -1
        while below < tolerance:  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs (a in left, b in right) of signatures outlast all steps."""
    alive, agreed, begin = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in bounds:
        for i in range(0, len(alive), 200_000):
            part = alive[i : i + 200_000]
            agreed[part] += (left[a[part], begin:n] == right[b[part], begin:n]).sum(axis=1, dtype=np.int32)
        alive, begin = alive[agreed[alive] >= least], n
    return alive


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, width: int = 65_536) -> np.ndarray:
    """Sizes of the intersections of sets a and b, exactly; many pairs of few sets by matrix products over slices of shingles."""
    if len(a) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sets), len(sets)))
    for begin in range(0, len(distinct), width):
        x, y = np.searchsorted(at, [begin, begin + width])
        has = np.zeros((len(sets), min(width, len(distinct) - begin)), np.float32)
        has[owner[x:y], at[x:y] - begin] = 1
        out += has @ has.T
    return np.rint(out[a, b]).astype(np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray, order: list[bytes]) -> list[tuple[int, int]]:
    """(member, first member of its component) for members of components of two or more; first by `order`."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            if order[y] < order[x]:
                x, y = y, x
            parent[y] = x
    return [(x, r) for x in range(n) if (r := root(x)) != x]


def by_group(work: Callable[[pa.Table], Iterator[dict]], schema: pa.Schema) -> Callable:
    """A mapInArrow function: work(rows of one group) for each run of equal `g` in sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], []

        def flush(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                rows.extend(work(table.slice(x, y - x)))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            g = batch.column("g").to_numpy()
            if g[0] == g[-1] and held[0].column("g")[0].as_py() == g[0]:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("g").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            yield from flush(table, edges)
            held = table.slice(edges[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from flush(table, np.array([0, table.num_rows]))
        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def in_blocks(members: DataFrame, by: str, order: str, block: int) -> DataFrame:
    """Members of groups of two or more, once for each pair of blocks they belong to: g (the pair) and side (0, 1 or 2: both).

    A group of n has ceil(n / block) blocks, and a member's block is dealt by a hash of `order`. Group sizes
    are partly aggregated where the rows are and joined back, so no task sorts or buffers a whole group for its numbers.
    """
    counts = members.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1")
    numbered = members.join(counts, by)
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), order), blocks).cast("int")
    other = numbered.withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    g = F.xxhash64(by, F.least("_b", "_o"), F.greatest("_b", "_o"))
    side = F.when(F.col("_b") == F.col("_o"), 2).when(F.col("_b") < F.col("_o"), 0).otherwise(1)
    return other.withColumn("g", g).withColumn("side", side).drop("_n", "_b", "_o")


def pairs_of(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs to compare among a group's rows."""
    if side[0] == 2:
        return np.triu_indices(len(side), 1)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, root (the least node of its connected component) of all nodes of edges (a, b).

    Alternates large and small stars until nothing changes: each round every node links its neighbours
    to the least node it knows, so long chains shrink to stars in a logarithmic number of rounds. Least
    neighbours are aggregated where the rows are; no neighbour list is gathered. Edges that still change after
    `most_rounds` rounds are an error.
    """
    def ordered(edges: DataFrame) -> DataFrame:
        return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def small_star(edges: DataFrame) -> DataFrame:
        """A node's smaller neighbours, and the node, linked to the least of them."""
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))

    def large_star(edges: DataFrame) -> DataFrame:
        """A node's larger neighbours linked to the least node among its neighbours and itself."""
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.where("m < a").select("a", F.col("m").alias("b")))

    # small stars first: many buckets give a node as many roots, most of which this step makes one
    edges = cut(ordered(small_star(ordered(edges))))
    before = None
    for _ in range(most_rounds):
        edges = cut(ordered(small_star(ordered(large_star(edges)))))
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def classed(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, bucket_block: int = 1024, block: int = 128, most_sent: int = 2_000_000) -> DataFrame:
    """doc_id, key (of its set; null: no words), root (least key among all sets reached by links), class_id and n_links of each row.

    most_sent: up to so many ids of candidate classes are broadcast to the second scan of the texts; more are joined by a shuffle.
    """
    bounds = least_agreements(threshold, tolerance)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in text_batches(iter([big])):
                keys, signatures = [], []
                for s in shingle_sets(b.column("text"), n):
                    keys.append(key_of(s))
                    signatures.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "key", "sig"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(docs.mapInArrow(sign, "doc_id long, key binary, sig binary"))
    classes = cut(signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig")))

    # round one: buckets
    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(VALUES // ROWS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width + 1, F.lit(width))))
    buckets = in_blocks(classes.select("key", F.explode(bands).alias("bucket")), "bucket", "key", bucket_block)
    work = buckets.select("g", "side", "key").join(classes.select("key", "sig"), "key").repartition("g").sortWithinPartitions("g")
    pair_schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def prune(rows: pa.Table) -> Iterator[dict]:
        keys = rows.column("key").to_pylist()
        s = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        a, b = pairs_of(rows.column("side").to_numpy())
        alive = survivors(s, s, a, b, bounds)
        for x, r in forest(len(keys), a[alive], b[alive], keys):
            yield {"a": keys[x], "b": keys[r]}

    groups = cut(components(work.mapInArrow(by_group(prune, pair_schema), "a binary, b binary")))

    # round two: whole sets of the groups' classes
    members = cut(groups.withColumnRenamed("node", "key").join(classes, "key"))
    wanted = members.select(F.col("rep").alias("_rep")).distinct()
    wanted = F.broadcast(wanted) if members.count() <= most_sent else wanted

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in text_batches(iter([big])):
                sets = list(shingle_sets(b.column("text"), n))
                yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])

    sets = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("_rep"))).select("text").mapInArrow(whole, "key binary, shingles binary").dropDuplicates(["key"])
    blocks = in_blocks(members.select("root", "key", "copies"), "root", "key", block).select("g", "side", "key", "copies")
    work = blocks.join(classes.select("key", "sig").join(sets, "key"), "key").repartition("g").sortWithinPartitions("g")
    link_schema = pa.schema([("key", pa.binary()), ("first", pa.binary()), ("links", pa.int64())])

    def verify(rows: pa.Table) -> Iterator[dict]:
        keys, copies = rows.column("key").to_pylist(), rows.column("copies").to_numpy()
        s = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, VALUES)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
        a, b = pairs_of(rows.column("side").to_numpy())
        alive = survivors(s, s, a, b, bounds)
        a, b = a[alive], b[alive]
        both, size = intersections(sets, a, b), np.array([len(x) for x in sets])
        linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
        a, b = a[linked], b[linked]
        links = np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
        first = dict(forest(len(keys), a, b, keys))
        for i in np.flatnonzero(links).tolist():
            yield {"key": keys[i], "first": keys[first.get(i, i)], "links": int(links[i])}

    found = cut(work.mapInArrow(by_group(verify, link_schema), "key binary, first binary, links long"))
    roots = components(found.select(F.col("key").alias("a"), F.col("first").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = classes.select("key", "rep", "copies").join(links, "key").join(roots.withColumnRenamed("node", "key"), "key")
    least = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    linked = linked.join(least, "root").select("key", "root", "class_id", "links")
    known = classes.select("key", "rep", "copies").join(linked, "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("class_id")).alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    out = signed.select("doc_id", "key").join(known, "key", "left")
    alone = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", "key", "root", alone.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (least doc_id among all documents reached by links) and n_links (documents of similarity >= threshold, itself not) of each row."""
    return classed(docs, **options).select("doc_id", "class_id", "n_links")


def kept(docs: DataFrame, most_sent: int = 2_000_000, **options) -> DataFrame:
    """One row of each class, all columns: of least doc_id, then key; of several such rows the least by all columns.

    Texts without words are no copies of each other and stay. What goes is found on ids and keys alone;
    up to `most_sent` of those are broadcast to the scan of the rows, more are joined by a shuffle.
    """
    n, names = options.get("n", 5), docs.columns
    docs = aside(docs, ("doc_id", "text"))
    found = cut(classed(docs, most_sent=most_sent, **options).where("key is not null").groupBy("doc_id", "key", "root").count())
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    best = best.select("root", F.col("best.doc_id").alias("_id"), F.col("best.key").alias("_key"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    # a mark for each (doc_id, key) that needs one: 0 goes, 2 stands on several rows of which one stays
    marks = found.join(best, "root").select("doc_id", "key", F.when(~own, 0).when(F.col("count") > 1, 2).alias("mark")).where("mark is not null")
    marks = cut(marks.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "mark"))
    many = marks.count() > most_sent

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in text_batches(iter([big])):
                keys = [key_of(s) for s in shingle_sets(b.column("text"), n)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], [*b.schema.names, "_row_key"])

    rows = docs.mapInArrow(with_key, T.StructType([*docs.schema.fields, T.StructField("_row_key", T.BinaryType())]))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key"))
    marked = rows.join(marks if many else F.broadcast(marks), same, "left")
    single = marked.where("mark is null").select(*docs.columns)
    if marks.where("mark = 2").isEmpty():
        return single.toDF(*names)
    first = F.row_number().over(Window.partitionBy("doc_id", "_row_key").orderBy(*docs.columns))
    return single.unionByName(marked.where("mark = 2").withColumn("_first", first).where("_first = 1").select(*docs.columns)).toDF(*names)
