"""Helpers the training-data operators share: lineage cuts, folds, bounded samples and batch tokenising."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local sessions that name none (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = tempfile.mkdtemp(prefix="lodequery-")
        spark.conf.set("spark.checkpoint.dir", set_dir)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, kept in the shared folder, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Written as Parquet in the shared folder (a folder for each value of `by`) and read again, so that later reads fetch single columns."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def deleted(df: DataFrame | None, part: str = "") -> None:
    """Deletes the folder, or one part, of a table that stored() wrote and that nothing reads any more."""
    if df is not None:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        folder = jvm.org.apache.hadoop.fs.Path(f"{df._stored_at}/{part}")
        folder.getFileSystem(conf).delete(folder, True)


def released() -> None:
    """Hands memory that was freed back to the system, so that workers that live on don't add up."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int) -> list[tuple[str, int]]:
    """At most `limit` labelled (text, label) rows for training, the first by a hash of the id.

    keep is a condition on doc_id. Rows of labels without label are skipped; where an id has several
    labels the largest counts. The ids are chosen from labels alone, so only they are sent to the scan
    of docs; an id that several documents carry gives its smallest text.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
        .orderBy("doc_id").limit(limit).collect()
    )
    return [(r["text"], r["_label"]) for r in rows]


def aside(docs: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """docs with all columns but `own` under other names, so that none clashes with working columns; toDF(*docs.columns) undoes it."""
    return docs.toDF(*(c if c in own else f"_in_{i}" for i, c in enumerate(docs.columns)))


class Words:
    """The white-space separated words of a batch of texts, dictionary coded.

    types: the distinct words (words: as an array); codes: an index into types per word; starts: where each text's words
    begin in codes, with one more entry for the end. Null texts have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0)
        held = np.asarray(full)
        ends = np.concatenate([[0], np.cumsum(held)])
        self.starts = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        coded = flat.filter(full).dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.codes = np.asarray(coded.indices).astype(np.int64)
        if lower:
            again = pc.ascii_lower(self.words).dictionary_encode()
            self.words = again.dictionary
            self.codes = np.asarray(again.indices).astype(np.int64)[self.codes]

    @cached_property
    def types(self) -> list[str]:
        return self.words.to_pylist()

    def encoded(self) -> Iterator[bytes]:
        """The distinct words' bytes, cut out of the array's own."""
        if not len(self.words):
            return iter(())
        _, ends, data = self.words.buffers()
        ends, data = np.frombuffer(ends, np.int64)[self.words.offset :][: len(self.words) + 1].tolist(), data.to_pybytes()
        return (data[a:b] for a, b in pairwise(ends))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of values (one per word) for each text."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]


def text_batches(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about `most` bytes of text or a single row; memory then doesn't follow row counts."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
        begin, held = 0, 0
        for i, n in enumerate(size):
            if held and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(embedding: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def matrices(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors in a batch: which rows have it, and their vectors as a matrix of longs."""
    held = batch.column(column)
    begin = np.asarray(held.offsets).astype(np.int64)
    size, flat = np.diff(begin), np.asarray(held.values)
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[begin[rows][:, None] + np.arange(d)]
