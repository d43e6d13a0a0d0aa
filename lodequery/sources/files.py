"""Trees of source files as tables: discovery by names alone, texts, and the identity of contents.

Trees lie in a folder that driver and executors see under the same path. Every file is listed: empty ones, dotfiles, names that begin with _;
links to folders aren't followed, and links to nothing are left out. Bytes that aren't UTF-8 are dropped from texts; null contents read as
empty; a folder without files gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

from lodequery.functions.text import EXCLUDES, excluded, language

#: Languages that are documents, not code.
DOCS = ("markdown",)
ROWS = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64()), ("content", pa.binary())])


class Subtree(InputPartition):
    """A folder below the root; deep: with all below it, else its own files alone."""

    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.exclude = tuple(x for x in options.get("exclude", "").split("\n") if x)
        self.content = options.get("content", "true") == "true"
        self.least = int(options.get("tasks", "64"))

    def entries(self, folder: str) -> Iterator[os.DirEntry]:
        with os.scandir(f"{self.root}/{folder}") as found:
            yield from (e for e in found if not any(fnmatchcase(e.name, p) for p in self.exclude))

    def below(self, folder: str) -> list[str]:
        return sorted(f"{folder}/{e.name}".lstrip("/") for e in self.entries(folder) if e.is_dir(follow_symlinks=False))

    def partitions(self) -> list[InputPartition]:
        """Folders are opened, level by level, until there are enough subtrees for the tasks; what is below them is listed by the tasks."""
        shallow, open_ = [], [""]
        while open_ and len(open_) < self.least:
            shallow += open_
            open_ = [x for f in open_ for x in self.below(f)]
        return [Subtree(f, False) for f in shallow] + [Subtree(f, True) for f in open_]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        (first, deep), rows, held = partition.value, [], 0
        waiting = [first]
        while waiting:
            folder = waiting.pop()
            waiting += self.below(folder) if deep else []
            for e in self.entries(folder):
                try:
                    if not e.is_file():
                        continue
                    stat = e.stat()
                    content = None
                    if self.content:
                        with open(e.path, "rb") as f:
                            content = f.read()
                except FileNotFoundError:  # gone since it was listed, or a link to nothing
                    continue
                rows.append({"path": f"{folder}/{e.name}".lstrip("/"), "mtime": stat.st_mtime_ns // 1000, "size": stat.st_size, "content": content})
                held += stat.st_size if self.content else 1000
                if held > 16_000_000:
                    yield pa.RecordBatch.from_pylist(rows, ROWS)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, ROWS)


class FileTree(DataSource):
    """path below the root, mtime in microseconds, size and content of every file below a root.

    Options: path; exclude, patterns of names, one a line, of files and folders that aren't opened; content, false to leave contents out; tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, mtime long, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def all_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), content: bool = True) -> DataFrame:
    """path below root, mtime, size and content of every file; excluded folders aren't opened, and without `content` no file is."""
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").option("exclude", "\n".join(exclude)).option("content", str(content).lower()).load(root)


def discovered(files: DataFrame, exclude: tuple[str, ...] = EXCLUDES) -> DataFrame:
    """Files of a known language that no pattern excludes: path, language, doc_type, mtime; in the order of their paths' parts."""
    rows = files.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~excluded(F.col("path"), exclude))
    return rows.withColumn("doc_type", F.when(F.col("language").isin(*DOCS), "doc").otherwise("code")).orderBy(F.split("path", "/"))


def decoded(content: Column | str) -> Column:
    """Bytes as UTF-8, without those that aren't."""

    @F.pandas_udf(StringType())
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda b: (b or b"").decode("utf-8", "ignore"))

    return text(content)


def documents(files: DataFrame, exclude: tuple[str, ...] = EXCLUDES) -> DataFrame:
    """Discovered files with their text: doc_id (the path), text, doc_type, language, path, mtime, as index.build() takes them."""
    rows = discovered(files, exclude)
    return rows.select(F.col("path").alias("doc_id"), decoded("content").alias("text"), "doc_type", "language", "path", "mtime")


def content_id(content: Column) -> Column:
    """The identity that version control gives a file of these bytes; - where there is no file."""
    head = F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.unhex(F.lit("00")))
    return F.when(content.isNull(), "-").otherwise(F.sha1(F.concat(head, content)))
