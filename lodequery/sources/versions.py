"""Folders whose readers see whole versions: immutable segments and version files that name them.

A folder holds `versions/<number>.json`, each created exclusively and never changed, and `<table>/_seg=<segment>` folders of Parquet,
each written before a version names it. A writer reads the last version, writes its segments and creates the version after the one it read;
where another writer was first it gets a Conflict and starts anew. Readers keep the segments of the version they opened.
A version file that its writer left unfinished is passed over, and its number stays used.

The exclusive creation is as strong as that of the file system: atomic on HDFS and on stores with conditional writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer committed first."""


def file_of(spark: SparkSession, path: str):
    """The path and its file system, as the JVM has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    at, fs = file_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = file_of(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file that must not be there; False where it is."""
    at, fs = file_of(spark, path)
    fs.mkdirs(at.getParent())
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Exception as e:  # the JVM's FileAlreadyExistsException, of the file system's own class
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def last(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number of the last version file and the state that the last finished one holds; 0 and {} without one."""
    names = [n for n in listed(spark, f"{path}/versions") if n.endswith(".json")]
    for name in reversed(names):
        try:
            return int(names[-1].split(".")[0]), json.loads(read_text(spark, f"{path}/versions/{name}"))
        except json.JSONDecodeError:
            continue
    return (int(names[-1].split(".")[0]) if names else 0), {}


def committed(spark: SparkSession, path: str, seen: int, state: dict) -> None:
    """Makes `state` the version after `seen`."""
    if not created(spark, f"{path}/versions/{seen + 1:08d}.json", json.dumps(state)):
        raise Conflict(f"version {seen + 1} of {path} was written by another writer")


def new_segment(seen: int) -> str:
    """A name for a segment of the version after `seen`; names sort by version."""
    return f"{seen + 1:08d}-{uuid.uuid4().hex[:12]}"


def write(rows: DataFrame, path: str, table: str, segment: str, *by: str) -> None:
    """Writes a segment of a table, with a folder for each value of `by`."""
    rows.write.option("compression", "zstd").partitionBy(*by).parquet(f"{path}/{table}/_seg={segment}")


def read(spark: SparkSession, path: str, table: str, segments: list[str], schema: StructType) -> DataFrame:
    """The rows of some segments of a table, with _seg."""
    if not segments:
        return spark.createDataFrame([], schema).withColumn("_seg", F.lit(""))
    folders = [f"{path}/{table}/_seg={s}" for s in segments]
    full = StructType([*schema.fields, *StructType().add("_seg", "string").fields])
    return spark.read.schema(full).option("basePath", f"{path}/{table}").parquet(*folders)


def alive(rows: DataFrame, gone: DataFrame, by: list[str]) -> DataFrame:
    """Rows (with _seg) without those whose key is among the gone ones (with _seg) of a later segment."""
    g = gone.select(*(F.col(c).alias(f"_gone_{c}") for c in by), F.col("_seg").alias("_gone_seg"))
    same = [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in by]
    on = F.col("_seg") < F.col("_gone_seg")
    for c in same:
        on = on & c
    return rows.join(g, on, "left_anti")


def swept(spark: SparkSession, path: str, tables: list[str], keep: int = 1) -> int:
    """Deletes segments that the last `keep` versions don't name, and older versions; how many segments went. Only for folders without older readers or
    writers under way."""
    names = [n for n in listed(spark, f"{path}/versions") if n.endswith(".json")]
    held = "".join(read_text(spark, f"{path}/versions/{n}") for n in names[-keep:])
    count = 0
    for name in names[:-keep]:
        at, fs = file_of(spark, f"{path}/versions/{name}")
        fs.delete(at, False)
    for table in tables:
        for name in listed(spark, f"{path}/{table}"):
            if name.startswith("_seg=") and name.removeprefix("_seg=") not in held:
                at, fs = file_of(spark, f"{path}/{table}/{name}")
                fs.delete(at, True)
                count += 1
    return count
