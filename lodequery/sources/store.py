"""Tables kept as Parquet: replaced as a whole, by collection, or by key.

A table is a versioned folder (see versions.py). A change by key writes the changed rows and their keys as one more segment, so that
what a change writes doesn't grow with the table; reading leaves out rows whose key a later segment has. compacted() makes
one segment of all. Readers see one version or the next, never a part; of two writers that start from one version, the
later reads anew and tries again. Folders must be shared by driver and executors. An empty table is kept as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.sources import versions


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was ever written there."""
    return versions.last(spark, path)[1] != {}


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table; one that doesn't exist stays so."""
    at, fs = versions.file_of(spark, path)
    fs.delete(at, True)


def _changed(spark: SparkSession, path: str, change: Callable[[int, list[dict]], list[dict]], tries: int = 5) -> None:
    """Commits the segments that change(number, segments) gives; once more from the start where another writer was first."""
    for left in reversed(range(tries)):
        seen, state = versions.last(spark, path)
        try:
            versions.committed(spark, path, seen, {"segments": change(seen, state.get("segments", []))})
            return
        except versions.Conflict:
            if not left:
                raise


def _segment(seen: int, rows: DataFrame | None, path: str, keys: DataFrame | None = None, by: tuple[str, ...] = ()) -> dict:
    """Writes rows, and the keys whose rows of earlier segments they replace, as a segment."""
    name = versions.new_segment(seen)
    if rows is not None:
        versions.write(rows, path, "rows", name)
    if keys is not None:
        versions.write(keys, path, "keys", name)
    return {"name": name, "rows": rows is not None, "by": [[f.name, f.dataType.simpleString()] for f in keys.schema.fields] if keys is not None else []}


def _read(spark: SparkSession, path: str, segments: list[dict], like: DataFrame) -> DataFrame:
    rows = versions.read(spark, path, "rows", [s["name"] for s in segments if s["rows"]], like.schema)
    kinds = {tuple(map(tuple, s["by"])) for s in segments if s["by"]}
    for kind in sorted(kinds):  # a table is mostly changed by one key
        own = [s["name"] for s in segments if tuple(map(tuple, s["by"])) == kind]
        keys = like.select(*(c for c, _ in kind))
        rows = versions.alive(rows, versions.read(spark, path, "keys", own, keys.schema), [c for c, _ in kind])
    return rows.drop("_seg")


def kept(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table as it is now, with the schema of `like`; without rows where there is none. What is read stays that version."""
    return _read(spark, path, versions.last(spark, path)[1].get("segments", []), like)


def replaced(rows: DataFrame, path: str) -> DataFrame:
    """The table after it was replaced by rows; rows may read the table itself."""
    spark = rows.sparkSession
    _changed(spark, path, lambda seen, _: [_segment(seen, rows, path)])
    return kept(spark, path, rows)


def first_of(rows: DataFrame, by: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the first by `order`, of equal ones (and without an order) that of least values, so that every run takes the same."""
    names = rows.columns
    whole = F.struct(*(F.col(c) for c in (*order, *(n for n in names if n not in order))))
    return rows.groupBy(*by).agg(F.min(whole).alias("_first")).select(*(F.col("_first")[c].alias(c) for c in names))


def upserted(rows: DataFrame, path: str, by: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """The table after rows took the place of those of equal keys; of several given rows of a key the first counts."""
    new = first_of(rows, by, order)
    _changed(rows.sparkSession, path, lambda seen, old: [*old, _segment(seen, new, path, new.select(*by) if old else None)])
    return kept(rows.sparkSession, path, rows)


def inserted_or_ignored(rows: DataFrame, path: str, by: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """The table after rows of keys it didn't have were added, of several given rows of a key the first; known keys keep what they have."""
    spark = rows.sparkSession

    def change(seen: int, old: list[dict]) -> list[dict]:
        known = _read(spark, path, old, rows).select(*by)
        return [*old, _segment(seen, first_of(rows, by, order).join(known, by, "left_anti").select(*rows.columns), path)]

    _changed(spark, path, change)
    return kept(spark, path, rows)


def inserted_by(spark: SparkSession, path: str, like: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
    """Adds the rows that make(the table as it is) gives; made anew where another writer was first."""
    _changed(spark, path, lambda seen, old: [*old, _segment(seen, make(_read(spark, path, old, like)), path)])


def without(keys: DataFrame, path: str, like: DataFrame, by: list[str]) -> DataFrame:
    """The table after rows of the given keys were deleted."""
    _changed(like.sparkSession, path, lambda seen, old: [*old, _segment(seen, None, path, keys.select(*by).distinct())])
    return kept(like.sparkSession, path, like)


def changed(rows: DataFrame, gone: DataFrame, path: str, by: list[str]) -> None:
    """Puts rows in the place of those of equal keys and deletes the gone keys, in one version; keys of rows must be distinct."""
    keys = rows.select(*by).unionByName(gone.select(*by)).distinct()
    _changed(rows.sparkSession, path, lambda seen, old: [*old, _segment(seen, rows, path, keys)])


def collection_reset(rows: DataFrame, path: str, by: str = "collection") -> None:
    """Replaces the collections that rows have; others stay."""
    _changed(rows.sparkSession, path, lambda seen, old: [*old, _segment(seen, rows, path, rows.select(by).distinct() if old else None)])


def compacted(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table after its segments became one."""
    _changed(spark, path, lambda seen, old: [_segment(seen, _read(spark, path, old, like), path)])
    return kept(spark, path, like)


def swept(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes the segments that the last `keep` versions don't use; how many."""
    return versions.swept(spark, path, ["rows", "keys"], keep)


def token(files: DataFrame) -> int | None:
    """A number that changes when the files behind a table do, or what is taken of them, and is the same in every session: of the plan as
    text, and of the files' names, sizes and times, listed by folder. None for rows that don't come from files, and for
    plans that Spark shortens as text."""
    names = files.inputFiles()
    plan = files._jdf.queryExecution().analyzed().canonicalized().toString()
    if not names or "more fields" in plan or "more entries" in plan:
        return None
    spark = files.sparkSession
    jvm, found = spark.sparkContext._jvm, []
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(n)) for n in names]
    for folder in {p.getParent().toString() for p in paths}:
        at, fs = versions.file_of(spark, folder)
        found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)]
    own = {p.toString() for p in paths}
    digest = hashlib.sha256(repr((plan, sorted(x for x in found if x[0] in own))).encode())
    return int.from_bytes(digest.digest()[:7], "big")
