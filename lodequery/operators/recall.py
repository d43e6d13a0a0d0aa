"""Semantic memory: vectors of turns, kept, grown by what is new, and searched.

A kept memory is a versioned folder of rows (id, session_key, turn_index, captured_at, role, text, vector), in a folder for each day of capture. Growing
it embeds the turns whose id it lacks and adds them as one segment; a run without new turns writes nothing. A search ranks all kept turns by cosine,
cuts at k, and only then keeps those of the time window, so that fewer than k may be left.

Cases: a turn without time lies in the folder of no day and in no window with an end; of several rows of an id the first by its values counts; blank texts
aren't turns; texts without words have a vector of zeros and score 0; an empty memory gives no hits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodequery.functions import embed
from lodequery.operators import memory, retrieve
from lodequery.sources import store, versions

ROWS = "id string, session_key {key}, turn_index int, captured_at double, role string, text string, vector array<double>, day int"
Embed = Callable[[DataFrame], DataFrame]


def _schema(key: str) -> StructType:
    return StructType.fromDDL(ROWS.format(key=key))


def kept(spark: SparkSession, at: str, since: float | None = None, until: float | None = None) -> DataFrame | None:
    """The kept turns, of a window only the folders of its days; None where there is no memory."""
    _, state = versions.last(spark, at)
    if not state:
        return None
    rows = versions.read(spark, at, "turns", state["segments"], _schema(state["key"])).drop("_seg")
    day = lambda t: int(t // 86400)
    if since is not None:
        rows = rows.where(F.col("day") >= day(since))
    return rows.where(F.col("day") <= day(until)) if until is not None else rows


def grown(turns: DataFrame, sessions: DataFrame, at: str, embedded: Embed = embed.hashed) -> int:
    """Adds the turns (session_key, turn_index, role, text) of the sessions (session_key, captured_at) that the memory lacks; how many those were.

    embedded adds `vector` to rows with id and text; it sees new turns only. Of two writers one starts anew.
    """
    spark = turns.sparkSession
    key = dict(turns.dtypes)["session_key"]
    times = sessions.groupBy("session_key").agg(F.min("captured_at").cast("double").alias("captured_at"))
    rows = turns.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(times, "session_key")
    rows = rows.select(F.concat_ws("#", "session_key", "turn_index").alias("id"), "session_key", F.col("turn_index").cast("int").alias("turn_index"), "captured_at", "role", "text")
    for left in reversed(range(5)):
        seen, state = versions.last(spark, at)
        known = kept(spark, at)
        fresh = store.first_of(rows if known is None else rows.join(known.select("id"), "id", "left_anti").select(*rows.columns), ["id"])
        segment = versions.new_segment(seen)
        full = embedded(fresh).withColumn("day", F.floor(F.col("captured_at") / 86400).cast("int"))
        versions.write(full.select(_schema(key).fieldNames()), at, "turns", segment, "day")
        n = versions.read(spark, at, "turns", [segment], _schema(key)).count()
        if not n and state:
            return 0
        try:
            versions.committed(spark, at, seen, {"segments": [*state.get("segments", []), segment], "key": key})
            return n
        except versions.Conflict:
            if not left:
                raise
    return 0


def search(spark: SparkSession, at: str, queries: DataFrame, k: int, since: float | None = None, until: float | None = None, embedded: Embed = embed.hashed) -> DataFrame:
    """query_id, rank, session_key, turn_index, captured_at, role, snippet, score of the k turns nearest to each query (query_id, query), less those outside the window."""
    rows = kept(spark, at)
    if rows is None:
        rows = spark.createDataFrame([], _schema("string"))
    asked = embedded(queries.select("query_id", F.col("query").alias("text"))).select("query_id", "vector")
    hits = retrieve.dense(rows, asked, k, "id", "vector")
    return memory.recalled(hits, rows.drop("id", "vector", "day"), since, until)
