"""Conversation memory: sessions and turns, full-text and listing queries, first-write-wins archiving.

Null texts are blank, blank texts are no turns; session keys are unique in sessions, and of several new rows of a key one is archived; queries without words
have no hits; equal scores fall to later captures, then to session and turn as each function says; empty tables give empty results; extra columns are ignored.
A snippet shows the first hit, not the window of most hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.text import let, scrubbed

#: Fixed values of the full-text form of BM25; a negative idf becomes a tiny positive one.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def words(text: Column) -> Column:
    """Full-text tokens: runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def turn_rows(messages: DataFrame) -> DataFrame:
    """Turns of users and assistants with text, numbered from 0 within their session."""
    kept = messages.where(F.col("role").isin("user", "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return kept.withColumn("turn_index", F.row_number().over(Window.partitionBy("session_key").orderBy("turn")) - 1)


def archived(sessions: DataFrame, turns: DataFrame, new_sessions: DataFrame, new_turns: DataFrame, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Sessions and turns after archiving: a known session_key keeps what it has; new texts are scrubbed."""
    fresh = new_sessions.join(sessions.select("session_key"), "session_key", "left_anti").dropDuplicates(["session_key"])
    added = new_turns.join(fresh.select("session_key"), "session_key", "left_semi").withColumn("text", scrubbed(F.col("text"), extra))
    return sessions.unionByName(fresh), turns.unionByName(added)


def listed(sessions: DataFrame, turns: DataFrame, limit: int) -> DataFrame:
    """The last `limit` sessions by capture time, with their number of turns."""
    n = turns.groupBy("session_key").agg(F.count("*").alias("turn_count"))
    last = sessions.orderBy(F.desc("captured_at"), "session_key").limit(max(limit, 0))
    return last.join(n, "session_key", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))


def match_expression(text: Column) -> Column:
    """A query's words as quoted phrases, inner quotes doubled; nothing in them is an operator."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))), " ")


def archive_report(found: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row: sessions archived (not known yet and with turns) and skipped, of the sessions found (session_key)."""
    known, spoken = (df.select("session_key").distinct().withColumn(n, F.lit(True)) for df, n in ((sessions, "k"), (turns, "t")))
    rows = found.select("session_key").distinct().join(known, "session_key", "left").join(spoken, "session_key", "left")
    new = F.col("k").isNull() & F.col("t").isNotNull()
    return rows.agg(F.count_if(new).alias("archived"), F.count_if(~new).alias("skipped"))


def session(sessions: DataFrame, turns: DataFrame, keys: DataFrame) -> DataFrame:
    """Sessions of the given keys with their turns in order, as one row each."""
    own = sessions.join(keys.select("session_key").distinct(), "session_key", "left_semi")
    spoken = turns.join(keys.select("session_key").distinct(), "session_key", "left_semi").groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("turn_index", "role", "text"))).alias("turns"))
    return own.join(spoken, "session_key", "left")


def checked_window(since: float | None, until: float | None) -> None:
    if since is not None and until is not None and since > until:
        raise ValueError(f"the window begins after its end: {since} > {until}")


def in_window(c: Column, since: float | None, until: float | None) -> Column:
    """Whether a time lies in a window with both ends included; a missing end is open."""
    checked_window(since, until)
    out = F.lit(True)
    if since is not None:
        out &= c >= since
    return out & (c <= until) if until is not None else out


def snippet(text: Column, phrases: Column, most: int = 12) -> Column:
    """An excerpt of at most `most` words around the first word that begins a phrase's first word, hits in [ ], cut ends as …."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")
    first = F.transform(phrases, lambda p: F.get(words(p), 0))
    hit = lambda w: F.exists(words(w), lambda x: F.array_contains(first, x))

    def cut(own: Column) -> Column:
        at = F.coalesce(F.get(F.filter(F.transform(own, lambda w, i: F.when(hit(w), i)), lambda x: x.isNotNull()), F.lit(0)), F.lit(0))
        begin = F.greatest(F.least(at - most // 2, F.size(own) - most), F.lit(0))
        marked = F.transform(F.slice(own, begin + 1, F.lit(most)), lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
        return F.concat(F.when(begin > 0, "…").otherwise(""), F.array_join(marked, " "), F.when(begin + most < F.size(own), "…").otherwise(""))

    return let(parts, cut)


def episodes(sessions: DataFrame, turns: DataFrame, queries: DataFrame, limit: int, since: float | None = None, until: float | None = None, order: str = "relevance") -> DataFrame:
    """Turns that hold a query's phrases, joined with their sessions, inside the window, best or latest first.

    query_id, rank, session_key, captured_at, role, turn_index, score, snippet. Relevance orders by score, then capture
    time; recency by capture time alone; what is left equal falls to session and turn. Queries of one text are answered once.
    """
    checked_window(since, until)
    kept = sessions.where(in_window(F.col("captured_at"), since, until)).select("session_key", "captured_at")
    asked = queries.where("query is not null").select(F.col("query").alias("query_id"), "query").distinct()
    found = full_text(turns, asked, None).join(kept, "session_key")
    by = [F.desc("captured_at")] if order == "recency" else [F.desc("score"), F.desc("captured_at")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by, "session_key", "turn_index"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= limit).join(turns.select("session_key", "turn_index", "role", "text"), ["session_key", "turn_index"])
    phrases = F.filter(F.split("query", r"\s+"), lambda x: x != "")
    shown = found.withColumnRenamed("query_id", "query").withColumn("snippet", snippet(F.col("text"), phrases))
    return queries.select("query_id", "query").join(shown, "query").select("query_id", "rank", "session_key", "captured_at", "role", "turn_index", "score", "snippet")


def unindexed(turns: DataFrame, index: DataFrame) -> DataFrame:
    """Turns whose id (session_key#turn_index) the index lacks."""
    rows = turns.withColumn("id", F.concat_ws("#", "session_key", "turn_index"))
    return rows.join(index.select("id"), "id", "left_anti")


def recalled(hits: DataFrame, turns: DataFrame, since: float | None = None, until: float | None = None) -> DataFrame:
    """Ranked hits (query_id, id, score, rank) with their turns, of which the window's stay: the cut came before, so fewer may be left."""
    own = turns.withColumn("id", F.concat_ws("#", "session_key", "turn_index"))
    rows = hits.join(own, "id").where(in_window(F.col("captured_at"), since, until))
    return rows.select("query_id", "rank", "session_key", "turn_index", "captured_at", "role", F.col("text").alias("snippet"), "score")


def search_event(queries: DataFrame, results: DataFrame) -> DataFrame:
    """For telemetry: each query's hash (16 hex digits, never its text) and its number of results."""
    n = results.groupBy("query_id").agg(F.count("*").alias("results"))
    return queries.join(n, "query_id", "left").select("query_id", F.substring(F.sha2("query", 256), 1, 16).alias("query_hash"), F.coalesce("results", F.lit(0)).alias("results"))


def well_formed(rows: DataFrame) -> DataFrame:
    """Raw result rows of texts with their types; rows that can't be read are left out."""
    out = rows.select(F.col("session_key"), F.expr("try_cast(captured_at AS double)").alias("captured_at"), "role", F.expr("try_cast(turn_index AS int)").alias("turn_index"), "snippet", (F.lit(0.0) - F.expr("try_cast(bm25 AS double)")).alias("score"))
    return out.where("session_key is not null and captured_at is not null and role is not null and turn_index is not null and snippet is not null and score is not null")


def occurrences(own: DataFrame, phrases: DataFrame) -> DataFrame:
    """p, session_key, turn_index, len and tf: how often each turn (w: its words) has a phrase (p: its words joined by spaces, w: these), where it has."""
    asked = phrases.select("p", F.size("w").alias("n"), F.array_join(F.slice("w", 1, 2), " ").alias("key"))
    lengths = {r[0] for r in asked.select(F.least("n", F.lit(3))).distinct().collect()}  # three at most
    none = F.array().cast("array<struct<pos:int,key:string>>")
    gram = lambda m: F.when(F.size("w") >= m, F.transform(F.sequence(F.lit(0), F.size("w") - m), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("w", i + 1, m), " ").alias("key")))).otherwise(none)
    grams = F.concat(*(gram(m) for m in sorted({min(n, 2) for n in lengths})), none)
    found = own.select("session_key", "turn_index", F.size("w").alias("len"), F.explode_outer(grams).alias("g")).select("session_key", "turn_index", "len", "g.pos", "g.key").join(asked, "key")
    hits = found.where("n <= 2").select("p", "session_key", "turn_index", "len")
    if 3 in lengths:
        rest = found.where("n > 2").join(own, ["session_key", "turn_index"])
        hits = hits.unionByName(rest.where(F.array_join(F.slice("w", F.col("pos") + 1, F.col("n")), " ") == F.col("p")).select("p", "session_key", "turn_index", "len"))
    return hits.groupBy("p", "session_key", "turn_index", "len").agg(F.count("*").alias("tf"))


def full_text(turns: DataFrame, queries: DataFrame, limit: int | None, digits: int = 6) -> DataFrame:
    """Turns that hold every phrase of a query (query_id, query): query_id, session_key, turn_index, score, rank.

    White space parts a query into phrases; a phrase's words must stand next to each other. Phrases and turns meet on the first two words of a
    phrase as one key, longer ones are then compared in the turn's words; each distinct phrase is counted once, however many
    queries have it. Scores sum BM25 over phrases, ties fall to the later turn's key. Without a limit all hits come back, unranked.
    """
    phrase = queries.select("query_id", F.posexplode(F.split(F.trim("query"), r"\s+")).alias("phrase", "p"))
    phrase = phrase.select("query_id", "phrase", words(F.col("p")).alias("w")).where(F.size("w") > 0).withColumn("p", F.array_join("w", " "))
    own = turns.select("session_key", "turn_index", words(F.col("text")).alias("w"))
    sizes = own.agg(F.count("*").alias("turns"), F.avg(F.size("w")).alias("avg_len"))
    tf = occurrences(own, phrase.select("p", "w").distinct())
    df = tf.groupBy("p").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("turns") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = phrase.select("query_id", "phrase", "p").join(tf.join(df, "p"), "p").join(F.broadcast(sizes)).groupBy("query_id", "session_key", "turn_index").agg(F.round(F.sum(part), digits).alias("score"), F.count("*").alias("phrases"))
    need = phrase.groupBy("query_id").agg(F.count("*").alias("phrases"))
    hits = scored.join(need, ["query_id", "phrases"]).drop("phrases")
    if limit is None:
        return hits
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("session_key"), F.desc("turn_index"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
