"""Audits that align original requirements with lifted items: bundles, placeholder verdicts, checks, records and their matrix.

Requirements and items carry dense indexes from 0 within their changeset (ref). Null texts read as empty ones; empty tables give
empty results; indexes that repeat or are missing are what faults() reports; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions.diff import lines_of
from lodequery.functions.text import let

#: Verdicts by severity, and the levels of confidence, severity, detectability and risk.
VERDICTS = ("SODDISFATTO", "NON_DOCUMENTATO", "MANCANTE", "PARZIALE", "DRIFTED")
LEVELS = ("bassa", "media", "alta")
MET, UNDOCUMENTED, MISSING = VERDICTS[0], VERDICTS[1], VERDICTS[2]


def order_of(c: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), c) - 1


def requirement_bullets(docs: DataFrame, prefixes: tuple[str, ...] = ("REQ-", "FR-")) -> DataFrame:
    """Requirements of Markdown texts (path, text): path, place (from 0), id and text with the lines that continue the bullet.

    A bullet is `- **REQ-1** ...`; it ends before a blank line, a heading or any bold bullet. Each text is read where it lies, so paths must be unique.
    """
    bullet = rf"^\s*[-*]\s+\*\*((?:{'|'.join(r'\Q' + p + r'\E' for p in prefixes)})[A-Za-z0-9]+)\*\*"
    rows = F.transform(lines_of(F.col("text")), lambda x: F.struct(F.regexp_extract(x, bullet, 1).alias("id"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("line")))
    begins = lambda r: (r["id"] != "") | (r["line"] == "") | F.rlike(r["line"], F.lit(r"^#|^[-*]\s+\*\*"))

    def parts(own: Column) -> Column:
        at = F.filter(F.transform(own, lambda r, i: F.when(begins(r), i + 1)), lambda i: i.isNotNull())
        ends = let(at, lambda a: F.transform(a, lambda x, k: F.struct(x.alias("begin"), F.coalesce(F.get(a, k + 1), F.size(own) + 1).alias("end"), F.get(own, x - 1)["id"].alias("id"))))
        text = lambda p: F.array_join(F.transform(F.slice(own, p["begin"], p["end"] - p["begin"]), lambda r: r["line"]), " ")
        return F.transform(F.filter(ends, lambda p: p["id"] != ""), lambda p: F.struct(p["id"].alias("id"), text(p).alias("text")))

    return docs.select("path", F.posexplode(let(rows, parts)).alias("place", "x")).select("path", "x.id", "x.text", "place")


def source_status(docs: DataFrame, bullets: DataFrame) -> DataFrame:
    """One row: absent (no document), present-but-empty (no bullet) or found, with both counts."""
    n = docs.agg(F.count("*").alias("documents")).join(bullets.agg(F.count("*").alias("requirements")))
    return n.withColumn("status", F.when(F.col("documents") == 0, "absent").when(F.col("requirements") == 0, "present-but-empty").otherwise("found"))


def indexed(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with a dense index from 0 within each ref, in the given order."""
    return rows.withColumn("index", F.row_number().over(Window.partitionBy("ref").orderBy(*order)) - 1)


def placeholder_verdicts(original: DataFrame, lifted: DataFrame) -> DataFrame:
    """Requirements and items paired by index: met where both are, missing or undocumented where one is alone."""
    rows = original.select("ref", "index", F.lit(True).alias("o")).join(lifted.select("ref", "index", F.lit(True).alias("s")), ["ref", "index"], "full")
    both, alone = F.col("o").isNotNull() & F.col("s").isNotNull(), F.col("o").isNotNull()
    return rows.select(
        "ref", F.when(alone, F.col("index")).alias("original"), F.when(F.col("s").isNotNull(), F.array("index")).otherwise(F.array().cast("array<int>")).alias("lifted"),
        F.when(both, MET).when(alone, MISSING).otherwise(UNDOCUMENTED).alias("verdict"), F.when(both, "media").otherwise("bassa").alias("confidence"),
        F.when(alone, "media").alias("alignment"), F.when(both, None).when(alone, "media").otherwise("bassa").alias("severity"), F.when(both, None).otherwise("media").alias("detectability"),
        F.when(both, None).when(alone, "no item is aligned with this requirement").otherwise("no original requirement for this item").alias("explanation"),
    )


def faults(original: DataFrame, lifted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """ref, side, index and fault: dangling (no such index), uncovered or repeated (not exactly once), unexplained (a verdict that must say why or how grave)."""
    used_o = verdicts.where("original is not null").select("ref", F.lit("original").alias("side"), F.col("original").alias("index"))
    used_s = verdicts.select("ref", F.lit("lifted").alias("side"), F.explode("lifted").alias("index"))
    used = used_o.unionByName(used_s).groupBy("ref", "side", "index").agg(F.count("*").alias("n"))
    known = original.select("ref", F.lit("original").alias("side"), "index", F.lit(True).alias("known")).unionByName(lifted.select("ref", F.lit("lifted").alias("side"), "index", F.lit(True).alias("known")))
    fault = F.when(F.col("known").isNull(), "dangling").when(F.col("n").isNull(), "uncovered").when(F.col("n") > 1, "repeated")
    rows = known.join(used, ["ref", "side", "index"], "full").select("ref", "side", "index", fault.alias("fault")).where("fault is not null")
    mute = (F.col("verdict") != MET) & ((F.trim(F.coalesce("explanation", F.lit(""))) == "") | F.col("severity").isNull() | F.col("detectability").isNull())
    return rows.unionByName(verdicts.where(mute).select("ref", F.lit("verdict").alias("side"), F.coalesce("original", F.get("lifted", F.lit(0))).alias("index"), F.lit("unexplained").alias("fault")))


def risk(severity: Column, detectability: Column) -> Column:
    """High where a grave fault is hard to notice: severity plus the want of detectability."""
    score = order_of(severity, LEVELS) + 2 - order_of(detectability, LEVELS)
    return F.when(score >= 3, LEVELS[2]).when(score == 2, LEVELS[1]).when(score.isNotNull(), LEVELS[0])


def clamped(confidence: Column, alignment: Column) -> Column:
    """A verdict is no surer than the alignment it rests on, where that is weak."""
    return F.when(alignment == LEVELS[0], F.lit(LEVELS[0])).otherwise(confidence)


def records(original: DataFrame, lifted: DataFrame, verdicts: DataFrame, more: bool = False) -> DataFrame:
    """Audit records: verdict, clamped confidence, references, risk and notes, with their rank within the ref.

    Rank: by falling risk, then falling severity of the verdict, groups before extras, then index. lifted rows carry path,
    start_line, end_line, symbol and verified; references and notes keep the order of a verdict's items. more adds explanation,
    alignment, severity, detectability and anchors (those of lifted rows, which then carry an anchor each).
    """
    place = F.concat(F.col("path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    cited = lifted.select("ref", F.col("index").alias("_s"), F.when(F.col("symbol").isNotNull(), F.concat("symbol", F.lit(" ("), place, F.lit(")"))).otherwise(place).alias("cite"), F.when(~F.col("verified"), place).alias("doubt"), *(["anchor"] if more else []))
    numbered = verdicts.withColumn("_v", F.when(F.col("original").isNotNull(), F.col("original")).otherwise(F.get("lifted", F.lit(0)))).withColumn("_extra", F.col("original").isNull())
    parts = numbered.select("ref", "_v", "_extra", F.posexplode("lifted").alias("_p", "_s")).join(cited, ["ref", "_s"])
    own = parts.groupBy("ref", "_v", "_extra").agg(F.array_sort(F.collect_list(F.struct("_p", "cite", "doubt", *(["anchor"] if more else [])))).alias("x"))
    rows = numbered.join(own, ["ref", "_v", "_extra"], "left").join(original.select("ref", F.col("index").alias("original"), F.col("id").alias("original_ref")), ["ref", "original"], "left")
    x = F.coalesce("x", F.slice("x", 1, 0), F.array().cast(own.schema["x"].dataType))
    weak = (F.col("alignment") == LEVELS[0]) & (F.col("confidence") != LEVELS[0])
    notes = F.concat(F.transform(F.filter(x, lambda r: r["doubt"].isNotNull()), lambda r: F.concat(F.lit("unverified anchor: "), r["doubt"])), F.when(weak, F.array(F.concat(F.lit("confidence lowered, was "), "confidence"))).otherwise(F.array().cast("array<string>")))
    out = rows.withColumn("risk", F.when(F.col("verdict") != MET, risk(F.col("severity"), F.col("detectability"))))
    rank = F.coalesce(order_of(F.col("risk"), LEVELS) + 1, F.lit(0))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc(rank), F.desc(order_of(F.col("verdict"), VERDICTS)), "_extra", "_v")))
    refs = F.transform(x, lambda r: r["cite"])
    return out.select(
        "ref", "rank", "verdict", clamped(F.col("confidence"), F.coalesce("alignment", F.lit(""))).alias("confidence"), "original_ref", refs.alias("lifted_refs"), "risk",
        (F.col("verdict") == "DRIFTED").alias("proposed"), notes.alias("notes"), F.coalesce("original_ref", F.get(refs, F.lit(0)), F.lit("(none)")).alias("record_ref"),
        *(["explanation", "alignment", "severity", "detectability", F.transform(x, lambda r: r["anchor"]).alias("anchors")] if more else []),
    )


def matrix(record_rows: DataFrame) -> DataFrame:
    """For each ref and verdict the number of records, zeros included, and their references by rank."""
    every = record_rows.select("ref").distinct().withColumn("verdict", F.explode(F.array(*map(F.lit, VERDICTS))))
    own = record_rows.groupBy("ref", "verdict").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "record_ref"))).alias("x"))
    refs = F.coalesce(F.transform("x", lambda r: r["record_ref"]), F.array().cast("array<string>"))
    return every.join(own, ["ref", "verdict"], "left").select("ref", "verdict", F.coalesce("n", F.lit(0)).alias("n"), refs.alias("refs"))
