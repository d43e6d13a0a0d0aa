"""Lift and audit as runs over many changesets, with bundles, reports and verdicts kept as versioned JSON texts.

    bundle = kept_for_lift(changesets, evidence, folder)         # diff to evidence; bundled() has the lines, too
    lifted = lift(bundle, tree, authored)                        # reports (ref, text) and what was refused
    items, refused = read_lifts(kept_reports)                    # (path, text) back to rows
    verdicts, unread = read_verdicts(kept_verdicts)
    audited = audit_reports(originals, items, verdicts)          # reports (ref, text), their records, what was refused

Each function takes any number of changesets; a ref is a string and names one. A text that can't be read, of another version, of
another ref than asked for, or of a ref that a text before it (by path) has, is a row of the refused with its fault, and gives no items: one bad text stops
no other. Null and empty texts are malformed; an empty diff has an empty report; empty tables give empty results; extra columns
are ignored. What one report holds is one row, as its text is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodequery.functions import diff as D
from lodequery.operators import audit, trace

#: The version of all texts, and the fields of each.
VERSION = "1"
TEST = "struct<name:string,path:string,covers_symbol:string>"
ANCHOR = "struct<file:string,lines:array<int>,symbol:string,test:{0},granularity:string,status:string>"
HUNK = "file_path:string,old_range:array<int>,new_range:array<int>,candidate_identifiers:array<string>"
CHANGESET = f"struct<version:string,changeset_ref:string,files:array<struct<path:string,change_type:string,old_path:string,is_binary:boolean,hunks:array<struct<{HUNK},lines:array<string>>>>>>"
AUTHORED = "struct<requirements:array<struct<item:string,quota:string,statement:string>>,open_questions:array<string>>"
# a test may be an object or a text, so it is read as text
LIFT = f"struct<requirements:array<struct<id:string,quota:string,statement:string,anchor:{ANCHOR.format('string')}>>,drifts:array<struct<description:string,anchor:{ANCHOR.format('string')}>>>"
GROUP = "speclift:{0},alignment_confidence:string,verdict:string,verdict_confidence:string,explanation:string,severity:string,detectability:string"
VERDICTS = f"struct<changeset_ref:string,groups:array<struct<original:int,{GROUP.format('array<int>')}>>,extras:array<struct<{GROUP.format('int')}>>,open_questions:array<string>>"
AUDIT = "struct<version:string,changeset_ref:string,records:array<struct<original_ref:string,speclift_refs:array<string>,verdict:string,verdict_confidence:string,risk:struct<severity:string,detectability:string,risk:string>,proposed:boolean,notes:array<string>>>,matrix:struct<counts:map<string,bigint>,records_by_verdict:map<string,array<string>>>,declared_gaps:array<string>,open_questions:array<string>>"


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _list(kind: str, payload: str) -> Column:
    """The payloads of one kind in a group, by place."""
    own = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", payload))))
    return F.transform(own, lambda x: x[payload])


def _place(*parts: Column) -> Column:
    """Four numbers by which the parts of a text are ordered."""
    parts = [*parts, *[F.lit(0)] * (4 - len(parts))]
    return F.struct(*(p.cast("int").alias(f"p{i}") for i, p in enumerate(parts))).alias("place")


def stored(rows: DataFrame, at: str) -> DataFrame:
    """Rows written to a folder that is not there yet and read from it; what reads them several times doesn't make them again."""
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


# ---- changesets and bundles --------------------------------------------------------------------


@dataclass(frozen=True)
class Bundle:
    """refs (ref), files left out (ref, path, reason), evidence items and hunks without evidence."""

    refs: DataFrame
    excluded: DataFrame
    items: DataFrame
    unresolved: DataFrame

    def kept(self, at: str) -> Bundle:
        """The same, written as tables under a folder that is not there yet and read from them, so that what follows doesn't read the diffs again."""
        return Bundle(*(stored(getattr(self, name), f"{at}/{name}") for name in ("refs", "excluded", "items", "unresolved")))


def bundled(changesets: DataFrame, evidence: DataFrame, include_docs: bool = False) -> Bundle:
    """Changesets (ref, text) as evidence: files, those that are no source left out, hunks, symbols, items."""
    return bundled_hunks(changesets.select("ref"), *_read_diff(trace.read_diffs(changesets), include_docs), evidence)


def kept_for_lift(changesets: DataFrame, evidence: DataFrame, at: str, include_docs: bool = False) -> Bundle:
    """The same as far as lift() reads it, kept under a folder that is not there yet: items have no lines.

    Diffs are read once, and what is shuffled and kept of them grows with their hunks and names, not with their lines.
    """
    diffs = stored(trace.read_diffs(changesets, whole=False), f"{at}/diffs")
    return bundled_hunks(diffs.select("ref"), *_read_diff(diffs, include_docs), evidence).kept(at)


def _read_diff(diffs: DataFrame, include_docs: bool) -> tuple[DataFrame, DataFrame]:
    """Files with the reason they are left out, and hunks of the others."""
    sources = F.filter("files", lambda f: D.excluded_reason(f["path"], include_docs).isNull())
    return trace.source_files(trace.read_files(diffs), include_docs), trace.read_hunks(diffs.withColumn("files", sources))


def bundled_hunks(refs: DataFrame, files: DataFrame, hunks: DataFrame, evidence: DataFrame) -> Bundle:
    """The same of changesets that are read already (read_changesets)."""
    items, unresolved = trace.evidence_items(hunks, trace.located(hunks, evidence))
    return Bundle(refs.select("ref"), files.where("reason is not null").select("ref", "file", "path", "reason"), items, unresolved)


def changeset_texts(changesets: DataFrame, include_docs: bool = False) -> DataFrame:
    """ref and text: the sources of each changeset and their hunks as JSON, for whoever locates evidence elsewhere."""
    files, hunks = _read_diff(trace.read_diffs(changesets), include_docs)
    pair = lambda side: F.array(f"{side}_start", f"{side}_len")
    one = F.struct("hunk", F.struct(F.col("path").alias("file_path"), pair("old").alias("old_range"), pair("new").alias("new_range"), F.col("identifiers").alias("candidate_identifiers"), "lines").alias("h"))
    own = hunks.groupBy("ref", "file").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["h"]).alias("hunks"))
    row = F.struct("file", F.struct("path", "change_type", "old_path", "is_binary", F.coalesce("hunks", F.array().cast(own.schema["hunks"].dataType)).alias("hunks")).alias("f"))
    parts = files.where("reason is null").join(own, ["ref", "file"], "left").groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["f"]).alias("files"))
    told = changesets.select("ref").join(parts, "ref", "left")
    return told.select("ref", _json(F.struct(F.lit(VERSION).alias("version"), F.col("ref").alias("changeset_ref"), F.coalesce("files", F.array().cast(parts.schema["files"].dataType)).alias("files"))).alias("text"))


def read_changesets(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """refs, files, hunks (as diff_hunks gives them, files numbered as they stand) and the refused, of kept changesets (path, text)."""
    good, bad = _sound(texts)
    rows = good.select("ref", F.from_json("text", CHANGESET).alias("x"))
    files = rows.select("ref", F.posexplode("x.files").alias("file", "f"))
    at = lambda field, i: F.get(F.col(f"h.{field}"), F.lit(i))
    hunks = files.where("not coalesce(f.is_binary, false)").select("ref", "file", F.posexplode("f.hunks").alias("hunk", "h")).select(
        "ref", "file", "hunk", F.col("h.lines").alias("lines"), F.coalesce("h.candidate_identifiers", F.array().cast("array<string>")).alias("identifiers"), at("old_range", 0).alias("old_start"), at("old_range", 1).alias("old_len"),
        at("new_range", 0).alias("new_start"), at("new_range", 1).alias("new_len"), F.col("h.file_path").alias("path"),
    )
    return rows.select("ref"), files.select("ref", "file", "f.path", "f.old_path", "f.change_type", "f.is_binary", F.lit(None).cast("string").alias("reason")), hunks, bad


def read_evidence(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence that was located elsewhere, of JSON maps (text) from `path::query` to symbols and from symbols to tests.

    Gives (path, query, name, symbol_path, line, place) as trace.located() takes it, of a name and path the first, and tests (symbol, test_path, name, place). Texts
    that can't be read give none, as a query that found nothing does.
    """
    shape = "struct<symbols:map<string,array<struct<name:string,path:string,line:int>>>,tests:map<string,array<struct<name:string,path:string>>>>"
    rows = texts.select(F.from_json("text", shape).alias("x"))
    found = rows.select(F.explode("x.symbols").alias("key", "own")).select("key", F.posexplode("own").alias("place", "s")).where("instr(key, '::') > 0")
    cut = F.regexp_extract("key", r"(?s)^(.*?)::(.*)$", 1), F.regexp_extract("key", r"(?s)^(.*?)::(.*)$", 2)
    first = found.groupBy(cut[0].alias("path"), cut[1].alias("query"), F.col("s.name").alias("name"), F.col("s.path").alias("symbol_path")).agg(F.min(F.struct("place", F.coalesce("s.line", F.lit(0)).alias("line"))).alias("x"))
    tests = rows.select(F.explode("x.tests").alias("symbol", "own")).select("symbol", F.posexplode("own").alias("place", "t")).groupBy("symbol", F.col("t.path").alias("test_path")).agg(F.min(F.struct("place", F.col("t.name").alias("name"))).alias("x"))
    return first.select("path", "query", "name", "symbol_path", "x.line", "x.place"), tests.select("symbol", "test_path", "x.name", "x.place")


# ---- texts that say their version and ref ------------------------------------------------------


def _sound(texts: DataFrame, wanted: DataFrame | None = None, version: bool = True, fault: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Texts (path, text) that can be used, with their ref, and the others: path, ref, fault. wanted (path, ref) names the ref each path should have."""
    v = F.try_parse_json("text")
    rows = texts.select("path", "text", v.alias("_v"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    ref = F.when(kind("$.changeset_ref") == "STRING", F.try_variant_get("_v", "$.changeset_ref", "string"))
    rows = rows.withColumn("ref", ref)
    if wanted is not None:
        rows = rows.join(wanted.select("path", F.col("ref").alias("_wanted")), "path", "left")
    else:
        rows = rows.withColumn("_wanted", F.lit(None).cast("string"))
    told = F.when(F.col("_v").isNull() | ~F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), "malformed")
    if version:
        told = told.when((F.coalesce(kind("$.version"), F.lit("")) != "STRING") | (F.try_variant_get("_v", "$.version", "string") != VERSION), "version")
    told = told.when(F.coalesce("ref", F.lit("")) == "", "no ref").when(F.col("_wanted") != F.col("ref"), "other ref")
    if fault is not None:
        told = told.when(fault, "malformed")
    rows = rows.withColumn("fault", told)
    # of a ref the first sound text counts
    again = F.row_number().over(Window.partitionBy("ref", F.when(F.col("ref").isNull(), F.col("path"))).orderBy("fault", "path", F.xxhash64("text"))) > 1
    rows = rows.withColumn("fault", F.when(F.col("fault").isNull() & F.col("ref").isNotNull() & again, "repeated").otherwise(F.col("fault")))
    return rows.where("fault is null").select("path", "ref", "text"), rows.where("fault is not null").select("path", "ref", "fault")


# ---- the lift ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lift:
    """reports (ref, text) and refused (ref, place, fault)."""

    reports: DataFrame
    refused: DataFrame


def read_authored(texts: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requirements written for bundles, of JSON texts (ref, text): with the anchors of the items they name, open questions, and faults (ref, place, fault).

    Faults: malformed, item (not one of the bundle's), quota, statement. A lift with any is refused as a whole.
    """
    v = F.try_parse_json("text")
    rows = texts.select("ref", "text", v.alias("_v"))
    broken = F.col("_v").isNull() | ~F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT"))
    parsed = rows.where(~broken).select("ref", F.from_json("text", AUTHORED).alias("x"))
    own = parsed.select("ref", F.posexplode("x.requirements").alias("place", "r")).select("ref", "place", F.when(F.rlike("r.item", F.lit(r"^[0-9]{1,9}$")), F.col("r.item")).cast("int").alias("item"), "r.quota", F.trim("r.statement").alias("statement"))
    anchors = items.select("ref", "item", "path", "symbol", "start_line", "end_line", "granularity", F.lit(True).alias("_known"))
    own = own.join(anchors, ["ref", "item"], "left")
    fault = F.when(F.col("_known").isNull(), "item").when(~F.coalesce(F.col("quota").isin(*trace.QUOTAS), F.lit(False)), "quota").when(F.coalesce("statement", F.lit("")) == "", "statement")
    own = own.withColumn("fault", fault)
    faults = own.where("fault is not null").select("ref", "place", "fault").unionByName(rows.where(broken).select("ref", F.lit(0).alias("place"), F.lit("malformed").alias("fault")))
    number = F.col("item").cast("string")
    ids = F.concat(F.lit("REQ-"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")), F.lit("-"), "quota")
    good = own.where("fault is null").select("ref", "place", ids.alias("id"), "quota", "item", "statement", "path", "symbol", "start_line", "end_line", "granularity")
    return good, parsed.select("ref", F.posexplode("x.open_questions").alias("place", "question")), faults


def _cited(path: str = "path", symbol: str = "symbol") -> Column:
    where = F.concat(F.col(path), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return F.when(F.col(symbol).isNotNull(), F.concat(symbol, F.lit(" ("), where, F.lit(")"))).otherwise(where)


def _anchor(status: str) -> Column:
    return F.struct(F.col("path").alias("file"), F.array("start_line", "end_line").alias("lines"), "symbol", F.lit(None).cast(TEST).alias("test"), "granularity", F.lit(status).alias("status"))


def lift(bundle: Bundle, tree: DataFrame, authored: DataFrame | None = None, at: str | None = None) -> Lift:
    """From evidence to reports: requirements, their anchors held against the tree, drift, what was left out and open questions.

    tree: lines (ref, path, n from 1, line) of each changeset's files. authored: JSON texts (ref, text) of those who wrote the requirements; a changeset
    without one has a placeholder for each item and quota. The bundle should be a kept one: its items are read a dozen times. A changeset whose text is at fault has no report but rows of refused.
    at: a folder that is not there yet, for what is read several times on the way, which makes the plan a small one.
    """
    held_at = lambda rows, name: rows if at is None else stored(rows, f"{at}/{name}")
    spark = bundle.refs.sparkSession
    texts = authored.select("ref", "text") if authored is not None else spark.createDataFrame([], "ref string, text string")
    written, asked, faults = read_authored(texts, bundle.items)
    known = faults.join(bundle.refs.select("ref", F.lit(True).alias("_known")).distinct(), "ref", "left")
    refused = held_at(known.select("ref", "place", F.when(F.col("_known"), F.col("fault")).otherwise("no changeset").alias("fault")).distinct(), "refused")
    stopped = refused.select("ref").distinct()
    refs, items, unresolved, excluded = (x.join(stopped, "ref", "left_anti") for x in (bundle.refs, bundle.items, bundle.unresolved, bundle.excluded))
    items = held_at(items.select("ref", "item", "path", "symbol", "granularity", "start_line", "end_line"), "items")
    placeholders = trace.placeholder_requirements(items.join(texts.select("ref"), "ref", "left_anti"))
    placeholders = placeholders.join(items.select("ref", "item", "granularity"), ["ref", "item"]).withColumn("place", F.col("item") * len(trace.QUOTAS) + audit.order_of(F.col("quota"), trace.QUOTAS))
    requirements = placeholders.withColumn("place", F.col("place").cast("int")).select(*written.columns).unionByName(written.join(stopped, "ref", "left_anti"))
    key = lambda: F.to_json(F.struct("ref", "path"))
    anchors = items.select(
        F.to_json(F.struct("ref", "item")).alias("anchor"), key().alias("path"), "start_line", "end_line", "symbol", F.lit(None).cast("string").alias("test_path"), F.lit(None).cast("string").alias("covers"),
    )
    sure = trace.verified(anchors, tree.select(key().alias("path"), "n", "line")).where("verified").select(F.col("anchor"))
    sure = sure.select(F.get_json_object("anchor", "$.ref").alias("ref"), F.get_json_object("anchor", "$.item").cast("int").alias("item"), F.lit(True).alias("sure"))
    held = held_at(requirements.join(sure, ["ref", "item"], "left"), "requirements")
    requirements = held.drop("sure")
    confirmed = held.where("sure")
    one = F.struct("id", "quota", "statement", _anchor("verified").alias("anchor"), F.concat(F.lit("item-"), F.col("item").cast("string")).alias("source_item"))
    a = confirmed.select("ref", F.lit("requirement").alias("kind"), _place(F.col("place")), one.alias("requirement"))
    out = held.where("sure is null").select("ref", F.lit("excluded").alias("kind"), _place(F.col("place")), F.struct("statement", F.concat(F.lit("anchor not verified: "), _cited()).alias("reason")).alias("excluded"))
    loose = trace.drift(items, unresolved, confirmed, more=True)
    told = F.struct(F.concat(F.lit("no requirement covers the change in "), _cited()).alias("description"), _anchor("unverified").alias("anchor"), F.lit("proposed").alias("status"))
    b = loose.select("ref", F.lit("drift").alias("kind"), _place(F.col("place.what"), F.col("place.a"), F.col("place.b")), told.alias("drift"))
    lacking = trace.missing_quotas(items, requirements).join(items.select("ref", "item", "path", "start_line"), ["ref", "item"])
    note = F.concat(F.lit("no requirement of quota "), "quota", F.lit(" for item-"), F.col("item").cast("string"), F.lit(" ("), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit(")"))
    questions = (
        asked.join(stopped, "ref", "left_anti").select("ref", _place(F.lit(0), F.col("place")), "question")
        .unionByName(lacking.select("ref", _place(F.lit(1), F.col("item"), audit.order_of(F.col("quota"), trace.QUOTAS)), note.alias("question")))
        .unionByName(excluded.select("ref", _place(F.lit(2), F.col("file")), F.concat(F.lit("left out as "), "reason", F.lit(": "), "path").alias("question")))
    )
    parts = a
    for x in (out, b, questions.withColumn("kind", F.lit("question")), refs.select("ref", F.lit("ref").alias("kind"), _place())):
        parts = parts.unionByName(x, allowMissingColumns=True)
    whole = F.struct(
        F.lit(VERSION).alias("version"), F.col("ref").alias("changeset_ref"), _list("requirement", "requirement").alias("requirements"), _list("drift", "drift").alias("drifts"),
        _list("excluded", "excluded").alias("excluded"), _list("question", "question").alias("open_questions"),
    )
    return Lift(parts.groupBy("ref").agg(_json(whole).alias("text")), refused)


def read_lifts(texts: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lifted items of kept reports (path, text), requirements before drifts under dense indexes, and the refused: path, ref, fault.

    Items: ref, index, origin, id, quota, statement, path, start_line, end_line, symbol, verified, anchor. Faults: malformed (also of one item), version, no ref, other ref
    (than wanted (path, ref) says), repeated.
    """
    x = F.from_json("text", LIFT)
    poor = lambda a, text: a.isNull() | a[text].isNull() | a["anchor"]["file"].isNull() | (F.coalesce(F.size(F.filter(a["anchor"]["lines"], lambda n: n.isNotNull())), F.lit(0)) < 2) | a["anchor"]["granularity"].isNull() | a["anchor"]["status"].isNull()
    none = F.lit(False)
    fault = F.coalesce(F.exists(x["requirements"], lambda a: poor(a, "statement")), none) | F.coalesce(F.exists(x["drifts"], lambda a: poor(a, "description")), none)
    good, bad = _sound(texts, wanted, fault=fault)
    rows = good.select("ref", F.from_json("text", LIFT).alias("x"))
    null = F.lit(None).cast("string")
    shaped = lambda field, origin, text: F.coalesce(F.transform(F.col(f"x.{field}"), lambda a: F.struct(F.lit(origin).alias("origin"), (a["id"] if origin == "requirement" else null).alias("id"), (a["quota"] if origin == "requirement" else null).alias("quota"), a[text].alias("statement"), a["anchor"].alias("a"))), F.array())  # noqa: E731, E501
    own = rows.select("ref", F.posexplode(F.concat(shaped("requirements", "requirement", "statement"), shaped("drifts", "drift", "description"))).alias("index", "i"))
    raw = F.col("i.a.test")
    name, path = F.get_json_object(raw, "$.name"), F.get_json_object(raw, "$.path")
    test = F.when(F.startswith(raw, F.lit("{")), F.when(name.isNotNull() | path.isNotNull(), F.concat(F.coalesce(path, F.lit("")), F.lit("::"), F.coalesce(name, F.lit(""))))).otherwise(raw)
    anchor = F.struct(F.col("i.a.file").alias("file"), F.col("i.a.lines").alias("lines"), F.col("i.a.symbol").alias("symbol"), test.alias("test"), F.col("i.a.granularity").alias("granularity"), F.col("i.a.status").alias("status"))
    items = own.select(
        "ref", "index", "i.origin", "i.id", "i.quota", "i.statement", F.col("i.a.file").alias("path"), F.get("i.a.lines", F.lit(0)).alias("start_line"), F.get("i.a.lines", F.lit(1)).alias("end_line"),
        F.nullif(F.col("i.a.symbol"), F.lit("")).alias("symbol"), (F.col("i.a.status") != "unverified").alias("verified"), anchor.alias("anchor"),
    )
    return items, bad


# ---- the audit ---------------------------------------------------------------------------------


def verdict_texts(verdicts: DataFrame, refs: DataFrame) -> DataFrame:
    """ref and text: verdicts (columns of audit.placeholder_verdicts) as JSON, one text a ref, groups and extras by index."""
    shared = ("explanation", "severity", "detectability")
    group = F.struct("original", F.col("lifted").alias("speclift"), F.col("alignment").alias("alignment_confidence"), "verdict", F.col("confidence").alias("verdict_confidence"), *shared)
    extra = F.struct(F.get("lifted", F.lit(0)).alias("speclift"), "verdict", F.col("confidence").alias("verdict_confidence"), *shared)
    extras = F.col("original").isNull()
    rows = verdicts.select("ref", F.when(extras, "extra").otherwise("group").alias("kind"), _place(F.coalesce("original", F.get("lifted", F.lit(0)))), F.when(~extras, group).alias("group"), F.when(extras, extra).alias("extra"))
    rows = rows.unionByName(refs.select("ref", F.lit("ref").alias("kind"), _place()), allowMissingColumns=True)
    whole = F.struct(F.col("ref").alias("changeset_ref"), _list("group", "group").alias("groups"), _list("extra", "extra").alias("extras"), F.array().cast("array<string>").alias("open_questions"))
    return rows.groupBy("ref").agg(_json(whole).alias("text"))


def read_verdicts(texts: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verdicts of kept texts (path, text) as audit.records() takes them, open questions (ref, place, question), and the refused: path, ref, fault.

    A verdict or level that is none, or an index that is no number, makes its text malformed; so do missing lists.
    """
    x = F.from_json("text", VERDICTS)
    level = lambda c, need: ~F.coalesce(c.isin(*audit.LEVELS), F.lit(not need))
    poor = lambda a: ~F.coalesce(a["verdict"].isin(*audit.VERDICTS), F.lit(False)) | level(a["verdict_confidence"], True) | level(a["severity"], False) | level(a["detectability"], False)
    group = lambda a: a["original"].isNull() | poor(a) | level(a["alignment_confidence"], True) | F.coalesce(F.exists(a["speclift"], lambda n: n.isNull()), F.lit(False))
    none = F.lit(True)
    fault = F.coalesce(F.exists(x["groups"], group), none) | F.coalesce(F.exists(x["extras"], lambda a: a["speclift"].isNull() | poor(a)), none)
    good, bad = _sound(texts, wanted, version=False, fault=fault)
    rows = good.select("ref", F.from_json("text", VERDICTS).alias("x"))
    told = lambda a: [a["verdict"].alias("verdict"), a["verdict_confidence"].alias("confidence")]
    rest = lambda a: [a[c].alias(c) for c in ("severity", "detectability", "explanation")]
    groups = F.transform("x.groups", lambda a: F.struct(a["original"].alias("original"), F.coalesce(a["speclift"], F.array().cast("array<int>")).alias("lifted"), *told(a), a["alignment_confidence"].alias("alignment"), *rest(a)))
    extras = F.transform("x.extras", lambda a: F.struct(F.lit(None).cast("int").alias("original"), F.array(a["speclift"]).alias("lifted"), *told(a), F.lit(None).cast("string").alias("alignment"), *rest(a)))
    return rows.select("ref", F.explode(F.concat(groups, extras)).alias("v")).select("ref", "v.*"), rows.select("ref", F.posexplode("x.open_questions").alias("place", "question")), bad


@dataclass(frozen=True)
class Audit:
    """reports (ref, text), records (audit.records and more) and refused (ref, side, index, fault)."""

    reports: DataFrame
    records: DataFrame
    refused: DataFrame


def audit_reports(original: DataFrame, lifted: DataFrame, verdicts: DataFrame, asked: DataFrame | None = None, refs: DataFrame | None = None, at: str | None = None) -> Audit:
    """Audits of all changesets that refs (ref; by default those with an item or a verdict) names and that have no fault.

    original: requirements (ref, index, id); lifted: items of read_lifts; verdicts and open questions (asked) of read_verdicts. A ref without original requirements
    says so as a declared gap; one with any fault (audit.faults) has no report but rows of refused. at: a folder that is not there yet, for what is read several times.
    """
    held_at = lambda rows, name: rows if at is None else stored(rows, f"{at}/{name}")
    refs = (refs if refs is not None else lifted.select("ref").union(verdicts.select("ref"))).select("ref").distinct()
    original, lifted, verdicts = (x.join(refs, "ref", "left_semi") for x in (original, lifted, verdicts))
    refused = held_at(audit.faults(original, lifted, verdicts), "refused")
    sound = refs.join(refused.select("ref").distinct(), "ref", "left_anti")
    original, lifted, verdicts = (x.join(sound, "ref", "left_semi") for x in (original, lifted, verdicts))
    records = audit.records(original, lifted, verdicts, more=True)
    risk = F.when(F.col("risk").isNotNull(), F.struct("severity", "detectability", "risk"))
    row = F.struct(
        F.when(F.col("original_ref").isNotNull(), F.col("original_ref")).alias("original_ref"), F.col("lifted_refs").alias("speclift_refs"), "verdict", "explanation", F.col("confidence").alias("verdict_confidence"),
        F.col("alignment").alias("alignment_confidence"), "anchors", risk.alias("risk"), "proposed", "notes",
    )
    parts = records.select("ref", F.lit("record").alias("kind"), _place(F.col("rank")), row.alias("record"), "record_ref")
    bare = sound.join(original.select("ref").distinct(), "ref", "left_anti").select("ref", F.lit("gap").alias("kind"), _place(), F.lit("original_source: absent").alias("line"))
    parts = parts.unionByName(bare, allowMissingColumns=True).unionByName(sound.select("ref", F.lit("ref").alias("kind"), _place()), allowMissingColumns=True)
    if asked is not None:
        parts = parts.unionByName(asked.join(sound, "ref", "left_semi").select("ref", F.lit("question").alias("kind"), _place(F.col("place")), F.col("question").alias("line")), allowMissingColumns=True)
    own = parts.groupBy("ref").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "record", F.struct("place", F.col("record.verdict").alias("v"), "record_ref")))).alias("named"),
        _list("record", "record").alias("records"), _list("gap", "line").alias("declared_gaps"), _list("question", "line").alias("open_questions"),
    )
    of = lambda v: F.filter("named", lambda n: n["v"] == v)
    table = lambda f: F.map_from_arrays(F.array(*map(F.lit, audit.VERDICTS)), F.array(*(f(of(v)) for v in audit.VERDICTS)))
    matrix = F.struct(table(F.size).alias("counts"), table(lambda x: F.transform(x, lambda n: n["record_ref"])).alias("records_by_verdict"))
    whole = F.struct(F.lit(VERSION).alias("version"), F.col("ref").alias("changeset_ref"), "records", matrix.alias("matrix"), "declared_gaps", "open_questions")
    return Audit(own.select("ref", _json(whole).alias("text")), records, refused)


def read_audits(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept audits (path, text) as ref and x, the report as a struct (AUDIT), and the refused: path, ref, fault."""
    good, bad = _sound(texts)
    return good.select("ref", F.from_json("text", AUDIT).alias("x")), bad


# ---- Markdown ----------------------------------------------------------------------------------


def _lines(rows: Column, each) -> Column:
    """One text of the lines of each row, none of a null list."""
    return F.coalesce(F.array_join(F.transform(rows, each), ""), F.lit(""))


def _titled(rows: Column, title: str, body: Column) -> Column:
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n"))).otherwise("")


def lift_pages(reports: DataFrame) -> DataFrame:
    """ref and Markdown of lift reports (ref, text), told from the JSON alone."""
    shape = f"struct<requirements:array<struct<id:string,quota:string,statement:string,anchor:{ANCHOR.format(TEST)}>>,drifts:array<struct<description:string,anchor:{ANCHOR.format(TEST)}>>,excluded:array<struct<statement:string,reason:string>>,open_questions:array<string>>"
    x = lambda field: F.col(f"x.{field}")
    label = lambda a: F.concat(a["file"], F.lit(":"), F.get(a["lines"], F.lit(0)).cast("string"), F.lit("-"), F.get(a["lines"], F.lit(1)).cast("string"), F.coalesce(F.concat(F.lit(" ["), a["symbol"], F.lit("]")), F.lit("")), F.coalesce(F.concat(F.lit(" (test: "), a["test"]["path"], F.lit(")")), F.lit("")))  # noqa: E731, E501
    needs = _lines(x("requirements"), lambda r: F.concat(F.lit("## "), r["id"], F.lit(" · "), r["quota"], F.lit("\n\n"), r["statement"], F.lit("\n\n- **Anchor**: `"), label(r["anchor"]), F.lit("` ("), r["anchor"]["status"], F.lit(")\n\n")))
    loose = _lines(x("drifts"), lambda r: F.concat(F.lit("- _(proposed)_ "), r["description"], F.lit(" — `"), label(r["anchor"]), F.lit("`\n")))
    out = _lines(x("excluded"), lambda r: F.concat(F.lit("- "), r["statement"], F.lit(" — "), r["reason"], F.lit("\n")))
    asked = _lines(x("open_questions"), lambda q: F.concat(F.lit("- "), q, F.lit("\n")))
    page = F.concat(
        F.lit("# Requirements of `"), "ref", F.lit("`\n\n"), F.when(needs == "", "_No confirmed requirement._\n\n").otherwise(needs), _titled(x("drifts"), "Proposed drift", loose),
        _titled(x("excluded"), "Excluded requirements", out), _titled(x("open_questions"), "Open questions", asked),
    )
    return reports.select("ref", F.from_json("text", shape).alias("x")).select("ref", F.concat(F.rtrim(F.regexp_replace(page, r"\n+\z", "")), F.lit("\n")).alias("text"))


def audit_pages(audits: DataFrame) -> DataFrame:
    """ref and Markdown of audits (ref, x of read_audits): matrix, gaps, verdicts by risk, questions."""
    x = lambda field: F.col(f"x.{field}")
    counts = F.concat(*(F.concat(F.lit(f"| {v} | "), F.coalesce(F.try_element_at(x("matrix.counts"), F.lit(v)), F.lit(0)).cast("string"), F.lit(" |\n")) for v in ("SODDISFATTO", "PARZIALE", "MANCANTE", "DRIFTED", "NON_DOCUMENTATO")))
    gaps = _lines(x("declared_gaps"), lambda g: F.concat(F.lit("- "), g, F.lit("\n")))
    lit = F.lit
    one = lambda r, i: F.concat(
        lit("### "), (i + 1).cast("string"), lit(". "), F.coalesce(r["original_ref"], lit("(undocumented)")), lit(" — **"), r["verdict"], lit("**"), F.when(r["proposed"], " _(proposed)_").otherwise(""), lit("\n\n- **Confidence**: "), r["verdict_confidence"], lit("\n"),
        F.coalesce(F.concat(lit("- **Risk**: "), r["risk"]["risk"], lit(" (severity "), r["risk"]["severity"], lit(", detectability "), r["risk"]["detectability"], lit(")\n")), lit("")),
        F.when(F.size(r["speclift_refs"]) > 0, F.concat(lit("- **Items**: `"), F.array_join(r["speclift_refs"], "`, `"), lit("`\n"))).otherwise("- **Items**: none\n"), F.array_join(F.transform(r["notes"], lambda n: F.concat(lit("- _note_: "), n, lit("\n"))), ""), lit("\n"),
    )
    verdicts = F.coalesce(F.array_join(F.transform(x("records"), one), ""), lit(""))
    asked = _lines(x("open_questions"), lambda q: F.concat(F.lit("- "), q, F.lit("\n")))
    page = F.concat(lit("# Audit of `"), "ref", lit("`\n\n## Matrix\n\n| Verdict | Count |\n|---|---|\n"), counts, lit("\n"), _titled(x("declared_gaps"), "Declared gaps", gaps), lit("## Verdicts by risk\n\n"), verdicts, _titled(x("open_questions"), "Open questions", asked))
    return audits.select("ref", F.concat(F.regexp_replace(page, r"\n+\z", ""), lit("\n")).alias("text"))
