"""Evaluation suites and baselines as TOML files: read into rows with their faults, added to, amended, and written as text.

A suite is a row (path, text), or a file of a tree; its cases are rows in the order of the file. Reading never fails for one bad case: its row names the
fault, and a text that is no TOML gives one row with the fault `toml`. Adding is idempotent by key: a case whose query (or relation and target) the suite
has changes nothing, and one that has it with another intent is told as a conflict. Null texts are empty suites; empty tables give empty results; extra columns
are ignored; texts written here read as the same rows.
"""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodequery.sources import files

#: What a case may ask of, and the relations of graph cases.
INTENTS, RELATIONS = ("code", "doc", "both"), ("who_calls", "defines")
CASES = "path string, place int, form string, query string, relation string, target string, expected array<string>, kind string, intent string, fault string"
METRICS = "path string, form string, surface string, name string, value double"
_NAMES = [x.split()[0] for x in CASES.split(", ")]


def _filled(x: object) -> bool:
    return isinstance(x, str) and bool(x.strip())


def case_fault(form: str, raw: object) -> str | None:
    """The first field of a case that isn't as it must be; None for a good one."""
    if not isinstance(raw, dict):
        return "table"
    expected = raw.get("expected")
    paths = isinstance(expected, list) and all(map(_filled, expected))
    if form == "case":
        tests = {"query": _filled(raw.get("query")), "expected": paths and bool(expected), "kind": raw.get("kind") is None or isinstance(raw["kind"], str), "intent": raw.get("intent") is None or raw["intent"] in INTENTS}
    else:
        tests = {"relation": raw.get("relation") in RELATIONS, "target": _filled(raw.get("target")), "expected": paths}
    return next((k for k, good in tests.items() if not good), None)


def parsed(suites: DataFrame) -> DataFrame:
    """The cases of suites (path, text): path, place (from 0 in each form), form (case, graph_case), their fields, and fault."""

    def rows(path: str, text: str) -> Iterator[dict]:
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            yield {"path": path, "place": 0, "form": "case", "fault": "toml"}
            return
        for form in ("case", "graph_case"):
            found = data.get(form, [])
            for i, raw in enumerate(found if isinstance(found, list) else [None]):
                fault = case_fault(form, raw)
                own = {k: v for k, v in raw.items() if isinstance(v, str) and k in _NAMES} if isinstance(raw, dict) else {}
                expected = [x for x in raw["expected"] if isinstance(x, str)] if isinstance(raw, dict) and isinstance(raw.get("expected"), list) else None
                yield own | {"path": path, "place": i, "form": form, "expected": expected, "fault": fault}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [r for p, t in zip(f["path"], f["text"], strict=True) for r in rows(p, t or "")]
            yield pd.DataFrame(out, columns=_NAMES).astype({"place": "Int32"}).astype(object).where(lambda x: x.notna(), None)

    return suites.select("path", "text").mapInPandas(run, CASES)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The cases of all .toml files of a tree."""
    rows = files.all_files(spark, root).where(F.endswith("path", F.lit(".toml")))
    return parsed(rows.select("path", files.decoded("content").alias("text")))


def added(cases: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cases after new ones (the same columns but place and fault) came behind those of their suite, and the conflicts (path, query, intent, has).

    Of several new cases of one key the first by intent and expected counts.
    """
    key = ["path", "form", "query", "relation", "target"]
    first = new.groupBy(*key).agg(F.min(F.struct("intent", "expected", "kind")).alias("x")).select(*key, "x.*")
    old = cases.where("fault is null").select(*(F.col(c).alias(f"_{c}") for c in key), F.col("intent").alias("has"))
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    clash = first.where("form = 'case'").join(old, same).where(~F.col("intent").eqNullSafe(F.col("has"))).select("path", "query", "intent", "has")
    last = cases.groupBy("path", "form").agg(F.max("place").alias("_last"))
    fresh = first.join(old, same, "left_anti").join(last, ["path", "form"], "left")
    place = F.coalesce("_last", F.lit(-1)) + F.row_number().over(Window.partitionBy("path", "form").orderBy("query", "relation", "target"))
    return cases.unionByName(fresh.withColumn("place", place.cast("int")).withColumn("fault", F.lit(None).cast("string")).select(*cases.columns)), clash


def amended(cases: DataFrame, changes: DataFrame) -> DataFrame:
    """Cases with the fields that changes (path, query, expected, kind, intent; null: as it is) give to those of a query."""
    new = changes.select("path", "query", *(F.col(c).alias(f"_{c}") for c in ("expected", "kind", "intent"))).dropDuplicates(["path", "query"])
    rows = cases.join(new, ["path", "query"], "left")
    return rows.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("expected", "kind", "intent") else F.col(c) for c in cases.columns))


def quoted(value: Column) -> Column:
    """A string of TOML: basic, with what it can't hold as it is escaped."""
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    # other control characters can't be told apart by name
    return F.concat(F.lit('"'), F.regexp_replace(out, r"[\x00-\x1f\x7f]", " "), F.lit('"'))


def text_of(cases: DataFrame) -> DataFrame:
    """path and text of the suites of cases without fault, cases before graph cases, each in its order."""
    line = lambda name: F.when(F.col(name).isNotNull(), F.concat(F.lit(f"{name} = "), quoted(F.col(name)), F.lit("\n"))).otherwise("")
    listed = F.concat(F.lit("expected = ["), F.array_join(F.transform("expected", quoted), ", "), F.lit("]\n"))
    block = F.concat(F.lit("[["), "form", F.lit("]]\n"), line("query"), line("relation"), line("target"), listed, line("kind"), line("intent"))
    rows = cases.where("fault is null").select("path", F.struct("form", "place", block.alias("t")).alias("x"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


def baselines(found: DataFrame) -> DataFrame:
    """path, form (ir, fused, graph), surface, name and value of the metrics in baselines (path, text), as evaluate.regression() compares them."""

    def rows(path: str, text: str) -> Iterator[tuple]:
        data = tomllib.loads(text)
        fused = data.get("fused_baseline", {})
        for form, surface, own in (("graph" if "mean_f1" in data else "ir", None, data), ("fused", None, fused), *(("fused", s.get("surface"), s) for s in fused.get("surface", []))):
            for name, value in [*own.items(), *((f"hit_{k}", v) for k, v in own.get("hit_rate", {}).items())]:
                if isinstance(value, (int, float)) and not isinstance(value, bool):
                    yield path, form, surface, name, float(value)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([r for p, t in zip(f["path"], f["text"], strict=True) for r in rows(p, t or "")], columns=["path", "form", "surface", "name", "value"])

    return found.select("path", "text").mapInPandas(run, METRICS)


def baseline_text(metrics: DataFrame, recorded_at: str, provider: str) -> DataFrame:
    """path and text of baselines of metrics (path, name, value): hit_k under hit_rate."""
    is_hit = F.rlike("name", F.lit("^hit_[0-9]+$"))
    line = F.concat(F.when(is_hit, F.substring("name", 5, 20)).otherwise(F.col("name")), F.lit(" = "), F.col("value").cast("string"))
    rows = metrics.where("value is not null").select("path", F.struct(is_hit.alias("hit"), "name", line.alias("l")).alias("x")).groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("x"))
    part = lambda hit: F.array_join(F.transform(F.filter("x", lambda r: r["hit"] == hit), lambda r: r["l"]), "\n")
    head = F.concat(F.lit("recorded_at = "), quoted(F.lit(recorded_at)), F.lit("\nprovider = "), quoted(F.lit(provider)), F.lit("\n"))
    return rows.select("path", F.concat(head, part(False), F.when(F.exists("x", lambda r: r["hit"]), F.concat(F.lit("\n\n[hit_rate]\n"), part(True))).otherwise(""), F.lit("\n")).alias("text"))
