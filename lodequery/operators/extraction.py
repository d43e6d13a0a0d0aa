"""A graph of code from its sources: symbols, calls, bases, imports and mentions, as joins over facts of each file.

Facts come from the syntax tree of Python files, and from one pass over the tokens of files in languages with braces (functions/syntax.py), one
file at a time; files of other languages and Python files that can't be parsed give their module alone. Null texts read as empty ones; empty tables give empty results; paths must be unique; extra columns are ignored.
"""

from __future__ import annotations

import ast
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodequery.functions import syntax
from lodequery.operators import graph, lexical
from lodequery.sources import versions

#: What is read from the sources of a language.
COVERAGE = {"python": ("calls", "imports", "inherits")} | {k: ("calls",) for k in ("javascript", "typescript", "java", "c_sharp", "go", "c", "cpp", "php")}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
FACTS = "path string, fact string, source string, name string, kind string, line int"


def import_candidates(path: str, node: ast.Import | ast.ImportFrom) -> list[str]:
    """Paths without suffix that an import may mean; relative ones start at the file's folder, one up for each dot after the first."""
    if isinstance(node, ast.Import):
        return [a.name.replace(".", "/") for a in node.names]
    parts = node.module.split(".") if node.module else []
    if node.level:
        base = path.split("/")[:-1]
        up = node.level - 1
        parts = (base[: len(base) - up] if up <= len(base) else []) + parts
    return ["/".join(parts)] if parts else []


def file_facts(path: str, text: str) -> Iterator[tuple]:
    """Facts of one Python file: symbol, call (by the enclosing function), base and import; none if it can't be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    waiting = [(tree, "", None)]
    while waiting:
        node, prefix, within = waiting.pop()
        for x in ast.iter_child_nodes(node):
            own, inside = prefix, within
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                own = f"{prefix}.{x.name}" if prefix else x.name
                is_class = isinstance(x, ast.ClassDef)
                yield path, "symbol", own, x.name, "class" if is_class else "method" if prefix else "function", x.lineno
                if is_class:
                    for base in [*x.bases, *(k.value for k in x.keywords)]:
                        yield from ((path, "base", own, name, None, x.lineno) for name in NAME.findall(ast.unparse(base)))
                else:
                    inside = own
            elif isinstance(x, ast.Call) and within:
                if found := NAME.findall(ast.unparse(x.func)):
                    yield path, "call", within, found[-1], None, x.lineno
            elif isinstance(x, (ast.Import, ast.ImportFrom)):
                yield from ((path, "import", None, module + end, None, x.lineno) for module in import_candidates(path, x) for end in (".py", "/__init__.py"))
            waiting.append((x, own, inside))


def outline_facts(path: str, text: str, language: str) -> Iterator[tuple]:
    """Facts of one file of a language with braces: symbol and call."""
    found = syntax.outline(text, language)
    for d in found.definitions:
        yield path, "symbol", d.qualname, d.name, d.kind, d.start
    for function, name, line in found.calls:
        yield path, "call", function, name, None, line


def facts(docs: DataFrame) -> DataFrame:
    """Facts of the files of known languages among docs (path, text, language)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [x for p, t, own in zip(f["path"], f["text"], f["language"], strict=True) for x in (file_facts(p, t or "") if own == "python" else outline_facts(p, t or "", own))]
            yield pd.DataFrame(rows, columns=["path", "fact", "source", "name", "kind", "line"]).astype({"line": "Int32"})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't made smaller: few large files would else be one task's
    return docs.where(F.col("language").isin(*COVERAGE)).select("path", "text", "language").repartition(n, "path").mapInPandas(run, FACTS)


def kept_facts(docs: DataFrame) -> DataFrame:
    """The facts, written once to the shared folder: nodes and edges read them a dozen times, and files are parsed for the first alone."""
    spark, at, segment = docs.sparkSession, f"{lexical.shared(docs.sparkSession)}/facts-{uuid.uuid4().hex}", versions.new_segment(0)
    versions.write(facts(docs), at, "facts", segment)
    return versions.read(spark, at, "facts", [segment], StructType.fromDDL(FACTS)).drop("_seg")


def nodes_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """id, kind, name, path, line, qualname: a module or doc for each document (path, doc_type), and the symbols, each once."""
    files = docs.select(F.col("path").alias("id"), F.when(F.col("doc_type") == "code", "module").otherwise("doc").alias("kind"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("qualname"))
    symbols = found.where("fact = 'symbol'").groupBy("path", F.col("source").alias("qualname")).agg(F.min(F.struct("line", "kind", "name")).alias("x"))
    symbols = symbols.select(F.concat_ws("::", "path", "qualname").alias("id"), "x.kind", "x.name", "path", "x.line", "qualname")
    return files.unionByName(symbols)


def contained(nodes: DataFrame) -> DataFrame:
    """Edges from a symbol's parent to it: the symbol whose name its own extends, else its module."""
    own = nodes.where("qualname is not null").select("id", "path", F.when(F.contains("qualname", F.lit(".")), F.concat_ws("::", "path", F.regexp_replace("qualname", r"\.[^.]*$", ""))).alias("parent"))
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    rows = own.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).otherwise(F.col("path")).alias("source"))
    return rows.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").select("source", F.col("id").alias("target"), F.lit("contains").alias("type"))


def inherited(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from a class to every class that has its base's name, itself excepted."""
    base = found.where("fact = 'base'").select(F.concat_ws("::", "path", "source").alias("source"), "name")
    rows = base.join(nodes.where("kind = 'class'").select(F.col("id").alias("target"), "name"), "name").where("source <> target")
    return rows.select("source", "target", F.lit("inherits").alias("type")).distinct()


def imported(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from a module to the modules of the corpus that its imports can mean."""
    rows = found.where("fact = 'import'").select(F.col("path").alias("source"), F.col("name").alias("target")).distinct()
    return rows.join(nodes.where("kind = 'module'").select(F.col("id").alias("target")), "target", "left_semi").select("source", "target", F.lit("imports").alias("type"))


def coverage(files: DataFrame) -> DataFrame:
    """language, kind, files: how many files (language) each kind of edge is read from; languages that aren't read give no row."""
    kinds = F.create_map(*(x for k, v in COVERAGE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return files.select("language", F.explode(F.try_element_at(kinds, "language")).alias("kind")).groupBy("language", "kind").agg(F.count("*").alias("files"))


def joined(docs: DataFrame, found: DataFrame, texts: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges (source, target, type) of facts, of files (path, doc_type) and of the texts (doc_id, text) that may mention symbols.
    A call whose name has more than `most` definitions gives no edge."""
    nodes = nodes_of(docs, found)
    symbols = nodes.where("qualname is not null").select("id", "name")
    sites = found.where("fact = 'call'").select(F.concat_ws("::", "path", "source").alias("source"), F.col("name").alias("callee"))
    calls = graph.resolved_calls(sites, symbols, most).withColumn("type", F.lit("calls"))
    mentions = graph.mentions(texts, symbols).select(F.col("doc_id").alias("source"), F.col("id").alias("target"), F.lit("mentions").alias("type"))
    edges = contained(nodes).unionByName(calls).unionByName(inherited(found, nodes)).unionByName(imported(found, nodes)).unionByName(mentions)
    return nodes, edges.distinct()


def extracted(docs: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges of docs (path, text, doc_type, language), whose facts are kept in the shared folder."""
    return joined(docs, kept_facts(docs), docs.where("doc_type = 'doc'").select(F.col("path").alias("doc_id"), "text"), most)


def one_type_a_pair(edges: DataFrame) -> DataFrame:
    """Edges as a graph without parallel edges keeps them: of several types of a pair the last by name."""
    return edges.groupBy("source", "target").agg(F.max("type").alias("type"))
