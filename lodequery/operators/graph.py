"""Code-graph navigation over nodes (id, kind, name, path, line, qualname) and edges (source, target, type): one hop a relation.

Ids of nodes are unique; names aren't, and a lookup answers for all symbols of a name. Edges whose ends are no nodes give no rows; repeated edges count
once; null names match nothing; names that no symbol has give no rows; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many rows each section of a context shows.
LIMITS = {"definitions": 10, "callers": 8, "callees": 8, "bases": 8, "docs": 8}


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def find_symbol(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Definitions of each name, exactly as written: name, ref (path#qualname), kind, path, line."""
    rows = nodes.where(F.col("kind").isin("class", "function", "method")).join(names.select("name").distinct(), "name")
    return rows.select("name", F.concat_ws("#", "path", "qualname").alias("ref"), "kind", "path", "line")


def related(nodes: DataFrame, edges: DataFrame, names: DataFrame, type_: str, outgoing: bool = False) -> DataFrame:
    """Distinct nodes with an edge of a type into (or, outgoing, out of) a symbol of each name."""
    own, other = ("source", "target") if outgoing else ("target", "source")
    symbols = nodes.join(names.select("name").distinct(), "name").select(F.col("id").alias(own), F.col("name").alias("of"))
    hits = edges.where(F.col("type") == type_).join(symbols, own).select("of", F.col(other).alias("id")).distinct()
    return hits.join(nodes, "id").select(F.col("of").alias("name"), "id", "kind", "path", "line", F.concat_ws("#", "path", "qualname").alias("ref"))


#: The section that an edge's row stands in, at its target and at its source.
SECTIONS = {"calls": ("callers", "callees"), "inherits": (None, "bases"), "mentions": ("docs", None)}


def adjacency(edges: DataFrame) -> DataFrame:
    """id, section, other: each edge as it is seen from its target and from its source."""
    pair = lambda own, other, at: F.struct(F.col(own).alias("id"), F.element_at(F.create_map(*(F.lit(x) for t, s in SECTIONS.items() for x in (t, s[at]))), F.col("type")).alias("section"), F.col(other).alias("other"))
    rows = edges.where(F.col("type").isin(*SECTIONS)).select(F.explode(F.array(pair("target", "source", 0), pair("source", "target", 1))).alias("x"))
    return rows.select("x.*").where("section is not null")


def context(nodes: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """The five sections of each name, each cut at its limit, with the number of rows before the cut: name, section, ref, total, place.

    Both directions of an edge meet the named symbols in one join. Totals are counted with partial sums, and the cut keeps few rows of a name before
    the shuffle, so a name with very many callers fills no task.
    """
    wanted = names.select("name").distinct()
    own = nodes.join(wanted, "name").select("id", "name")
    refs = nodes.select(F.col("id").alias("other"), F.concat_ws("#", "path", "qualname").alias("ref"))
    hits = adjacency(edges).join(own, "id").select("name", "section", "other").distinct().join(refs, "other").select("name", "section", "ref")
    rows = find_symbol(nodes, wanted).select("name", F.lit("definitions").alias("section"), "ref").unionByName(hits)
    totals = rows.groupBy("name", "section").agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy("name", "section").orderBy("ref"))
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in LIMITS.items() for x in pair)), F.col("section"))
    cut = rows.withColumn("place", place).where(F.col("place") <= max(LIMITS.values())).where(F.col("place") <= limit)
    return cut.join(totals, ["name", "section"]).select("name", "section", "ref", "total", "place")


def resolved_calls(sites: DataFrame, definitions: DataFrame, most: int = 2) -> DataFrame:
    """Edges from call sites (source, callee) to definitions (id, name), for names with `most` targets or fewer; no self loops."""
    targets = definitions.groupBy("name").agg(F.count_distinct("id").alias("n")).where(F.col("n") <= most)
    rows = sites.join(definitions.join(targets, "name", "left_semi"), sites["callee"] == definitions["name"])
    return rows.where(F.col("source") != F.col("id")).select("source", F.col("id").alias("target")).distinct()


def distinctive(name: Column) -> Column:
    """Names long or odd enough to be meant when a text mentions them."""
    return (F.length(name) >= 5) | F.rlike(name, F.lit("^.+[A-Z]")) | name.contains("_")


def mentions(docs: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges (doc_id, id) from texts to the distinctive names they hold as a token."""
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1)))
    rows = docs.select("doc_id", F.explode(words).alias("name"))
    return rows.join(definitions.where(distinctive(F.col("name"))).select("id", "name"), "name").select("doc_id", "id", "name").distinct()


#: What looks like a name in a question, and where a qualified name parts.
IDENTIFIER = r"(?U)(\b(?:[A-Za-z_]\w*\.)+[A-Za-z_]\w*|\b\w*[a-z]\w*_\w+|\b[a-z]+[A-Z]\w*|\b[A-Z][a-z]+[A-Z]\w*)"
PARTS = r"[._]|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def identifiers(question: Column) -> Column:
    """Dotted, snake, camel and Pascal names in a question, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(question, F.lit(IDENTIFIER), F.lit(1)))


def parts_of(qualname: Column) -> Column:
    """The distinct lower-case parts of a qualified name, split at dots, underscores and humps."""
    return F.array_distinct(F.transform(F.filter(F.split(qualname, PARTS), lambda x: x != ""), F.lower))


def akin(part: Column, word: Column, stem: int = 4) -> Column:
    """Whether two words are equal or, both of `stem` letters or more, begin with the same `stem` letters."""
    return (part == word) | (F.length(part) >= stem) & (F.length(word) >= stem) & (F.substring(part, 1, stem) == F.substring(word, 1, stem))


def _key(word: Column, stem: int = 4) -> Column:
    """What words share that are akin: the first `stem` letters, or all of a shorter word."""
    return F.substring(word, 1, stem)


def word_keys(questions: DataFrame) -> DataFrame:
    """query_id and k, the distinct keys of a question's words."""
    words = F.transform(F.regexp_extract_all("query", F.lit("([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.lower)
    return questions.select("query_id", F.explode(words).alias("word")).select("query_id", _key(F.col("word")).alias("k")).distinct()


def askable(asked: DataFrame, names: DataFrame, least: int) -> DataFrame:
    """name, part and k of the distinct names' parts that any question has a word for (asked: k), of names with `least` such parts at least."""
    part = names.select("name").distinct().select("name", F.explode(parts_of(F.col("name"))).alias("part")).withColumn("k", _key(F.col("part")))
    part = part.join(asked.select("k").distinct(), "k", "left_semi")
    return part.join(part.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= least), "name", "left_semi")


def symbol_table(questions: DataFrame, names: DataFrame, least: int = 2) -> DataFrame:
    """query_id, name, overlap: symbols whose whole name a question has (its parts and one more), or whose parts are akin to its words, `least` at least.

    Words and parts meet on their first four letters, shorter ones on themselves. A symbol of fewer than `least` parts that any question has words
    for is none's hit and stays out of that join, and questions of the same such words meet the symbols once.
    """
    own = names.select("name").distinct()
    whole = questions.select("query_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("query", F.lit(r"(?U)([\w.]+)"), F.lit(1)), F.lower))).alias("low"))
    named = whole.join(own.withColumn("low", F.lower("name")), "low").select("query_id", "name", (F.size(parts_of(F.col("name"))) + 1).alias("overlap"))
    asked = word_keys(questions)
    named = named.join(asked.select("query_id").distinct(), "query_id", "left_semi")
    part = askable(asked, own, least)
    sets = asked.join(part.select("k").distinct(), "k", "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_set("k")).alias("set"))
    met = sets.select("set").distinct().select("set", F.explode("set").alias("k")).join(part, "k")
    hits = met.groupBy("set", "name").agg(F.count_distinct("part").cast("int").alias("overlap")).where(F.col("overlap") >= least)
    hits = sets.join(hits, "set").select("query_id", "name", "overlap")
    return named.unionByName(hits).groupBy("query_id", "name").agg(F.max("overlap").alias("overlap"))


def entry_points(questions: DataFrame, names: DataFrame, most: int = 3, least: int = 2) -> DataFrame:
    """query_id, place, name, source: at most `most` symbols to enter the graph by; names written in the question come first, in
    its order, then those of the symbol table by falling overlap, then name. A name counts where it comes first."""
    own = names.select("name").distinct()
    written = questions.select("query_id", F.posexplode(identifiers(F.col("query"))).alias("at", "name")).join(own, "name", "left_semi")
    first = written.select("query_id", "name", F.lit("extracted_from_query").alias("source"), F.lit(0).alias("rank"), "at")
    table = symbol_table(questions, names, least).join(written.select("query_id", "name"), ["query_id", "name"], "left_anti")
    rows = first.unionByName(table.select("query_id", "name", F.lit("symbol_table_match").alias("source"), F.lit(1).alias("rank"), (-F.col("overlap")).alias("at")))
    order = Window.partitionBy("query_id").orderBy("rank", "at", "name")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "place", "name", "source")


def branch_status(questions: DataFrame, points: DataFrame, sections: DataFrame | None, reason: str = "graph not built") -> DataFrame:
    """query_id, status and reason of the graph's part of an answer: unavailable (no graph), not_attempted (no entry point),
    partial (a section of an entry point could not be read: its row has a reason), ok.

    sections: query_id, name, section, reason; None where there is no graph.
    """
    own = questions.select("query_id")
    if sections is None:
        return own.select("query_id", F.lit("unavailable").alias("status"), F.lit(reason).alias("reason"))
    n = points.groupBy("query_id").agg(F.count("*").alias("n"))
    bad = sections.where("reason is not null").groupBy("query_id").agg(F.min("reason").alias("reason"))
    rows = own.join(n, "query_id", "left").join(bad, "query_id", "left")
    return rows.select("query_id", F.when(F.col("n").isNull(), "not_attempted").when(F.col("reason").isNotNull(), "partial").otherwise("ok").alias("status"), F.when(F.col("n").isNotNull(), F.col("reason")).alias("reason"))


def total_for(totals: Column, section: str, items: Column) -> Column:
    """A section's number of rows before the cut; that of the rows shown where it isn't known."""
    return F.coalesce(F.try_element_at(totals, F.lit(section)), F.size(items))


def unavailable_reason(error: Column, key: Column) -> Column:
    """Why the graph can't be read, by the kind of error and the setting it names."""
    return F.when(error == "GraphNotFound", "graph_not_built").when((error == "Config") & (key == "graph"), "navigation_library_missing").otherwise("graph_artifact_unusable")


def corroborated(hits: DataFrame, definitions: DataFrame) -> DataFrame:
    """Hits (query_id, id, path) with the sorted distinct names that a definition list gives for their path."""
    names = definitions.groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return hits.join(names, "path", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
