"""Column functions over unified diffs: kinds of lines, ranges and the names a change declares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodequery.functions.text import let

#: Where a text parts into lines: all ends that Unicode knows.
LINE_ENDS = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: The formats of a diff's header lines, and of declarations and assignments at the line's start.
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"
KINDS = (
    ("file", r"^diff --git "), ("new", r"^new file mode"), ("deleted", r"^deleted file mode"), ("binary", r"^(?:Binary files|GIT binary patch)"),
    ("rename_from", r"^rename from (.+)$"), ("rename_to", r"^rename to (.+)$"), ("minus", r"^--- (?:a/)?(.+)$"), ("plus", r"^\+\+\+ (?:b/)?(.+)$"), ("hunk", HUNK), ("body", r"^[ +-]"),
)
DECLARATION = r"(?U)\b(?:def|class|func|function|fn|struct|enum|trait|type|const)\s+([A-Za-z_]\w*)"
ASSIGNMENT = r"(?U)^([A-Za-z_]\w*)\s*[:=](?!=)"
#: Folders and suffixes of files that are no source, with the reason each is left out.
SPEC_DIRS, DOC_DIRS, DOC_SUFFIXES = ("specs", "requirements", ".specify"), ("docs",), (".md", ".markdown", ".rst", ".txt", ".adoc")


def lines_of(text: Column) -> Column:
    """The lines of a text; an end at the very end begins no further line, and an empty text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_ENDS)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def line_kind(line: Column) -> Column:
    """What a line is, by the first format it has; `other` for none."""
    return reduce(lambda c, k: c.when(F.rlike(line, F.lit(k[1])), F.lit(k[0])), KINDS[1:], F.when(F.rlike(line, F.lit(KINDS[0][1])), F.lit(KINDS[0][0]))).otherwise("other")


def named(line: Column, kind: str) -> Column:
    """The path that a header line of a kind names."""
    return F.trim(F.regexp_extract(line, dict(KINDS)[kind], 1))


def declared(text: Column) -> Column:
    """Names that a piece of code declares, then the one it assigns at its start."""
    found = F.regexp_extract_all(text, F.lit(DECLARATION), F.lit(1))
    return F.when(F.rlike(text, F.lit(ASSIGNMENT)), F.concat(found, F.array(F.regexp_extract(text, ASSIGNMENT, 1)))).otherwise(found)


def ranges(head: Column) -> dict[str, Column]:
    """The four numbers of a hunk's header line; a length that isn't given is 1."""
    part = lambda i: F.regexp_extract(head, HUNK, i)
    start = lambda i: F.try_to_number(part(i), F.lit("999999999999")).cast("int")
    size = lambda i: F.when(part(i) == "", F.lit(1)).otherwise(start(i))
    return {"old_start": start(1), "old_len": size(2), "new_start": start(3), "new_len": size(4)}


def names_in(line: Column, kind: Column) -> Column:
    """Names that a line of a hunk declares: its header, and lines that come or go."""
    return F.when(kind == "hunk", declared(F.regexp_extract(line, HUNK, 5))).when(F.rlike(line, F.lit("^[+-]")), declared(F.substring(line, F.lit(2), F.length(line)))).otherwise(F.array().cast("array<string>"))


def _runs(rows: Column, kind: str) -> Column:
    """Rows (kind, line) cut before each of a kind; what stands before the first is left out."""
    at = F.filter(F.transform(rows, lambda x, i: F.when(x["kind"] == kind, i + 1)), lambda i: i.isNotNull())
    return let(at, lambda a: F.transform(a, lambda begin, k: F.slice(rows, begin, F.coalesce(F.get(a, k + 1), F.size(rows) + 1) - begin)))


def _hunk(rows: Column, place: Column, whole: bool) -> Column:
    body = F.transform(F.filter(rows, lambda x: x["kind"] == "body"), lambda x: x["line"])
    names = F.array_distinct(F.flatten(F.transform(F.filter(rows, lambda x: x["kind"].isin("hunk", "body")), lambda x: names_in(x["line"], x["kind"]))))
    numbers = [c.alias(name) for name, c in ranges(rows[0]["line"]).items()]
    return F.struct(place.alias("hunk"), body.alias("lines") if whole else lone_name(snippet(body)).alias("snippet"), names.alias("identifiers"), *numbers)


def _file(rows: Column, place: Column, whole: bool) -> Column:
    def told(heads: Column) -> Column:
        paths = lambda *kinds: F.filter(F.transform(heads, lambda x: reduce(lambda c, k: c.when(x["kind"] == k, named(x["line"], k)), kinds[1:], F.when(x["kind"] == kinds[0], named(x["line"], kinds[0])))), lambda p: p.isNotNull() & (p != "/dev/null"))  # noqa: E731, E501
        last = lambda *kinds: let(paths(*kinds), lambda p: F.get(p, F.size(p) - 1))
        has = lambda kind: F.exists(heads, lambda x: x["kind"] == kind)
        old, renamed = F.coalesce(last("rename_from"), F.get(paths("minus"), F.lit(0))), has("rename_from") | has("rename_to")
        change = F.when(renamed, "renamed").when(has("new"), "added").when(has("deleted"), "deleted").otherwise("modified")
        hunks = F.transform(F.when(has("binary"), F.slice(F.array(rows), 1, 0)).otherwise(_runs(rows, "hunk")), lambda r, k: _hunk(r, k, whole))
        return F.struct(place.alias("file"), F.coalesce(last("rename_to", "plus"), old, F.lit("")).alias("path"), F.when(renamed, old).alias("old_path"), change.alias("change_type"), has("binary").alias("is_binary"), hunks.alias("hunks"))

    return let(F.filter(rows, lambda x: ~x["kind"].isin("hunk", "body", "other")), told)


def files_of(text: Column, whole: bool = True) -> Column:
    """The files of a diff in its order, each with its hunks: file, path, old_path (of renames), change_type, is_binary, hunks.

    hunks: hunk, lines, identifiers and ranges; binary files have none. Without whole they have, in place of lines, what names to look up is read from (snippet: a lone name or nothing).
    """
    rows = F.transform(lines_of(text), lambda x: F.struct(line_kind(x).alias("kind"), x.alias("line")))
    return let(rows, lambda r: F.transform(_runs(r, "file"), lambda own, k: _file(own, k, whole)))


def snippet(lines: Column) -> Column:
    """The added lines of a hunk as one text."""
    return F.array_join(F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))), lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")


def span(start: Column, length: Column) -> tuple[Column, Column]:
    """First and last line of a range; an empty range is its start alone."""
    return start, F.when(length > 0, start + length - 1).otherwise(start)


def identifier_queries(identifiers: Column, snippet: Column, most: int = 4) -> Column:
    """Distinct names to look up, `most` at most; without any, the snippet's first line if it is a single name."""
    own, name = F.array_distinct(F.filter(identifiers, lambda x: x != "")), lone_name(snippet)
    spare = F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.when(F.size(own) > 0, own).otherwise(spare), 1, most)


def lone_name(snippet: Column) -> Column:
    """The first line of a snippet that isn't blank, if it is a single name; else an empty text."""
    first = F.coalesce(F.get(F.filter(F.transform(lines_of(snippet), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))
    return let(first, lambda x: F.when(F.rlike(x, F.lit(r"(?U)^[A-Za-z_]\w*$")), x).otherwise(""))


def excluded_reason(path: Column, include_docs: bool = False) -> Column:
    """Why a file is no source (specification, documentation); null for sources."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")
    top, suffix = F.element_at(F.split(plain, "/"), 1), F.lower(F.regexp_extract(plain, r"[^/](\.[^./]+)$", 1))
    out = F.when(top.isin(*SPEC_DIRS), "specification")
    return out if include_docs else out.when(top.isin(*DOC_DIRS) | suffix.isin(*DOC_SUFFIXES), "documentation")


def is_test_path(path: Column) -> Column:
    return F.rlike(path, F.lit(r"(?:^|/)test_[^/]*$|_test\.py$|(?:^|[/\\])tests[/\\]"))
