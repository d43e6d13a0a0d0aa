"""Column functions over the text of knowledge pages: frontmatter, wikilinks, names and coverage blocks.

All are built-in expressions. Null texts read as empty ones; what a text doesn't have comes back empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodequery.functions.text import let

#: The formats of a frontmatter block, of its pairs and items, of wikilinks, code and names.
BLOCK = r"(?s)\A\x{FEFF}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*\r?\n?"
PAIR = r"^([A-Za-z0-9_-]+)[ \t]*:[ \t]*(.*)$"
ITEM = r"^[ \t]*-[ \t]+(.*)$"
WIKILINK = r"\[\[([^\[\]|#]+)(?:[#|][^\[\]]*)?\]\]"
FENCE = r"(?dms)^[ \t]*(`{3,}|~{3,})[^\n]*\n.*?^[ \t]*\1[ \t]*$"
CODE_SPAN = r"(?s)(`+)(?:(?!\1).)*?\1"
KEBAB = r"^[a-z0-9]+(?:-[a-z0-9]+)*\.md$"
COMPOUND = r"^[A-Za-z][A-Za-z0-9]*[_-][A-Za-z0-9_-]*[A-Za-z0-9]$"
#: Names too common to be worth a page.
STOPWORDS = (
    "true", "false", "none", "null", "nil", "self", "cls", "todo", "fixme", "nan", "int", "str", "bool", "list", "dict", "set", "float", "bytes", "none.",
    "yaml", "json", "toml", "md", "txt", "py", "ps1", "sh", "env", "http", "https", "url", "uri", "id", "ok", "n/a",
)


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def whole(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(whole(text), r"\r\n|\n|\r")


def has_frontmatter(text: Column) -> Column:
    return F.rlike(whole(text), F.lit(BLOCK))


def body(text: Column) -> Column:
    """What follows the frontmatter; the whole text where there is none."""
    return F.regexp_replace(whole(text), BLOCK, "")


def unquoted(c: Column) -> Column:
    """A scalar without white space around it and without one pair of equal quotes."""
    return let(stripped(c), lambda x: F.when(F.rlike(x, F.lit(r"""(?s)^(?:'.*'|".*")$""")) & (F.length(x) >= 2), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def frontmatter(text: Column) -> Column:
    """The fields of the frontmatter: a map from key to (list, values); scalars are lists of one with `list` false.

    `key: [a, b]` and a key without value, followed by `- item` lines, are lists. Of a key that
    repeats the last one counts. Blank lines, comments and lines of no known form are skipped.
    """
    row = lambda x: F.struct(F.regexp_extract(x, PAIR, 1).alias("key"), stripped(F.regexp_extract(x, PAIR, 2)).alias("value"), F.rlike(x, F.lit(ITEM)).alias("item"), unquoted(F.regexp_extract(x, ITEM, 1)).alias("text"))
    rows = F.transform(F.filter(lines_of(F.regexp_extract(whole(text), BLOCK, 1)), lambda x: ~F.rlike(x, F.lit(r"^\s*(#.*)?$"))), row)

    def fields(all_rows: Column) -> Column:
        numbered = F.transform(all_rows, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        pairs = F.filter(numbered, lambda r: (r["x"]["key"] != "") & ~r["x"]["item"])
        return let(pairs, lambda own: let(F.transform(own, lambda p, k: entry(p, F.get(own, k + 1)["i"], numbered)), unique))

    def entry(p: Column, end: Column, numbered: Column) -> Column:
        value = p["x"]["value"]
        items = F.transform(F.filter(numbered, lambda r: r["x"]["item"] & (r["i"] > p["i"]) & (end.isNull() | (r["i"] < end))), lambda r: r["x"]["text"])
        listed = F.rlike(value, F.lit(r"(?s)^\[.*\]$"))
        inline = F.transform(F.filter(F.split(F.substring(value, F.lit(2), F.length(value) - 2), ","), lambda x: stripped(x) != ""), unquoted)
        return F.struct(p["x"]["key"].alias("key"), F.struct((listed | (value == "")).alias("list"), F.when(value == "", items).when(listed, inline).otherwise(F.array(unquoted(value))).alias("values")).alias("value"))

    def unique(entries: Column) -> Column:
        last = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
        return F.map_from_entries(last)

    return let(rows, fields)


def scalar(fields: Column, key: str) -> Column:
    """A field as text: a scalar's value, '' where the key is absent. Lists give their items joined."""
    return F.coalesce(F.array_join(F.try_element_at(fields, F.lit(key))["values"], ", "), F.lit(""))


def missing_required(fields: Column, required: tuple[str, ...]) -> Column:
    """The required keys that are absent or empty, in the order required."""
    absent = lambda v: v.isNull() | (F.size(v["values"]) == 0) | (~v["list"] & (F.get(v["values"], 0) == ""))
    return F.filter(F.array(*map(F.lit, required)), lambda k: absent(F.try_element_at(fields, k)))


def strip_code(text: Column) -> Column:
    """The text without closed fences and inline code; fences first. A fence that isn't closed stays."""
    return F.regexp_replace(F.regexp_replace(whole(text), FENCE, "\n"), CODE_SPAN, " ")


def wikilinks(text: Column) -> Column:
    """Distinct targets of [[target]], [[target#part]] and [[target|alias]] outside frontmatter and code, by first appearance."""
    found = F.regexp_extract_all(strip_code(body(text)), F.lit(WIKILINK), F.lit(1))
    clean = F.transform(found, lambda x: stripped(F.regexp_replace(stripped(x), r"\\+$", "")))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_md(path: Column) -> Column:
    return F.regexp_replace(path, r"\.md$", "")


def aliases(path: Column) -> Column:
    """The forms by which a link can mean a page: path, path without .md, file name without .md."""
    return F.array_distinct(F.array(path, without_md(path), without_md(name_of(path))))


def area(path: Column, names: dict[str, str]) -> Column:
    """The name given to a page's first folder; the folder itself where it has none."""
    head = F.element_at(F.split(path, "/"), 1)
    return F.coalesce(*(F.when(head == k, F.lit(v)) for k, v in names.items()), head)


def normal_name(name: Column) -> Column:
    """Identity of a candidate or page: the last segment without .md, in lower case."""
    return F.lower(without_md(name_of(stripped(name))))


def is_kebab(path: Column) -> Column:
    return F.rlike(name_of(path), F.lit(KEBAB))


def prose_identifiers(text: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct compound names (with _ or -) in inline code outside fences, without stop words."""
    plain = F.regexp_replace(body(text), r"(?s)```.*?```", " ")
    tokens = F.transform(F.regexp_extract_all(plain, F.lit(r"`([^`\n]+)`"), F.lit(1)), stripped)
    return F.array_distinct(F.filter(tokens, lambda x: F.rlike(x, F.lit(COMPOUND)) & ~normal_name(x).isin(*stopwords)))


def covered_items(text: Column, opening: str = "<!-- covers/1", closing: str = "-->") -> Column:
    """Distinct (path, content_id) of all coverage blocks: lines `path@id`, parted at the last @; other lines are skipped."""
    q = lambda x: r"\Q" + x + r"\E"
    blocks = F.regexp_extract_all(whole(text), F.lit(rf"(?dms)^[ \t]*{q(opening)}[^\n]*\n(.*?)(?:^[ \t]*{q(closing)}|\z)"), F.lit(1))
    lines = F.transform(F.flatten(F.transform(blocks, lines_of)), stripped)
    pair = lambda x: F.struct(F.regexp_extract(x, r"^(.+)@([^@]+)$", 1).alias("path"), F.regexp_extract(x, r"^(.+)@([^@]+)$", 2).alias("content_id"))
    return F.array_distinct(F.filter(F.transform(lines, pair), lambda p: p["path"] != ""))


def has_block(text: Column, opening: str = "<!-- covers/1") -> Column:
    return F.exists(lines_of(text), lambda x: F.startswith(stripped(x), F.lit(opening)))


def has_entry(text: Column, log_format: str) -> Column:
    """Whether a line begins like the log's entries: with what stands before the first { of their format, if anything does."""
    prefix = log_format.split("{", 1)[0].strip()
    return F.exists(lines_of(text), lambda x: F.startswith(stripped(x), F.lit(prefix))) if prefix else F.lit(False)
