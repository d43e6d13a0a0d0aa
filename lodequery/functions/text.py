"""Column functions over text: tokens, shingles, scrubbing, buckets and small formats.

All are built-in expressions; none reads more than the row it stands in.
"""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Search tokens: runs of a-z, 0-9 and _ in lower case, and after each run with _ its non-empty parts."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    parts = lambda w: F.when(w.contains("_"), F.concat(F.array(w), F.filter(F.split(w, "_"), lambda p: p != ""))).otherwise(F.array(w))
    return F.flatten(F.transform(words, parts))


def indexed_tokens(text: Column) -> Column:
    """Tokens of a text to be indexed; a text without any counts as one empty token."""
    found = tokens(F.coalesce(text, F.lit("")))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n words of the text with white space collapsed; fewer words: the whole text; blank: none."""

    def runs(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
        whole = F.when(F.get(words, 0) == "", F.array().cast("array<string>")).otherwise(F.array(F.array_join(words, " ")))
        return F.when(F.size(words) < n, whole).otherwise(F.array_distinct(each))

    return let(F.split(collapsed(text), " "), runs)


def containment(a: Column, b: Column) -> Column:
    """Shared shingles over the smaller set; an empty set contains, and is contained in, empty sets alone. Pass plain columns."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of doubles; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm))


#: Words that mark a field or an assignment as secret.
SECRET_WORDS = ("key", "apikey", "token", "secret", "password", "authorization")
#: The patterns of secrets, applied in this order.
SECRET_PATTERNS = (
    r"\bsk-[A-Za-z0-9_-]{8,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"(?i)\b(?:authorization\s*:?\s*)?bearer\s+[A-Za-z0-9._~+/=-]{6,}",
    r"(?i)\bauthorization\s*[:=]\s*\S+",
    rf"(?i)\b[A-Za-z0-9_.-]*(?:{'|'.join(SECRET_WORDS)})[A-Za-z0-9_.-]*\s*[:=]\s*\S+",
)


def compiles(pattern: str) -> bool:
    """Whether the JVM, which runs the patterns, takes this one."""
    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def scrubbed(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Text with secrets replaced, pattern after pattern. An extra pattern that the engine can't compile blanks the whole text."""
    if any(not compiles(pattern) for pattern in extra):
        return F.when(text.isNotNull(), F.lit("[REDACTED]"))
    return reduce(lambda t, pattern: F.regexp_replace(t, pattern, "[REDACTED]"), (*SECRET_PATTERNS, *extra), text)


def name_words(name: Column) -> Column:
    """The words of a camelCase or snake_case name, in lower case."""
    spaced = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda w: w != "")


def is_secret_name(name: Column) -> Column:
    return F.arrays_overlap(name_words(name), F.array(*map(F.lit, SECRET_WORDS)))


def redacted(fields: Column) -> Column:
    """A map with the values of secret names replaced."""
    return F.transform_values(fields, lambda k, v: F.when(is_secret_name(k), "[REDACTED]").otherwise(v))


def bucket(ts: Column, granularity: str = "day") -> Column:
    """Day (yyyy-MM-dd) or hour (yyyy-MM-ddTHH) of a timestamp, as text."""
    return F.date_format(ts, "yyyy-MM-dd" if granularity == "day" else "yyyy-MM-dd'T'HH")


def time_of(value: Column) -> Column:
    """Seconds since 1970 of a number, a date or a date and time (UTC) as text; null for others."""
    iso = F.when(F.rlike(value, F.lit(r"^\s*\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2})?\s*$")), F.unix_micros(F.try_to_timestamp(F.trim(value))) / 1e6)
    return F.coalesce(value.try_cast("double"), iso)


def age(seconds: Column) -> Column:
    """A rounded-down age: 5s, 3m, 2h, 4d."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0))).cast("long")
    unit = lambda n, s: F.concat(F.floor(whole / n).cast("string"), F.lit(s))
    return F.when(whole < 60, unit(1, "s")).when(whole < 3600, unit(60, "m")).when(whole < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def preview(text: Column, chars: int = 240) -> Column:
    """The text, cut with an ellipsis where it is longer than `chars`."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)


def collection_name(corpus: Column, provider: Column) -> Column:
    clean = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "_")
    return F.concat(clean(corpus), F.lit("__"), clean(provider))


#: File suffixes and the languages they stand for.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".cs": "c_sharp", ".go": "go", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp",
    ".php": "php", ".rb": "ruby", ".ps1": "powershell", ".psm1": "powershell", ".sh": "bash", ".bash": "bash", ".sql": "sql", ".md": "markdown", ".markdown": "markdown",
}
#: Path segments left out of ingestion.
EXCLUDES = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache",
    "dist", "build", "target", "bin", "obj", "out", ".index", "chroma", ".idea", ".vscode", "*.key", "*.pem", ".env",
)


def language(path: Column) -> Column:
    """The language of a path by its suffix in lower case; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), suffix)


def excluded(path: Column, patterns: tuple[str, ...] = EXCLUDES) -> Column:
    """Whether a segment of the path matches one of the glob patterns."""
    regex = "|".join("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) for p in patterns)
    return F.exists(F.split(path, "/"), lambda s: F.rlike(s, F.lit(f"^(?:{regex})$")))
