"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Each document gets counts (words, symbols, repeated lines and word windows). Fixed base rules drop the
plainly bad. For the others, mergeable KLL quantile sketches of four ratios are built per language and
source, merged into sketches per language and of all, and turned into fences far above (word length:
also below) what most documents of the group show: by the quartiles and, for the three ratios that are
0 in most documents, also by the upper tail; the lower of the two counts. Groups with few rows take the
fences of their language, or of all, and no group's fence lies more than the slack above both of those, so
that a bad source can't open its own. A document is kept if it passes the base rules and its group's fences.

Sketches are partly aggregated where the rows are, so a source with a third of all rows costs one
sketch a task. The fences are joined to narrow rows without texts; broadcast only while the number of
groups is below `most_groups`, and else shuffled by language, source and a salt that spreads a hot group.

Cases: null text has no words and fails the base rules; null lang or source is a group of its own; an
empty table gives an empty result; repeated rows and extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.llm.common import SPACES, cut, let, stored

#: ratio: what counts as little whatever the group, added to the upper fence
SLACK = {"symbol_ratio": 0.05, "dup_line_ratio": 0.5, "repeat_ratio": 0.4, "word_length": 4.0}
#: ratio: (lower quantile, upper quantile, spread, tolerance) of the tail's fence. Where the tail is that of plain documents, the fence
#: lies beyond it: upper + spread * (upper - lower) + tolerance. Symbols are absent from most documents and their tail is junk, so that
#: theirs lies a tenth of the way from the body to the tail: lower + spread * (upper - lower) + tolerance.
TAIL = {"symbol_ratio": (0.9, 0.99, 0.1, 0.02), "dup_line_ratio": (0.95, 0.99, 1.0, 0.05), "repeat_ratio": (0.5, 0.95, 6.0, 0.05)}
#: word length: tolerance below the lower quartile's fence
LOW_SLACK = 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_window_words(hashes: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more; hashes: of the words, as longs.

    Windows are compared by 64-bit hashes. Only texts with an equal pair are sorted: equal windows are
    then neighbours, and the words that their positions cover are counted from the gaps between them.
    """

    def covered(windows: Column) -> Column:
        def marked(pairs: Column) -> Column:
            at = lambda i: F.get(pairs, i)["h"]
            same = F.filter(pairs, lambda x, i: (F.coalesce(at(i - 1) == x["h"], F.lit(False))) | (F.coalesce(at(i + 1) == x["h"], F.lit(False))))
            return let(F.array_sort(F.transform(same, lambda x: x["p"])), gaps)

        def gaps(places: Column) -> Column:
            steps = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
            return F.aggregate(steps, F.lit(3), lambda total, step: total + step)

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, marked))

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.when(F.size(hashes) < 4, F.lit(0)).otherwise(let(windows, covered)).cast("long")


def counts(docs: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns to carry, the counts of each row's text and base_failed. Null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.trim(text, F.lit(SPACES))

    def measured(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            let(F.transform(words, lambda w: F.xxhash64(w)), repeated_window_words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    got = docs.select(*carry, let(words, measured).alias("_m"))
    return got.select(*carry, *(F.col(f"_m.{c}").alias(c) for c in COUNTS)).withColumn("base_failed", failed)


def ratios() -> dict[str, Column]:
    least_one = lambda c: F.greatest(F.col(c), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / least_one("word_chars"),
        "dup_line_ratio": F.col("n_dup_lines") / least_one("n_lines"),
        "repeat_ratio": F.col("n_repeat_words") / least_one("n_words"),
        "word_length": F.col("word_chars") / least_one("n_words"),
    }


def fences(counted: DataFrame, k: int = 400, least_rows: int = 100, spread: float = 6.0) -> DataFrame:
    """lang, source and for each ratio low_ and high_: quartiles widened by `spread` times their distance, the tail's fence if lower.

    k is the sketches' size: rank errors stay near 1/k, and groups of fewer rows are exact.
    """
    rows = counted.where(~F.col("base_failed")).select("lang", "source", *(c.alias(n) for n, c in ratios().items()))
    leaf = cut(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(n, F.lit(k)).alias(n) for n in SLACK)))
    merged = lambda *by: (leaf.groupBy(*by) if by else leaf).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(n, F.lit(k)).alias(n) for n in SLACK))

    def bounds(n: str) -> list[Column]:
        q = lambda r: F.kll_sketch_get_quantile_double(n, F.lit(r))
        wide = spread * (q(0.75) - q(0.25))
        high = q(0.75) + wide + SLACK[n]
        if n in TAIL:
            lower, upper, times, tolerance = TAIL[n]
            high = F.least(high, q(lower if n == "symbol_ratio" else upper) + times * (q(upper) - q(lower)) + tolerance)
        return [(q(0.25) - wide - LOW_SLACK).alias(f"low_{n}"), high.alias(f"high_{n}")]

    level = lambda df, name, *by: df.select(*by, F.struct("n", *(b for x in SLACK for b in bounds(x))).alias(name))
    langs = level(merged("lang"), "of_lang", "lang")
    whole = level(merged().where(F.col("n") > 0), "of_all")
    own = level(leaf, "own", "lang", "source").alias("a")
    every = own.join(langs.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang"))).select("a.*", "b.of_lang").join(F.broadcast(whole))
    best = F.when(F.col("own.n") >= least_rows, F.col("own")).when(F.col("of_lang.n") >= least_rows, F.col("of_lang")).otherwise(F.col("of_all"))
    bound = lambda n: F.greatest(F.col(f"of_lang.high_{n}"), F.col(f"of_all.high_{n}")) + SLACK[n]
    every = every.withColumn("best", best)
    both = [c for n in SLACK for c in (F.col(f"best.low_{n}").alias(f"low_{n}"), F.least(F.col(f"best.high_{n}"), bound(n)).alias(f"high_{n}"))]
    return every.select("lang", "source", F.struct("best.n", *both).alias("fence"))


def fenced(counted: DataFrame, fence: DataFrame, most_groups: int, salts: int) -> DataFrame:
    """Counted rows, aliased a, with their group's fence, aliased b, and the column kept."""
    rows = counted.withColumns(ratios())
    if fence.count() <= most_groups:
        right, on = F.broadcast(fence), F.lit(True)
    else:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(salts)))
        right = fence.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
        on = F.col("a._salt") == F.col("b._salt2")
    same = on & F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    inside = F.lit(True)
    for n in SLACK:
        inside &= F.col(n) <= F.col(f"b.fence.high_{n}")
        if n == "word_length":
            inside &= F.col(n) >= F.col(f"b.fence.low_{n}")
    passed = ~F.col("a.base_failed") & F.coalesce(inside, F.lit(True))
    return rows.alias("a").join(right.alias("b"), same, "left").select("a.*", passed.alias("kept"))


def judge(docs: DataFrame, k: int = 400, least_rows: int = 100, spread: float = 6.0, most_groups: int = 50_000, salts: int = 32) -> DataFrame:
    """The counts of each document, its ratios, base_failed and kept."""
    counted = cut(counts(docs))
    fence = cut(fences(counted, k, least_rows, spread))
    return fenced(counted, fence, most_groups, salts).select("doc_id", *COUNTS, *SLACK, "base_failed", "kept")


def kept(docs: DataFrame, k: int = 400, least_rows: int = 100, spread: float = 6.0, most_groups: int = 50_000, salts: int = 32) -> DataFrame:
    """The rows of docs that are kept, with all columns they came with.

    The rows are written once with their counts, as Parquet in the shared folder, and read again for the
    fences (counts alone) and for the filter: counting takes longer than that, and no text is shuffled.
    """
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns) if c not in ("lang", "source")}
    rows = docs.withColumns({new: F.col(c) for c, new in names.items()})
    counted = stored(counts(rows, (*names.values(), "lang", "source")), "counted")
    fence = cut(fences(counted, k, least_rows, spread))
    judged = fenced(counted, fence, most_groups, salts).where("kept")
    return judged.select(*(F.col(names[c]).alias(c) if c in names else F.col(c) for c in docs.columns))
