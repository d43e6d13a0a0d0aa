"""Personal data by weak supervision, in DataFrame functions alone.

Candidate spans are the matches of four strict patterns (email, ip, card, phone), kept or failed, and of
two wider ones (written-out email addresses; digit groups of 9 to 19 digits). Five labelers vote for or
against each candidate or abstain: the strict pattern, a checksum or range test, a gazetteer of words
beside the span, the characters around it, and its form. Expectation-maximisation over the counts of
vote patterns estimates how often each labeler votes which way for real and for other spans, per kind.
Its posteriors train the final classifier, a logistic regression on categorical features of the span,
which decides the candidates that the strict patterns leave open. Valid strict matches always stay.

Counts of vote patterns (at most 4 * 3**5) and of feature combinations (at most 4 * 20 * 5 * 5 * 3 * 4 * 3 * 3)
are summed by Spark over all documents; only those sums reach the driver. Positions are code points.
Patterns are written with possessive repeats, so that very long texts neither overflow the stack nor
take quadratic time.

Cases: null and empty texts have no spans; repeated rows are scanned each; null doc_id is kept; spans
that overlap a kept one or an open one before them are not added; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodequery.llm.common import aside, cut, let

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns; the first three are written so that a failed start is not tried again inside the same run.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Text without these can't have a match that counts: each is implied by its pattern and the least number of digits.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?i)[a-z0-9._%+-]{1,64}+\x20?[(\[{]at[)\]}]\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[{]dot[)\]}])\x20?[a-z0-9-]{1,63}+){1,4}+",
    "digits": r"(?<![\w+.])\(?[0-9][0-9\x20().-]{7,28}[0-9](?![\w])",
}
WIDE_NEEDS = {"email": r"(?i)[(\[{]at[)\]}]", "digits": r"[0-9](?:[\x20().-]{0,28}+[0-9]){8}"}
#: Words whose presence shortly before or after a span speaks for or against it.
FOR = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|courriel|correo|kontakt)\b",
    "ip": r"(?i)\b(ip|host|server|address|login|client|adresse|serveur)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|account|iban|carte|karte|tarjeta|konto|cuenta)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono)\b",
}
AGAINST = r"(?i)\b(version|v|release|isbn|order|invoice|section|page|figure|table|id|sku|http|https)\b"
VOTES = ("regex", "check", "gazetteer", "context", "form")
FEATURES = ("digits", "before", "after", "gazetteer", "marks", "check", "form")
PART_TO_255 = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"


def prefixes(values: Column, merge, step: int = 64) -> Column:
    """merge of all values (an array of ints, bound to a lambda) before each, from 0; n * step steps for n values, without copies that grow with n."""
    over = lambda x: F.aggregate(x, F.lit(0), merge)
    n = F.size(values)
    parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda b: over(F.slice(values, b * step + 1, F.lit(step))))
    starts = F.aggregate(parts, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(merge(F.element_at(out, -1), x))))
    inside = lambda i: over(F.slice(values, i - i % step + 1, i % step))
    some = let(starts, lambda own: F.transform(values, lambda _, i: merge(F.get(own, F.floor(i / step).cast("int")), inside(i))))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(some)


def add(a: Column, x: Column) -> Column:
    return a + x


def most(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def overlapping(spans: Column, others: Column) -> Column:
    """Whether each span meets one of the others, by one sort of all: a span meets one that began before it
    if the furthest end so far lies beyond its start, and one that begins after it if the next begins before its end."""
    far = 2**30

    def flags(rows: Column) -> Column:
        ends = F.transform(rows, lambda x: F.when(x["own"], x["e"]).otherwise(0))
        nearest = F.transform(F.reverse(rows), lambda x: F.when(x["own"], far - x["s"]).otherwise(0))
        met = lambda before, after: F.filter(F.zip_with(F.transform(rows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), before, lambda r, b: F.struct(r["x"]["at"].alias("at"), r["x"]["own"].alias("own"), ((b > r["x"]["s"]) | (far - F.element_at(after, -1 - r["i"]) < r["x"]["e"])).alias("met"))), lambda r: ~r["own"])
        return let(ends, lambda v: let(prefixes(v, most), lambda before: let(nearest, lambda w: let(prefixes(w, most), lambda after: met(before, after)))))

    row = lambda x, own, at: F.struct(x["s"].alias("s"), F.lit(not own).alias("last"), x["e"].alias("e"), F.lit(own).alias("own"), at.alias("at"))
    rows = F.concat(F.transform(spans, lambda x, i: row(x, False, i)), F.transform(others, lambda x: row(x, True, F.lit(-1))))
    found = let(F.array_sort(rows), lambda r: F.transform(F.array_sort(flags(r)), lambda x: x["met"]))
    none = F.transform(spans, lambda x: F.lit(False))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), none).otherwise(found)


def without(spans: Column, others: Column) -> Column:
    """The spans that meet none of the others."""
    return F.when(F.size(spans) == 0, spans).otherwise(F.transform(F.filter(F.zip_with(spans, overlapping(spans, others), lambda x, m: F.struct(x.alias("x"), m.alias("m"))), lambda r: ~r["m"]), lambda r: r["x"]))


def located(text: Column, pattern: str, needs: str) -> Column:
    """Matches of pattern as structs (s, e, t): start and end in code points, and the matched text."""

    def spans(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda x: F.length(x))
        return let(F.zip_with(gaps, found, lambda gap, t: F.struct(gap.alias("gap"), F.length(t).alias("n"))), lambda steps: placed(steps, found))

    def placed(steps: Column, found: Column) -> Column:
        lengths = F.transform(steps, lambda x: x["gap"] + x["n"])
        starts = let(lengths, lambda v: prefixes(v, add))
        return F.zip_with(starts, F.zip_with(steps, found, lambda x, t: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), t.alias("t"))), lambda at, x: F.struct((at + x["gap"]).alias("s"), (at + x["gap"] + x["n"]).alias("e"), x["t"].alias("t")))

    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    matches = F.when(F.rlike(text, F.lit(needs)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return let(matches, lambda found: F.when(F.size(found) == 0, none).otherwise(spans(found)))


def digits_of(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits of t (any number of them) pass the Luhn test."""

    def total(d: Column) -> Column:
        each = F.transform(F.reverse(F.filter(F.split(d, ""), lambda x: x != "")).cast("array<int>"), lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    return let(digits_of(t), total) % 10 == 0


def valid(kind: str, t: Column) -> Column:
    """Whether a strict match counts."""
    n = F.length(digits_of(t))
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda x: F.rlike(x, F.lit(PART_TO_255)))
    if kind == "card":
        return n.between(14, 19) & luhn(t)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def sign(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(~yes if no is None else no, -1).otherwise(0)


def candidates(text: Column) -> Column:
    """All candidates of a text: k (kind), s, e, t, strict (a strict match), ok (a valid one)."""

    def made(kind: Column, x: Column, strict: bool, ok: Column) -> Column:
        return F.struct(kind.alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), F.lit(strict).alias("strict"), ok.alias("ok"))

    def strict(i: int, kind: str) -> Column:
        return F.transform(located(text, STRICT[kind], NEEDS[kind]), lambda x: made(F.lit(i), x, True, valid(kind, x["t"])))

    found = [strict(i, kind) for i, kind in enumerate(KINDS)]
    wide = F.transform(located(text, WIDE["email"], WIDE_NEEDS["email"]), lambda x: made(F.lit(0), x, False, F.lit(False)))
    digits = F.transform(located(text, WIDE["digits"], WIDE_NEEDS["digits"]), lambda x: made(F.when(F.length(digits_of(x["t"])) >= 13, 2).otherwise(3), x, False, F.lit(False)))
    wide = F.concat(wide, F.filter(digits, lambda x: F.length(digits_of(x["t"])).between(9, 19)))
    return let(F.concat(*found), lambda own: let(wide, lambda more: F.concat(own, without(more, own))))


def described(text: Column, x: Column) -> Column:
    """A candidate with its votes and features."""
    t, kind = x["t"], x["k"]
    near = F.concat(F.substring(text, F.greatest(x["s"] - 23, F.lit(1)), F.least(x["s"], F.lit(24))), F.lit(" • "), F.substring(text, x["e"] + 1, F.lit(16)))
    before = F.substring(text, x["s"], F.lit(1))
    before = F.when(x["s"] == 0, "").otherwise(before)
    after = F.substring(text, x["e"] + 1, F.lit(1))
    by_kind = lambda values: reduce(lambda c, i: c.when(kind == i, values[i]), range(1, 4), F.when(kind == 0, values[0]))
    side = lambda c: F.when(c == "", "edge").when(F.rlike(c, F.lit(r"\s")), "space").when(F.rlike(c, F.lit(r"[\p{L}_]")), "letter").when(F.rlike(c, F.lit("[0-9]")), "digit").otherwise("mark")
    gazetteer = F.when(by_kind([F.rlike(near, F.lit(FOR[k])) for k in KINDS]), 1).when(F.rlike(near, F.lit(AGAINST)), -1).otherwise(0)
    n = F.length(digits_of(t))
    check = by_kind([
        sign(F.rlike(t, F.lit(r"[A-Za-z]{2,}$"))),
        sign(valid("ip", t) & F.rlike(t, F.lit(r"[0-9]{2}"))),
        sign(luhn(t) & n.between(13, 19)),
        sign(n.between(10, 15), ~n.between(9, 15)),
    ])
    form = by_kind([
        sign(F.rlike(t, F.lit(r"(?i)(example|gmail|yahoo|hotmail|outlook|mail[0-9]*)\b"))),
        sign(F.rlike(t, F.lit(r"^([1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\."))),
        sign(F.rlike(t, F.lit(r"^[3-6][0-9]{3}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}$")), F.rlike(t, F.lit(r"[().]"))),
        sign(F.rlike(t, F.lit(r"^\+|\([0-9]{2,4}\)|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")), F.rlike(t, F.lit(r"^[0-9]+$"))),
    ])
    marks = F.when(F.rlike(t, F.lit("[@(+\\[{]")), "signed").when(F.rlike(t, F.lit("-")), "dashed").when(F.rlike(t, F.lit(r"\s")), "spaced").otherwise("plain")
    return F.struct(
        kind.alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["ok"].alias("ok"),
        F.struct(
            F.when(x["ok"], 1).when(x["strict"], -1).otherwise(0).alias("regex"), check.alias("check"), gazetteer.alias("gazetteer"),
            sign(F.rlike(before, F.lit(r"^$|[\s(\[{\"':;,<]")) & F.rlike(after, F.lit(r"^$|[\s.,;:!?)\]}\"'>]"))).alias("context"), form.alias("form"),
        ).alias("v"),
        F.struct(F.least(n, F.lit(20)).cast("string").alias("digits"), side(before).alias("before"), side(after).alias("after"), gazetteer.cast("string").alias("gazetteer"), marks.alias("marks"), check.cast("string").alias("check"), form.cast("string").alias("form")).alias("f"),
    )


def estimate(patterns: list[tuple], rounds: int = 40) -> dict[tuple, float]:
    """Posterior of a real span for each (kind, votes), by expectation-maximisation; patterns: (kind, votes, count).

    Begins from the majority of votes. Each labeler has, per kind and truth, a smoothed distribution over
    its three votes.
    """
    out = {}
    for kind in {k for k, _, _ in patterns}:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        post = {v: 1 / (1 + math.exp(-2 * sum(v))) for v, _ in rows}
        for _ in range(rounds):
            mass = [sum(n * (post[v] if y else 1 - post[v]) for v, n in rows) for y in (0, 1)]
            prior = (mass[1] + 1) / (sum(mass) + 2)
            rate = {
                (y, i, vote): (sum(n * (post[v] if y else 1 - post[v]) for v, n in rows if v[i] == vote) + (2 if vote == 2 * y - 1 else 0.5)) / (mass[y] + 3)
                for y in (0, 1) for i in range(len(VOTES)) for vote in (-1, 0, 1)
            }
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(rate[1, i, x] / rate[0, i, x]) for i, x in enumerate(v))
                post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= {(kind, v): p for v, p in post.items()}
    return out


def fit(rows: list[tuple], steps: int = 400, rate: float = 0.5, keep: float = 1e-3) -> dict[str, float]:
    """Weights by feature ("kind|name|value" and "kind") from (kind, values, count, expected real), by gradient descent."""
    weights: dict[str, float] = {}
    for kind in {r[0] for r in rows}:
        own = [([str(kind)] + [f"{kind}|{n}|{x}" for n, x in zip(FEATURES, values, strict=True)], c, real) for k, values, c, real in rows if k == kind]
        total = sum(c for _, c, _ in own)
        w = {key: 0.0 for keys, _, _ in own for key in keys}
        for _ in range(steps):
            grad = {key: keep * x for key, x in w.items()}
            for keys, c, real in own:
                p = 1 / (1 + math.exp(-sum(w[x] for x in keys)))
                for x in keys:
                    grad[x] += (c * p - real) / total
            w = {x: v - rate * grad[x] for x, v in w.items()}
        weights |= w
    return weights


def with_candidates(docs: DataFrame, text: Column) -> DataFrame:
    return docs.withColumn("_c", let(candidates(text), lambda c: F.transform(c, lambda x: described(text, x))))


def weights_of(candidate_rows: DataFrame) -> dict[str, float]:
    """The classifier's weights, learned from all candidates in the column _c."""
    each = candidate_rows.select(F.explode("_c").alias("c")).select("c.k", "c.v.*", F.struct("c.f.*").alias("f"))
    counted = each.groupBy("k", *VOTES, "f").count().collect()  # bounded: see above
    patterns: dict[tuple, int] = {}
    for r in counted:
        key = (r["k"], tuple(r[v] for v in VOTES))
        patterns[key] = patterns.get(key, 0) + r["count"]
    post = estimate(sorted((k, v, n) for (k, v), n in patterns.items()))
    mixed: dict[tuple, list[float]] = {}
    for r in sorted(counted, key=str):
        cell = mixed.setdefault((r["k"], tuple(r["f"])), [0, 0.0])
        cell[0] += r["count"]
        cell[1] += r["count"] * post[r["k"], tuple(r[v] for v in VOTES)]
    return fit([(k, f, c, real) for (k, f), (c, real) in sorted(mixed.items())])


def decided(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds `found` (base spans: s, k, e) and `more` (further spans that the classifier takes) to rows with candidates; drops _c."""
    table = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair)) if weights else F.create_map(F.lit(""), F.lit(0.0))
    weight = lambda key: F.coalesce(F.try_element_at(table, key), F.lit(0.0))
    of = lambda x, n: F.concat(x["k"].cast("string"), F.lit(f"|{n}|"), x["f"][n])
    real = lambda x: reduce(lambda a, n: a + weight(of(x, n)), FEATURES, weight(x["k"].cast("string"))) > 0
    span = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
    base = rows.withColumn("found", F.array_sort(F.transform(F.filter("_c", lambda x: x["ok"]), span)))
    open_ = F.array_distinct(F.array_sort(F.transform(F.filter("_c", lambda x: ~x["ok"] & real(x)), span)))
    furthest = lambda own: let(F.transform(own, lambda x: x["e"]), lambda v: prefixes(v, most))
    first = lambda own: F.transform(F.filter(F.zip_with(own, furthest(own), lambda x, e: F.struct(x.alias("x"), e.alias("e"))), lambda r: r["e"] <= r["x"]["s"]), lambda r: r["x"])
    more = let(open_, lambda own: let(without(own, F.col("found")), first))
    return base.withColumn("more", F.when(F.size("_c") == 0, F.slice("found", 1, 0)).otherwise(more)).drop("_c")


def joined(spans: Column, prefix: str = "") -> Column:
    """kind:start:end of spans by start, then kind, comma-joined; kinds from 4 on are added ones."""
    names = F.array(*(F.lit(k) for k in KINDS), *(F.lit(f"weak_{k}") for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def all_spans() -> Column:
    return F.array_sort(F.concat("found", F.transform("more", lambda x: F.struct(x["s"].alias("s"), (x["k"] + 4).alias("k"), x["e"].alias("e")))))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of each row of docs (doc_id, text)."""
    count = lambda i: F.size(F.filter("found", lambda x: x["k"] == i)).cast("long")
    rows = cut(with_candidates(docs.select("doc_id", "text"), F.coalesce("text", F.lit(""))).drop("text"))
    return decided(rows, weights_of(rows)).select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(joined(F.col("found")), 256).alias("base_sha256"), joined(all_spans()).alias("spans"), F.size("more").cast("long").alias("n_added"),
    )


def masked(text: Column, spans: Column) -> Column:
    """text with each span (sorted; overlapping ones are masked once) replaced by its kind in brackets."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    piece = lambda x, at: F.when(x["s"] < at, "").otherwise(F.concat(F.substring(text, at + 1, x["s"] - at), F.get(names, x["k"] % 4)))
    ends = lambda own: let(F.transform(own, lambda x: x["e"]), lambda v: prefixes(v, most))
    return let(spans, lambda own: F.concat(F.array_join(F.zip_with(own, ends(own), piece), ""), F.substring(text, F.array_max(F.transform(own, lambda x: x["e"])) + 1, F.length(text))))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of a text masked and n_chars, where there is one, brought up to date; null texts stay null.

    Texts are scanned once to learn and again where the rows are masked, so that no text is shuffled.
    """
    names = docs.columns
    docs = aside(docs, ("doc_id", "text", "n_chars"))
    rows = with_candidates(docs, F.coalesce("text", F.lit("")))
    done = decided(rows, weights_of(rows))
    text = F.when(F.size("found") + F.size("more") == 0, F.col("text")).otherwise(masked(F.coalesce("text", F.lit("")), all_spans()))
    out = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("found") + F.size("more") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns).toDF(*names)
