"""Whitening of vectors by a covariance that is summed with error-free transformations.

The vectors become integers; each distinct one counts once in the fit. Sums by dimension are exact integers. The
covariance takes a second pass: components less their mean, a pair of doubles (high and low part), are multiplied and summed as
such pairs, with the rounding error of each sum and product carried in the low part. Every task gives its
matrix row by row, and rows are merged by the same arithmetic, high with high and low with low, a group for each row
of the matrix. Only the finished matrix, of the square of the vectors' length, reaches the driver. Its
eigenvectors come from LAPACK's syevd: reduction to tridiagonal form, then divide and conquer.

Cases: rows whose vector is null or holds null or non-finite components are left out; rows without id stay, with a null id; rows that
repeat an id or a vector are returned each, though the vector counts once in the fit; vectors of several lengths are spaces of
their own, each with its own fit; an empty vector has no components and so no rows; integers beyond 2**62 are held
there; a deviation that doesn't fit in a long is null. A component whose eigenvalue can't be told from 0 (beyond
the rank of the fit) has explained 0 and a null whitened, and identity_error is over the others; a fit of one
vector has no variance, so all three are null. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodequery.llm.common import deleted, matrices, stored, whole

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_SPLIT = 2.0**27 + 1

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> Pair:
    """a as a sum of two numbers of at most 26 bits."""
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray, a_halves: Pair, b_halves: Pair) -> Pair:
    """a * b and its rounding error."""
    p = a * b
    (a1, a2), (b1, b2) = a_halves, b_halves
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def pair_sum(x: Pair, y: Pair) -> Pair:
    """The sum of two numbers that are pairs of a high and a low part."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def pair_total(x: Pair) -> Pair:
    """The sum of pairs along the first axis, by halving."""
    high, low = x
    while len(high) > 1:
        n = len(high) // 2
        odd = (high[2 * n :], low[2 * n :])
        high, low = pair_sum((high[:n], low[:n]), (high[n : 2 * n], low[n : 2 * n]))
        high, low = np.concatenate([high, odd[0]]), np.concatenate([low, odd[1]])
    return high[0], low[0]


def products(x: Pair, block: int = 2048) -> Pair:
    """The sum over rows of their outer products, as a pair of matrices."""
    d = x[0].shape[1]
    total = np.zeros((d, d)), np.zeros((d, d))
    for begin in range(0, len(x[0]), block):
        high, low = x[0][begin : begin + block], x[1][begin : begin + block]
        h1, h2 = halves(high)
        part = np.zeros((d, d)), np.zeros((d, d))
        for i in range(d):
            a, rest = slice(i, i + 1), slice(i, None)
            p, e = two_product(high[:, a], high[:, rest], (h1[:, a], h2[:, a]), (h1[:, rest], h2[:, rest]))
            own = pair_total(two_sum(p, e + high[:, a] * low[:, rest] + low[:, a] * high[:, rest]))
            for m, row in zip(part, own, strict=True):
                m[i, i:] = m[i:, i] = row
        total = pair_sum(total, part)
    return total


def centred(x: np.ndarray, mean: Pair) -> Pair:
    """x less the mean, as pairs; x are longs, split so that none is rounded."""
    top = (x >> 31) << 31
    s = pair_sum((top.astype(np.float64), (x - top).astype(np.float64)), (-mean[0], -mean[1]))
    return two_sum(*s)


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: how many vectors x there are and the exact sum of each component."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for _, x in matrices(b):
                n, total = found.get(x.shape[1], (0, 0))
                # a few thousand rows of longs can pass 2**63: the halves are summed apart
                total = total + (x >> 31).sum(axis=0).astype(object) * 2**31 + (x & (2**31 - 1)).sum(axis=0).astype(object)
                found[x.shape[1]] = n + len(x), total
        rows = [{"d": d, "at": i, "n": n, "total": Decimal(int(s))} for d, (n, total) in found.items() for i, s in enumerate(total)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("d", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]))

    parts = fit.mapInArrow(partial, "d int, at int, n long, total decimal(38,0)").groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.orderBy("d", "at").collect():  # a row for each dimension
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["total"]))
    return out


def product_sums(fit: DataFrame, prepared: Callable[[np.ndarray], Pair]) -> dict[int, np.ndarray]:
    """By length of x: the sum over the fit of the outer products of prepared(x), merged as pairs, then rounded to doubles."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Pair] = {}
        for b in batches:
            for _, x in matrices(b):
                own, d = products(prepared(x)), x.shape[1]
                found[d] = pair_sum(found[d], own) if d in found else own
        rows = [{"d": d, "at": i, "high": high, "low": low} for d, pair in found.items() for i, (high, low) in enumerate(zip(*(m.tolist() for m in pair), strict=True))]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("d", pa.int32()), ("at", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))]))

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        high, low = pair_total((np.array(parts["high"].tolist()), np.array(parts["low"].tolist())))
        return pd.DataFrame({"d": parts["d"].iloc[:1], "at": parts["at"].iloc[:1], "row": [(high + low).tolist()]})

    rows = fit.mapInArrow(partial, "d int, at int, high array<double>, low array<double>").groupBy("d", "at").applyInPandas(merged, "d int, at int, row array<double>")
    out: dict[int, list] = {}
    for r in rows.orderBy("d", "at").collect():  # a row for each row of the matrix
        out.setdefault(r["d"], []).append(r["row"])
    return {d: np.array(m) for d, m in out.items()}


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """For each row the sum over its components of (n*x - S)**2; None where that is no long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if most**2 * max(1, x.shape[1]) < 2**63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(table: DataFrame, components: int = 16, factor: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, for each row and each of the first `components`.

    table has vec_id and embedding; a component c becomes floor(factor * c) + shift.
    """
    spark, at, most = table.sparkSession, F.col("embedding").cast("array<double>"), 2**62
    integer = lambda c: F.least(F.greatest(F.floor(c * factor).cast("long"), F.lit(-most)), F.lit(most)) + F.lit(shift)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), at.alias("e")).where(whole(F.col("e"))).select("vec_id", F.transform("e", integer).alias("x"))
    fit = stored(rows.select("x").where(F.size("x") > 0).distinct(), "whitening")
    counts = sums(fit)
    exact = {d: [Fraction(s, n) for s in total] for d, (n, total) in counts.items()}
    high = {d: np.array([float(m) for m in own]) for d, own in exact.items()}
    means = {d: (high[d], np.array([float(m - Fraction(h)) for m, h in zip(own, high[d].tolist(), strict=True)])) for d, own in exact.items()}
    held_means = spark.sparkContext.broadcast(means)

    variances = product_sums(fit, lambda x: centred(x, held_means.value[x.shape[1]]))
    bases: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # length -> projection onto the components (over the root of e), explained
    for d, total in variances.items():
        e, vectors = np.linalg.eigh(total / counts[d][0])
        e, vectors, trace = e[::-1][:components], vectors[:, ::-1][:, :components], float(np.trace(total)) / counts[d][0]
        sure = e > d * np.finfo(float).eps * max(float(e[0]), 0.0) if len(e) else e > 0
        root = np.where(sure, np.sqrt(np.where(sure, e, 1.0)), np.nan)
        bases[d] = vectors / root, np.where(sure, e / trace, 0.0) if trace > 0 else np.full(len(e), np.nan)
    held = spark.sparkContext.broadcast(bases)

    def projected(x: np.ndarray) -> np.ndarray:
        c, onto = centred(x, held_means.value[x.shape[1]]), held.value[x.shape[1]][0]
        return c[0] @ onto + c[1] @ onto

    def white(x: np.ndarray) -> Pair:
        w = np.nan_to_num(projected(x))
        return w, np.zeros_like(w)

    errors: dict[int, float | None] = {}
    for d, total in product_sums(fit, white).items() if bases else ():
        sure = np.flatnonzero(~np.isnan(bases[d][0]).any(axis=0))
        left = total[np.ix_(sure, sure)] / counts[d][0] - np.eye(len(sure))
        errors[d] = float(np.abs(left).max()) if len(sure) else None

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, x in matrices(b):
                if (d := x.shape[1]) not in held.value:
                    continue
                n, total = counts[d]
                w, explained = projected(x), held.value[d][1]
                many = w.shape[1]
                ids = b.column("vec_id").take(pa.array(np.repeat(own, many)))
                away = pa.array(deviations(x, n, total), pa.int64()).take(pa.array(np.repeat(np.arange(len(own)), many)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(own))), pa.array(np.full(len(ids), n)), away, pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(explained, len(own)), from_pandas=True), pa.array([errors[d]] * len(ids), pa.float64()),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    deleted(fit)
    return rows.mapInArrow(out, SCHEMA)
