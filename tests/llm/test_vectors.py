"""Vector codes and whitening against brute force."""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pytest

from lodequery.llm import vector_codes, whitening


def plain_codes(rows, parts, entries, rounds=2):
    """rows: (id, label, integers); all rows are compared with all entries. (id, code, error, label_error, hash) of each."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))
    d = len(rows[0][2])
    cut = lambda x, p: x[d * p // parts : d * (p + 1) // parts]
    books = [[cut(rows[i][2], p) for i in order[:entries]] for p in range(parts)]
    for turn in range(rounds + 1):
        found = [[min((sum((a - b) ** 2 for a, b in zip(cut(x, p), e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, _, x in rows]
        if turn < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    if own := [cut(x, p) for (_, _, x), f in zip(rows, found, strict=True) if f[p][1] == j]:
                        books[p][j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    errors = [sum(e for e, _ in f) for f in found]
    by_label = {}
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    return [(i, "".join(f"{j:02x}" for _, j in f), e, by_label[label], digest) for (i, label, _), f, e in zip(rows, found, errors, strict=True)]


def by_text(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("most_labels", [100_000, 1])
def test_codes_against_all_comparisons(spark, most_labels):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(i % 3), rng.normal(size=8).round(2).tolist()) for i in rng.permutation(200)]
    rows += [(500 + i, None, [0.5] * 8) for i in range(40)]  # equal vectors, null labels
    rows += [(7, 1, [3.0, -3.0] * 4), (7, 1, [-2.0] * 8), (None, 2, [1.5] * 8), rows[0], rows[0]]  # repeated ids and rows, no id
    bad = [(900, 1, None), (901, 1, [float("nan")] * 8), (902, 1, [float("inf")] + [0.0] * 7), (903, 1, [None] * 8)]
    table = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, label int, embedding array<double>, code string").repartition(5)
    got = [tuple(r) for r in vector_codes.code(table, parts=4, entries=16, most_labels=most_labels).collect()]
    want = plain_codes([(i, label, np.floor(256 * np.array(v)).astype(int).tolist()) for i, label, v in rows], 4, 16)
    assert by_text(got) == by_text(want)


def test_codes_of_several_lengths_few_rows_and_large_numbers(spark):
    rows = [(1, 0, [0.25, 1.0, -1.0]), (2, 0, [0.5, 1.0, 2.0]), (3, 1, [4.0]), (4, 1, []), (5, 2, [2.0**45, -(2.0**45)]), (6, 2, [2.0**44, 1.0])]
    got = {r[0]: tuple(r) for r in vector_codes.code(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), parts=2, entries=4).collect()}
    want = {}
    for d in (3, 1, 0, 2):
        want |= {r[0]: r for r in plain_codes([(i, n, [int(256 * c // 1) for c in v]) for i, n, v in rows if len(v) == d], 2, 4)}
    assert {i: r[1:3] + r[4:] for i, r in got.items()} == {i: r[1:3] + r[4:] for i, r in want.items()}
    assert vector_codes.code(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_the_radius_holds_every_nearest_entry():
    """Any start gives the nearest entry, also where entries are equal or all distances tie; far neighbours aren't scanned."""
    rng = np.random.default_rng(4)
    entries = np.concatenate([rng.integers(-3, 4, (20, 2)), rng.integers(1000, 1004, (20, 2))]).astype(np.int64)
    x = np.concatenate([rng.integers(-5, 6, (300, 2)), rng.integers(990, 1010, (300, 2))]).astype(np.int64)
    book = vector_codes.Book(entries)
    want = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for start in (np.zeros(600, np.int64), rng.integers(0, 40, 600)):
        code, best = book.nearest(x, start)
        assert (code == want.argmin(axis=1)).all() and (best == want.min(axis=1)).all()
    assert (book.far[:20] <= 4 * 100).sum() <= 20 * 19


# ---- whitening ---------------------------------------------------------------------------------


def exact_covariance(x):
    """Of distinct rows of Python integers: n, sums and the covariance, in fractions."""
    n, d = len(x), len(x[0])
    total = [sum(r[i] for r in x) for i in range(d)]
    away = [[n * v - s for v, s in zip(r, total, strict=True)] for r in x]
    return n, total, [[Fraction(sum(r[i] * r[j] for r in away), n**3) for j in range(d)] for i in range(d)]


def test_products_are_exact_to_the_last_bits():
    """Where a plain sum of squares loses all digits, the pairs keep them."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (3000, 3)) + np.array([10**12, -(10**14), 7])
    mean = [Fraction(int(s), len(x)) for s in x.sum(axis=0)]
    high = np.array([float(m) for m in mean])
    low = np.array([float(m - Fraction(float(m))) for m in mean])
    total = whitening.products(whitening.centred(x.astype(np.int64), (high, low)))
    for i in range(3):
        for j in range(3):
            want = sum((int(r[i]) - mean[i]) * (int(r[j]) - mean[j]) for r in x)
            got = Fraction(float(total[0][i, j])) + Fraction(float(total[1][i, j]))
            assert abs(got - want) <= abs(want) * Fraction(1, 2**80) + Fraction(1, 2**60)


def test_whitening_against_exact_numbers(spark):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(6, 6)) * np.array([3, 2, 1, 0.6, 0.4, 0.2])
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)) @ mix.T)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(None, [1.0] * 6), rows[5]]  # repeated vectors, no id, a repeated row
    bad = [(2000, None), (2001, [float("nan")] * 6), (2002, [None] * 6), (2003, [float("-inf")] * 6)]
    table = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, n int").repartition(4)
    got = whitening.whiten(table, components=4).toPandas()
    whole = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    n, total, v = exact_covariance([list(x) for x in sorted({tuple(x) for x in whole})])
    v = np.array([[float(c) for c in row] for row in v])
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(got) == 4 * len(rows) and set(got["n"]) == {n} and (got["identity_error"] < 1e-12).all()
    assert np.allclose(sorted(set(got["explained"]))[::-1], (e / e.sum())[:4], rtol=1e-12)
    away = {(i if i is not None else -1, sum((n * c - s) ** 2 for c, s in zip(x, total, strict=True))) for (i, _), x in zip(rows, whole, strict=True)}
    assert set(zip(got["vec_id"].fillna(-1).astype(int), got["deviation"], strict=True)) == away
    one = got[got["vec_id"] == 7].sort_values("component")["whitened"].to_numpy()
    centred = np.array([float(Fraction(c) - Fraction(s, n)) for c, s in zip(whole[7], total, strict=True)])
    vectors = np.linalg.eigh(v)[1][:, ::-1][:, :4]
    assert np.allclose(np.abs(one), np.abs(centred @ vectors) / np.sqrt(e[:4]), rtol=1e-9)


def test_whitening_beyond_the_rank_and_of_few_rows(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(5)] + [(10, [1.0]), (11, []), (12, [1e300, -1e300]), (13, [0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    flat = got[got["vec_id"] < 5]
    assert flat[flat["component"] > 1]["whitened"].isna().all() and flat[flat["component"] == 1]["whitened"].notna().all()
    assert np.allclose(flat[flat["component"] == 1]["explained"], 1) and (flat["identity_error"] < 1e-12).all()
    alone = got[got["vec_id"] == 10]
    assert len(alone) == 1 and alone[["whitened", "explained", "identity_error"]].isna().all(axis=None) and list(alone["deviation"]) == [0]
    assert len(got[got["vec_id"] == 11]) == 0 and got[got["vec_id"] == 12]["deviation"].isna().all()
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
