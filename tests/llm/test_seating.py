"""Numbers of tables against exact weights by recursion and by listing all seatings."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pytest

from lodequery.llm import pitman_yor, seating


def exact_weights(c, others, base, d, s, most):
    """Probabilities of 1 to `most` tables, from the recursion of Stirling numbers."""
    row = np.full(most + 1, -np.inf)
    row[0] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore"):
        for n in range(c):
            row = np.logaddexp(np.where(n > d * t, np.log(np.maximum(n - d * t, 1e-300)), -np.inf) + row, np.concatenate([[-np.inf], row[:-1]]))
    w = row[1:] + t[1:] * math.log(base) + np.cumsum(np.log(s + d * (others + np.arange(most))))
    w = np.exp(w - w.max())
    assert w[-1] < 1e-12
    return w / w.sum()


@pytest.mark.parametrize(("c", "others", "base", "most"), [(300, 500.0, 0.01, 200), (1500, 500.0, 0.01, 200), (1500, 50.0, 0.001, 200), (10_000, 10_000.0, 0.001, 250)])
def test_draws_of_many_customers_follow_the_exact_weights(c, others, base, most):
    p = exact_weights(c, others, base, 0.8, 1.0, most)
    n = 4000
    drawn = pitman_yor.draw_tables(np.full(n, c), np.full(n, others), np.full(n, base), 0.8, 1.0, (np.arange(n) + 0.5) / n)
    mean = (p * np.arange(1, most + 1)).sum()
    assert drawn.mean() == pytest.approx(mean, rel=0.01)
    cumulative = np.cumsum(np.bincount(drawn, minlength=most + 1)[1 : most + 1]) / n
    assert np.abs(cumulative - np.cumsum(p)).max() < 2 / n


@pytest.mark.parametrize("d", [0.1, 0.5, 0.8, 0.95])
def test_the_integral_equals_the_recursion(d):
    c = 1024
    t = np.arange(1, c + 1)
    want = seating.stirling(d)[c, 1:]
    got = seating.log_sibuya_sum(np.full(c, c), t, d) - np.array([math.lgamma(x + 1) for x in t]) - t * math.log(d) + math.lgamma(c + 1)
    assert np.abs(got - want)[: c * 4 // 5].max() < 1e-6 and np.abs(got - want).max() < 0.02


def test_sweeps_reach_the_distribution_over_all_seatings():
    """One restaurant of four dishes: mean tables over sweeps equal those of the listed joint distribution."""
    c, base, d, s = np.array([5, 3, 2, 8]), np.array([0.1, 0.3, 0.2, 0.05]), 0.6, 1.0
    table = seating.stirling(d)
    total, mean = 0.0, np.zeros(4)
    for t in product(*(range(1, n + 1) for n in c)):
        w = math.exp(sum(table[n, x] + x * math.log(b) for n, x, b in zip(c, t, base, strict=True)) + sum(math.log(s + d * j) for j in range(sum(t))))
        total, mean = total + w, mean + w * np.array(t)
    rng, t, tables, sums = np.random.default_rng(1), np.ones(4, np.int64), np.array([4]), np.zeros(4)
    for i in range(3000):
        t = seating.sweep(np.zeros(4, np.int64), c, t, tables, base, d, s, rng.random(4), parts=997)
        assert tables[0] == t.sum()
        sums += t * (i >= 200)
    assert sums / 2800 == pytest.approx(mean / total, rel=0.05)


def test_packed_numbers_come_back():
    for x in (np.array([], np.int64), np.array([0, 1, -3]), np.array([2**40, 5]), np.array([2**63 + 5, 7], np.uint64), np.array([300, 2])):
        assert pitman_yor.ints(pitman_yor.planes(x)).tolist() == x.tolist()
        assert pitman_yor.summed_steps(pitman_yor.steps(x)).tolist() == x.tolist()
