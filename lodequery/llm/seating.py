"""Numbers of tables in Chinese restaurants of the Pitman-Yor process, drawn from their exact conditionals.

A dish of c customers in a restaurant with `others` tables of other dishes sits at t tables with a
probability in proportion to S(c, t) * base^t * product over j < t of (strength + discount * (others + j)),
where S are generalised Stirling numbers. Up to TABLED customers S comes from its recursion. For more
customers it is a contour integral: t! discount^t S(c, t) / c! is the probability that t Sibuya variables sum
up to c, which is the coefficient of z^c in (1 - (1 - z)^discount)^t. Its integral along a parabola around the
cut from 1 to infinity, through the saddle point, converges geometrically in the number of nodes, so any number of customers takes the
same few evaluations for each t. Only the t that can matter (within exp(-40) of the mode) are evaluated. The many dishes of
up to FEW customers are drawn from products of the ratios of neighbouring weights, without logarithms.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

TABLED = 1024
#: Customers up to which weights are plain numbers, not logarithms.
FEW = 48
#: Nodes of the integral for weights, and for the search of their mode, which need not be exact.
NODES, ROUGH = 64, 20


@lru_cache(maxsize=4)
def stirling(discount: float, most: int = TABLED) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [c, t] for c customers at t tables, up to `most`."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            n = c + 2
            stay = np.where(c > discount * t[:n], np.log(np.maximum(c - discount * t[:n], 1e-300)) + out[c, :n], -np.inf)
            out[c + 1, :n] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, : n - 1]]))
    return out


@lru_cache(maxsize=4)
def growths(discount: float, most: int) -> np.ndarray:
    """[t, c]: the generalised Stirling number of c customers at t + 1 tables over that at t, 0 from t = c on."""
    table = stirling(discount)[: most + 1, : most + 2]
    with np.errstate(invalid="ignore"):
        out = np.exp(np.diff(table, axis=1))
    out[~np.isfinite(out)] = 0
    return np.ascontiguousarray(out.T)


def draw_of_few(c: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, chance: np.ndarray, size: int) -> np.ndarray | None:
    """Tables of dishes of up to `size` customers: each t's weight is the one before times a factor, in plain numbers. None where these get too large."""
    growth, now = growths(discount, FEW), strength + discount * others
    weight, total, sums = np.ones(len(c)), np.ones(len(c)), []
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(1, size):
            sums.append(total)
            now = now + discount
            weight = weight * (growth[t][c] * base * now)
            total = total + weight
    if not np.isfinite(total).all():
        return None
    limit, out = chance * total, np.ones(len(c), np.int64)
    for s in sums:
        out += s < limit
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(x + i) for i in range(8))


def log_sibuya_sum(c: np.ndarray, t: np.ndarray, discount: float, nodes: int = NODES) -> np.ndarray:
    """Logarithm of the probability that t independent Sibuya variables sum up to c, for each pair of c and t (1 to c)."""
    t, c = np.asarray(t, np.float64), np.broadcast_to(np.asarray(c, np.float64), np.shape(t))
    low, high = -np.log(c) - 1, np.full(len(t), -1e-16)
    for _ in range(26):  # the saddle point 1 - x, by bisection on log x
        mid = (low + high) / 2
        over = t * discount * np.exp((discount - 1) * mid) * -np.expm1(mid) > (c + 1) * -np.expm1(discount * mid)
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    root = np.sqrt(np.maximum(np.exp((low + high) / 2) * c, 3.0))
    # the exponent's curvature at the crossing gives the scale of the nodes
    x = np.minimum(root**2 / c, 1 - 1e-12)
    p = x**discount
    slope = (c + 1) / (1 - x) ** 2 + t * discount * x ** (discount - 2) * ((1 - discount) * (1 - p) - discount * p) / (1 - p) ** 2
    reach = np.minimum(10.0, 7 * c / (root * np.sqrt(np.maximum(np.abs(slope), 1e-300))))
    s = (np.arange(nodes) + 0.5) / nodes * reach[:, None]
    w = root[:, None] + 1j * s
    y = w * w / c[:, None]
    f = t[:, None] * np.log1p(-np.exp(discount * np.log(y))) - (c + 1)[:, None] * np.log1p(-y)
    top = f.real.max(axis=1, keepdims=True)
    total = (np.exp(f - top) * w).real.sum(axis=1) * reach / nodes * 2 / np.pi / c
    return np.where(t == c, t * np.log(discount), np.log(np.maximum(total, 1e-300)) + top[:, 0])


def draw_of_many(c: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, chance: np.ndarray, far: float = 40.0) -> np.ndarray:
    """Tables of dishes of many customers: the mode is found on ever finer grids, then all t within exp(-far) of it are weighed."""

    def weigh(row: np.ndarray, t: np.ndarray, nodes: int = ROUGH) -> np.ndarray:
        out = []
        for i in range(0, len(t), 8192):
            r, x = row[i : i + 8192], t[i : i + 8192].astype(np.float64)
            a = strength / discount + others[r]
            out.append(log_sibuya_sum(c[r], x, discount, nodes) - log_gamma(x + 1) + log_gamma(a + x) - log_gamma(a) + x * np.log(base[r]))
        return np.concatenate(out)

    n, every = len(c), np.arange(len(c))
    mode, top, low, high = np.ones(n, np.int64), np.full(n, -np.inf), np.ones(n, np.int64), c.astype(np.int64)
    left, first = every, True
    while len(left):
        parts = np.linspace(0, 1, 24)
        grid = np.exp(np.log(low[left])[:, None] * (1 - parts) + np.log(high[left])[:, None] * parts) if first else low[left][:, None] + (high - low)[left][:, None] * parts
        grid = np.clip(np.rint(grid).astype(np.int64), low[left][:, None], high[left][:, None])
        w = weigh(np.repeat(left, 24), grid.ravel()).reshape(-1, 24)
        best = w.argmax(axis=1)
        at = np.arange(len(left))
        mode[left], top[left] = grid[at, best], w[at, best]
        # the nearest other points of the grid enclose the mode
        low[left] = np.where(grid < mode[left][:, None], grid, low[left][:, None]).max(axis=1)
        high[left] = np.where(grid > mode[left][:, None], grid, high[left][:, None]).min(axis=1)
        left, first = left[(high - low)[left] > 2], False
    ends = []
    for direction in (-1, 1):
        # the first eight doublings at once, then one by one
        steps = 2 ** np.arange(8)
        t = mode[:, None] + direction * steps
        inside = (t >= 1) & (t <= c[:, None])
        row, col = np.nonzero(inside)
        inside[row, col] = weigh(row, t[row, col]) > top[row] - far if len(row) else False
        ended = (~inside).argmax(axis=1)
        step, left = np.where(inside.all(axis=1), 256, steps[ended]), np.flatnonzero(inside.all(axis=1))
        while len(left):
            t = mode[left] + direction * step[left]
            left = left[(t >= 1) & (t <= c[left])]
            if len(left):
                left = left[weigh(left, mode[left] + direction * step[left]) > top[left] - far]
                step[left] *= 2
        ends.append(np.clip(mode + direction * step, 1, c))
    out, many = mode.copy(), ends[1] - ends[0] + 1
    for rows in np.split(every, np.flatnonzero(np.diff(np.cumsum(many) // 500_000)) + 1):  # so many t at a time
        starts = np.cumsum(many[rows]) - many[rows]
        row = np.repeat(rows, many[rows])
        t = np.arange(len(row)) - np.repeat(starts, many[rows]) + ends[0][row]
        w = weigh(row, t, NODES)
        w = np.exp(w - np.repeat(np.maximum.reduceat(w, starts), many[rows]))
        for i, a in zip(rows.tolist(), starts.tolist(), strict=True):
            sums = np.cumsum(w[a : a + many[i]])
            out[i] = ends[0][i] + min(int(np.searchsorted(sums, chance[i] * sums[-1])), int(many[i]) - 1)
    return out


def draw_tables(c: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, chance: np.ndarray | np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers each, in restaurants with `others` tables of other dishes and base probability `base`.

    chance: a number from 0 to 1 for each dish, or a generator that gives them.
    """
    t = np.ones(len(c), np.int64)
    if isinstance(chance, np.random.Generator):
        chance = chance.random(len(c))
    table = stirling(discount)
    # dishes of about equal size together: 2, 3, 4, up to 6, 8, 12 and so on
    edges = np.unique(np.concatenate([[1, 2, 3], 2 ** np.arange(2, 11), 3 * 2 ** np.arange(1, 9), [TABLED]]))
    group = np.searchsorted(edges, c)
    order = np.argsort(group.astype(np.uint8), kind="stable")  # numbers of one byte are sorted by radix
    groups, starts = np.unique(group[order], return_index=True)
    for g, begin, stop in zip(groups.tolist(), starts.tolist(), [*starts[1:].tolist(), len(c)][: len(groups)], strict=True):
        if g == 0:
            continue
        if g == len(edges):
            rows = order[begin:]
            t[rows] = draw_of_many(c[rows], others[rows], base[rows], discount, strength, chance[rows])
            break
        size = int(edges[g])
        step = max(1, 400_000 // size)
        for i in range(begin, stop, step):
            rows = order[i : min(i + step, stop)]
            if size <= FEW and (few := draw_of_few(c[rows], others[rows], base[rows], discount, strength, chance[rows], size)) is not None:
                t[rows] = few
                continue
            weight = np.log((strength + discount * (others[rows, None] + np.arange(size))) * base[rows, None])
            np.cumsum(weight, axis=1, out=weight)
            weight += table[c[rows], 1 : size + 1]
            weight -= weight.max(axis=1, keepdims=True)
            np.exp(weight, out=weight)
            np.cumsum(weight, axis=1, out=weight)
            t[rows] = 1 + (weight < chance[rows, None] * weight[:, -1:]).sum(axis=1)
    return np.minimum(t, np.maximum(c, 1))


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values of integers."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def chances(seed: int, round_: int, *keys: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each key, the same wherever and in whatever order it is drawn."""
    h = mixed(np.array([seed * 1_000_003 + round_ + 1]))
    for k in keys:
        h = mixed(h ^ mixed(k.astype(np.int64) + 1))
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sweep(at: np.ndarray, c: np.ndarray, t: np.ndarray, total: np.ndarray, base: np.ndarray, discount: float, strength: float, chance: np.ndarray, parts: int = 4) -> np.ndarray:
    """One Gibbs sweep over dishes: t anew; at: index into total, the tables of each restaurant, kept up to date between the parts."""
    t = t.copy()
    part = (chance * 2**20).astype(np.int64) % parts
    for k in np.unique(part):
        rows = np.flatnonzero(part == k)
        new = draw_tables(c[rows], total[at[rows]] - t[rows], base[rows], discount, strength, chance[rows])
        total += np.bincount(at[rows], new - t[rows], len(total)).astype(total.dtype)
        t[rows] = new
    return t
