"""Gibbs sampling of Chinese-restaurant seatings, for many dishes in step.

A dish of a restaurant has customers at tables. Its customers get up and are seated anew, given all other dishes. A customer
joins a table of m others with weight m - discount and opens a new one with weight (strength + discount * tables) * parent,
where `parent` is the chance of the dish in the parent restaurant and `tables` counts all tables of the restaurant.
For a dish of up to `FEW` customers the number of tables is drawn from its exact distribution, a product of these
weights and of a generalised Stirling number, the ways to seat so many at so many tables; who sits where plays no part in any
prediction. A dish with more customers keeps its tables, and its customers move in `GROUPS` groups: one group leaves, drawn at
random, and sits down again by the weights at once, which keeps a sweep short however often a dish is ordered. Random numbers
are hashes of the dish's name, the sweep and the step, so a seating depends on nothing but the counts.
"""

from __future__ import annotations

import functools

import numpy as np

from larder.llm.textblocks import U64, mix

#: Customers of a dish up to which the number of tables is drawn at once.
FEW = 256
#: Groups in which the customers of larger dishes move.
GROUPS = 32
#: Cells of the tables that are worked on together.
CELLS = 1 << 20


class _Chances:
    """Uniform numbers from 0 up to 1, in steps of 2**-32: for each row a sequence of its own, whatever other rows draw."""

    def __init__(self, names: np.ndarray, salt: int):
        with np.errstate(over="ignore"):
            self.names = mix(names.astype(np.uint64) + U64(0x9E3779B97F4A7C15) * U64(salt + 1))

    def draw(self, rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            self.names[rows] += U64(0xD1B54A32D192ED03)
            return (mix(self.names[rows]) >> U64(32)).astype(float) / 2.0**32


def _dealt(weights: np.ndarray, number: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """`number` things dealt out by weights; one thing falls on each place with its share as chance."""
    upto = np.cumsum(weights, axis=1)
    whole = np.maximum(upto[:, -1:], 1e-300)
    full = upto >= whole
    marks = upto / whole
    marks *= number[:, None]
    marks += chance[:, None]
    marks = np.where(full, number[:, None], np.minimum(np.floor(marks, out=marks), number[:, None], out=marks)).astype(np.int64)
    marks[:, 1:] -= marks[:, :-1].copy()
    return marks


class Seating:
    """Tables of the dishes of one chunk; `others` are the tables of each one's restaurant that serve other dishes."""

    def __init__(self, tables: np.ndarray, t: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float,
                 chances: _Chances, names: np.ndarray):
        self.m, self.t, self.others, self.parent = tables, t, others, parent
        self.strength, self.discount, self.chances, self.names = strength, discount, chances, names
        self.c = tables.sum(axis=1)

    def leave(self, rows: slice | np.ndarray, number: np.ndarray) -> None:
        """`number` customers of each row, drawn at random, go away."""
        m = self.m[rows]
        m = m - _dealt(m, number, self.chances.draw(self.names[rows]))
        seated = m > 0
        t = seated.sum(axis=1)
        holes = np.flatnonzero(t < self.t[rows])
        if len(holes):  # the tables that are left stand first
            order = np.argsort(~seated[holes], axis=1, kind="stable")
            m[holes] = np.take_along_axis(m[holes], order, axis=1)
        self.m[rows], self.t[rows] = m, t
        self.c[rows] -= number

    def sit(self, rows: slice | np.ndarray, number: np.ndarray) -> None:
        """`number` customers of each row come in."""
        t, c = self.t[rows], self.c[rows]
        new = (self.strength + self.discount * (self.others[rows] + t)) * self.parent[rows]
        share = np.where(t > 0, new / np.maximum(c - self.discount * t + new, 1e-300), 1.0)
        born = np.minimum(np.floor(number * share + self.chances.draw(self.names[rows])), number).astype(np.int64)
        width = int((t + born).max(initial=0))
        if width > self.m.shape[1]:
            self.m = np.concatenate([self.m, np.zeros((len(self.m), width + 8 - self.m.shape[1]), np.int64)], axis=1)
        m = self.m[rows]
        place = np.arange(m.shape[1])[None, :]
        m = m + _dealt(np.where(m > 0, m - self.discount, 0.0), number - born, self.chances.draw(self.names[rows]))
        m[(place >= t[:, None]) & (place < (t + born)[:, None])] = 1
        self.m[rows] = m
        self.t[rows] = t + born
        self.c[rows] += number

    def adjust(self, wanted: np.ndarray) -> None:
        """Customers come or go until there are as many as `wanted`."""
        while True:
            more = np.flatnonzero(self.c < wanted)
            less = np.flatnonzero(self.c > wanted)
            if not len(more) and not len(less):
                return
            if len(more):
                self.sit(more, np.minimum(wanted[more] - self.c[more], np.maximum(1, self.c[more] // GROUPS)))
            if len(less):
                self.leave(less, np.minimum(self.c[less] - wanted[less], np.maximum(1, self.c[less] // GROUPS)))

    def sweep(self) -> None:
        """Every group of customers, of one each while they are few, is seated anew; rows stand by falling customers."""
        size = -(-self.c // GROUPS)
        for step in range(min(GROUPS, int(self.c.max(initial=0)))):
            rows = slice(0, int(np.searchsorted(-self.c, -step, "left")))  # those with more customers than steps done
            self.leave(rows, size[rows])
            self.sit(rows, size[rows])


@functools.lru_cache(maxsize=8)
def _ways(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: row c, column t - 1 for c customers at t tables."""
    out = np.full((FEW + 1, FEW + 1), -np.inf)
    out[1, 0] = 0.0
    t = np.arange(1, FEW + 1)
    for c in range(1, FEW):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, out[c, :-1] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        new = np.concatenate([[-np.inf], out[c, : FEW - 1]])
        out[c + 1, :-1] = np.logaddexp(stay, new)
    return out


def _few(c: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float, chance: np.ndarray) -> np.ndarray:
    """Tables for `c` customers of each dish, 2 to `FEW`, drawn given the restaurant's other tables."""
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(2, FEW + 2))
    for size, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 2):
        step = max(1, CELLS // (4 * size))
        for first in range(low, high, step):
            rows = order[first : min(high, first + step)]
            tables = np.arange(size)[None, :]
            weights = np.log((strength + discount * (others[rows][:, None] + tables)) * parent[rows][:, None])
            weights = np.cumsum(weights, axis=1) + _ways(discount)[size, :size]
            weights = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
            out[rows] = 1 + (weights[:, :-1] <= chance[rows][:, None] * weights[:, -1:]).sum(axis=1)
    return out


def reseat(names: np.ndarray, tables: np.ndarray, before: np.ndarray, t: np.ndarray, wanted: np.ndarray, total: np.ndarray, parent: np.ndarray,
           strength: float, discount: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, t) of all dishes, with `wanted` customers each, after one sweep.

    `before` customers sat at `t` tables; `total` counts the tables of each dish's restaurant. `tables` holds the customers
    of each table, dish after dish, for those with more than `FEW` customers. The dishes keep their order.
    """
    chances = _Chances(names, salt)
    after = np.minimum(wanted, 1)
    few = np.flatnonzero((wanted > 1) & (wanted <= FEW))
    after[few] = _few(wanted[few], (total - t)[few], parent[few], strength, discount, chances.draw(few))
    many = np.flatnonzero(wanted > FEW)
    if not len(many):
        return np.zeros(0, np.int64), after
    many = many[np.argsort(-wanted[many], kind="stable")]
    kept = before > FEW
    begins = np.cumsum(np.where(kept, t, 0)) - np.where(kept, t, 0)
    out: dict[int, np.ndarray] = {}
    first = 0
    while first < len(many):
        width = int(t[many[first : first + CELLS]].max()) + 4
        rows = many[first : first + max(1, CELLS // width)]
        place = np.arange(width)[None, :]
        m = np.zeros((len(rows), width), np.int64)
        known = kept[rows]
        filled = (place < t[rows][:, None]) & known[:, None]
        m[filled] = tables[(begins[rows][:, None] + place)[filled]]
        m[~known, 0] = wanted[rows[~known]]  # a dish that was smaller starts at one table
        begun = np.where(known, t[rows], 1)
        seating = Seating(m, begun, total[rows] - t[rows], parent[rows], strength, discount, chances, rows)
        seating.adjust(wanted[rows])
        seating.sweep()
        after[rows] = seating.t
        for row, sizes, count in zip(rows.tolist(), seating.m, seating.t, strict=True):
            out[row] = sizes[:count]
        first += len(rows)
    return np.concatenate([out[row] for row in sorted(out)]), after
