"""A random forest over a few numeric features, trained on the driver, applied as one SQL expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gini_split(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(impurity after the best cut, cut) of one feature."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = len(y)
    left = np.arange(1, n)
    ones = np.cumsum(y)[:-1]
    rest = y.sum() - ones
    gini = 2 * ones * (1 - ones / left) + 2 * rest * (1 - rest / (n - left))
    gini = np.where(x[1:] > x[:-1], gini, np.inf)
    k = int(np.argmin(gini))
    return float(gini[k]), float((x[k] + x[k + 1]) / 2)


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int):
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
        return p
    tried = rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False)
    cost, at, f = min((*_gini_split(x[:, f], y), int(f)) for f in tried)
    if not np.isfinite(cost):
        return p
    side = x[:, f] <= at
    return (f, at, _grow(x[side], y[side], rng, depth - 1, least), _grow(x[~side], y[~side], rng, depth - 1, least))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 7, least: int = 2, seed: int = 3) -> list:
    """Trees as nested (feature, cut, low side, high side); leaves are probabilities."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows], rng, depth, least))
    return out


def predict(forest: list, x: np.ndarray) -> np.ndarray:
    def one(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    return np.array([np.mean([one(t, row) for t in forest]) for row in x])


def expression(forest: list, names: list[str]) -> Column:
    """The mean probability of the trees, as nested conditions on the named columns."""

    def sql(tree) -> str:
        if not isinstance(tree, tuple):
            return f"{tree!r}D"
        f, at, low, high = tree
        return f"IF({names[f]} <= {at!r}D, {sql(low)}, {sql(high)})"

    return F.expr("(" + " + ".join(sql(t) for t in forest) + f") / {float(len(forest))}D")
