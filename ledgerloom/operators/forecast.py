"""Walk-forward models: each date's model sees only what was filed before that date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_before(tests: DataFrame, train: DataFrame) -> DataFrame:
    """Each test date with all rows filed before it. Dates are few (one a quarter and ticker); rows are a quarter's."""
    dates = tests.select("nowcast_date").distinct()
    return dates.join(train, F.col("filed") < F.col("nowcast_date"))


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Offset (not penalised) and weights."""
    mean = x.mean(0)
    z = x - mean
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return float(y.mean() - mean @ w), w


def best_ridge(x: np.ndarray, y: np.ndarray, alphas: np.ndarray) -> tuple[float, np.ndarray]:
    """The penalty with the least leave-one-out error, by the hat matrix."""
    z, best = x - x.mean(0), (np.inf, alphas[0])
    for a in alphas:
        hat = z @ np.linalg.solve(z.T @ z + a * np.eye(x.shape[1]), z.T) + 1 / len(y)
        miss = (y - hat @ y) / np.maximum(1 - np.diag(hat), 1e-9)
        best = min(best, (float((miss**2).mean()), a))
    return ridge(x, y, best[1])


def boost(x: np.ndarray, y: np.ndarray, trees: int = 300, rate: float = 0.05, depth: int = 3, leaf: int = 10, l2: float = 1.0):
    """Squared-error boosted trees on quantile cuts; returns a predictor."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 16))) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]  # a row is left of cut k if its bin is k at most
    base, out, rules = y.mean(), np.full(len(y), y.mean()), []

    def grow(at: np.ndarray, level: int, g: np.ndarray):
        if level < depth and len(at) >= 2 * leaf:
            best, total = (1e-12, None, None), g.sum()
            for f, c in enumerate(cuts):
                n = np.bincount(bins[f][at], minlength=len(c) + 1)[:-1].cumsum()
                s = np.bincount(bins[f][at], g, len(c) + 1)[:-1].cumsum()
                gain = s**2 / (n + l2) + (total - s) ** 2 / (len(at) - n + l2) - total**2 / (len(at) + l2)
                gain[(n < leaf) | (n > len(at) - leaf)] = -np.inf
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] is not None:
                left = bins[best[1]][at] <= best[2]
                return best[1], cuts[best[1]][best[2]], grow(at[left], level + 1, g[left]), grow(at[~left], level + 1, g[~left])
        return rate * g.sum() / (len(at) + l2)

    def values(tree, rows: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(rows), tree)
        return np.where(rows[:, tree[0]] <= tree[1], values(tree[2], rows), values(tree[3], rows))

    for _ in range(trees):
        tree = grow(np.arange(len(y)), 0, y - out)
        if not isinstance(tree, tuple):
            break
        rules.append(tree)
        out += values(tree, x)
    return lambda rows: base + sum((values(t, rows) for t in rules), np.zeros(len(rows)))


#: Ridge penalties to choose from.
ALPHAS = np.logspace(-3, 2, 12)
PREDICTED = "ticker string, period_end date, model string, pred double"


def walk(features: DataFrame, columns: list[str], models: tuple[str, ...], min_train: int = 12, trees: int = 300) -> DataFrame:
    """ticker, period_end, model, pred for each row, from rows filed before its nowcast_date. Columns: ticker, period_end,
    filed, nowcast_date, rev_yoy and the features. One group a date; it holds all earlier quarters of all tickers."""
    test = features.select(F.lit(True).alias("test"), "*")
    known = features.select(*[c for c in features.columns if c != "nowcast_date"])
    train = known_before(features, known).select(F.lit(False).alias("test"), *features.columns)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[~g.test].sort_values(["ticker", "period_end"]), g[g.test].sort_values(["ticker", "period_end"])
        out = []
        if len(a) >= min_train:
            tickers = sorted(set(a.ticker) | set(b.ticker))
            hot = lambda d: np.stack([(d.ticker == t).to_numpy(float) for t in tickers], 1)
            xa, xb, y = np.hstack([a[columns].to_numpy(float), hot(a)]), np.hstack([b[columns].to_numpy(float), hot(b)]), a["rev_yoy"].to_numpy(float)
            preds = {}
            if {"ridge", "ensemble"} & set(models):
                w0, w = best_ridge(xa, y, ALPHAS)
                preds["ridge"] = w0 + xb @ w
            if {"gbm", "ensemble"} & set(models):
                w0, w = best_ridge(a[columns].to_numpy(float), y, ALPHAS)
                rest = boost(a[columns].to_numpy(float), y - (w0 + a[columns].to_numpy(float) @ w), trees)
                preds["gbm"] = w0 + b[columns].to_numpy(float) @ w + rest(b[columns].to_numpy(float))
            if "ensemble" in models:
                preds["ensemble"] = (preds["ridge"] + preds["gbm"]) / 2
            out = [(t, e, m, float(p)) for m in models for t, e, p in zip(b.ticker, b.period_end, preds[m], strict=True)]
        return pd.DataFrame(out, columns=["ticker", "period_end", "model", "pred"])

    return test.unionByName(train).groupBy("nowcast_date").applyInPandas(one, PREDICTED)
