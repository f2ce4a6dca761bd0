"""Quality classifier: a sparse ensemble of rules (operator 5).

Small boosted trees are grown over statistics of a text. Every path from a root to a node is a rule, a conjunction of
bounds. A logistic model with an L1 penalty over all rules gives most of them no weight; those that are left become one
Spark column expression over the statistics, so scoring needs no Python.

Labels are learnt from a bounded sample of labelled rows (`SAMPLE`, those with the smallest hashes of their ids); all
rows are scored. Null texts count as empty; an empty text has statistics of 0 and a score like any other; texts of any
length count in full; repeated rows are scored alike; documents without a label take no part in learning, and labels of
one document that disagree count as their mean; without labels, or with one kind only, the score is their smoothed
share; an empty table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import word_lines, words

#: Labelled rows to learn from at most.
SAMPLE = 12_000
TREES, DEPTH, LEAF, RATE, CUTS = 50, 3, 15, 0.15, 24
#: The L1 penalty, per row, and the steps that fit the weights.
PENALTY, STEPS = 0.0008, 1500


def _rate(n: Column, of: Column) -> Column:
    return n.cast("double") / F.greatest(of, F.lit(1)).cast("double")


def statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Statistics of a text by name; words and lines are arrays of it."""
    n, chars = F.size(words), F.char_length(text)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    same = F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    without = lambda marks: chars - F.char_length(F.translate(text, marks, ""))
    return {
        "n_words": n.cast("double"),
        "word_length": _rate(chars, n),
        "symbols": _rate(without("#*$%&|<>"), n),
        "bars": _rate(without("|"), n),
        "shouts": _rate(without("!"), n),
        "stops": _rate(without(".,;:?"), n),
        "digits": _rate(without("0123456789"), chars),
        "capitals": _rate(F.regexp_count(text, F.lit(r"\p{Lu}")), letters),
        "letters": _rate(letters, chars),
        "distinct": _rate(F.size(F.array_distinct(words)), n),
        "twice": _rate(F.size(F.filter(same, lambda x: x)), n),
        "dup_lines": _rate(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": _rate(n, F.size(lines)),
    }


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics."""
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = base.select("doc_id", "text", words(F.col("text")).alias("words"), word_lines(F.col("text")).alias("lines"))
    return split.select("doc_id", *[v.alias(k) for k, v in statistics(F.col("text"), F.col("words"), F.col("lines")).items()])


@dataclass(frozen=True)
class Bound:
    """Feature number `feature` is at most `cut`, or (above) over it."""

    feature: int
    cut: float
    above: bool


Rule = frozenset  # of Bounds, all of which hold


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for b in rule:
        out &= (x[:, b.feature] > b.cut) == b.above
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[Rule]:
    """The paths of boosted trees, without repetitions. Each tree is grown on half of the rows."""
    rng, n = np.random.default_rng(seed), len(x)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
    score, found = np.full(n, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, p * (1 - p) + 1e-6
        some = np.zeros(n, bool)
        some[rng.permutation(n)[: n // 2 + 1]] = True
        todo = [(np.ones(n, bool), frozenset(), 0)]
        while todo:
            at, rule, depth = todo.pop()
            use = at & some
            if depth < DEPTH and use.sum() >= 2 * LEAF:
                g, w = gradient[use].sum(), weight[use].sum()
                best = (1e-3, None, None)
                for f, c in enumerate(cuts):
                    size = len(c) + 1
                    gl, wl, nl = (np.bincount(bins[f][use], v[use] if v is not None else None, size).cumsum()[:-1] for v in (gradient, weight, None))
                    ok = (nl >= LEAF) & (use.sum() - nl >= LEAF)
                    gain = np.where(ok, gl**2 / (wl + 1) + (g - gl) ** 2 / (w - wl + 1) - g**2 / (w + 1), -1)
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), f, float(c[gain.argmax()]))
                if best[1] is not None:
                    _, f, cut = best
                    for above in (False, True):
                        inner = rule | {Bound(f, cut, above)}
                        found.setdefault(tighten(inner), None)
                        todo.append((at & ((x[:, f] > cut) == above), inner, depth + 1))
                    continue
            if use.any():
                score[at] += RATE * gradient[use].sum() / (weight[use].sum() + 1)
    return list(found)


def tighten(rule: Rule) -> Rule:
    """Of several bounds to the same side of a feature only the tightest."""
    best: dict[tuple[int, bool], float] = {}
    for b in rule:
        k = (b.feature, b.above)
        best[k] = b.cut if k not in best else max(best[k], b.cut) if b.above else min(best[k], b.cut)
    return frozenset(Bound(f, cut, above) for (f, above), cut in best.items())


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Offset and weights of a logistic model with an L1 penalty, by accelerated proximal gradient steps."""
    n, m = r.shape
    scale = np.maximum(r.std(0), 0.05)
    z = (r - r.mean(0)) / scale
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    b, w = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), np.zeros(m)
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(steps):
        miss = 1 / (1 + np.exp(-np.clip(vb + z @ vw, -30, 30))) - y
        nb = vb - step * miss.mean()
        nw = vw - step * (z.T @ miss) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        done = np.abs(nw - w).max(initial=0) + abs(nb - b) < 1e-6
        b, w, t = nb, nw, nt
        if done:
            break
    return float(b - (r.mean(0) / scale) @ w), w / scale


@dataclass(frozen=True)
class Ensemble:
    features: list[str]
    offset: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score over columns named like the features."""
        total = F.lit(self.offset)
        for rule, weight in self.rules:
            bounds = [F.col(self.features[b.feature]) > b.cut if b.above else F.col(self.features[b.feature]) <= b.cut for b in sorted(rule, key=lambda b: (b.feature, b.cut, b.above))]
            both = bounds[0]
            for x in bounds[1:]:
                both = both & x
            total = total + F.when(both, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy."""
        return 1 / (1 + np.exp(-(self.offset + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))


def fit(x: np.ndarray, y: np.ndarray, features: list[str]) -> Ensemble:
    """y: labels from 0 to 1."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(features, float(np.log(share / (1 - share))), [])
    rules = tree_rules(x, y)
    if not rules:
        return Ensemble(features, float(np.log(y.mean() / (1 - y.mean()))), [])
    offset, weights = lasso(np.stack([holds(r, x) for r in rules], 1).astype(float), y)
    return Ensemble(features, offset, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-9])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Fit to `labels` (doc_id, label). What reaches the driver are the statistics of `sample` documents at most."""
    clean = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("label").alias("label"))
    some = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # `some` has at most `sample` rows; repeated documents of one id are cut to as many.
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(some), "doc_id")
    got = measured(rows.select("doc_id", "text", "label").select(F.struct("doc_id", "label").alias("doc_id"), "text")).select("doc_id.*", *[x for x in FEATURES])
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(2 * sample).toPandas()
    return fit(got[FEATURES].to_numpy(float), got["label"].to_numpy(float), FEATURES)


FEATURES = ["n_words", "word_length", "symbols", "bars", "shouts", "stops", "digits", "capitals", "letters", "distinct", "twice", "dup_lines", "line_words"]


def scored(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, score."""
    return measured(docs).select("doc_id", model.column().alias("score"))
