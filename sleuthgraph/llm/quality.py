"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Shallow trees are boosted on text statistics of a bounded sample of labelled
documents; every path of theirs is a conjunctive rule.  A lasso-penalised
logistic fit keeps few rules, and the score is one Spark expression over the
statistics, so that scoring needs no Python.

Nulls and ties: a null text counts as empty and is scored; unlabelled rows and
labels without a document are ignored in training; repeated rows are scored
each; without labelled rows, or with one class only, the score is the smoothed
share of the label.  Other columns pass through unless their name is one of
the results'.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3
TREES = 24
DEPTH = 3
CUTS = 24
SHRINK = 0.3
PENALTY = 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Raw counts of a text from which the rules' statistics are made."""
    t = F.coalesce(text, F.lit(""))
    words = F.split(F.translate(t, "\n\t\r", "   "), " ")
    lines = F.split(t, "\n")
    return {
        "c_chars": F.length(t), "c_words": F.size(words), "c_distinct": F.size(F.array_distinct(words)),
        "c_lines": F.size(lines), "c_distinct_lines": F.size(F.array_distinct(lines)),
        "c_upper": F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
        "c_marks": F.length(t) - F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s.,]+", "")),
        "c_digits": F.length(t) - F.length(F.regexp_replace(t, r"[0-9]+", "")),
        "c_bars": F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))),
        "c_stops": F.length(t) - F.length(F.translate(t, ".!?", "")),
    }


def features() -> dict[str, Column]:
    """The statistics that rules compare, from the counts."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "log_chars": F.log1p(F.col("c_chars").cast("double")), "word_chars": per("c_chars", "c_words"),
        "line_words": per("c_words", "c_lines"), "distinct": per("c_distinct", "c_words"),
        # distinct words against the square root of all: stays level where longer texts repeat more words
        "richness": F.col("c_distinct") / F.sqrt(F.greatest(F.col("c_words"), F.lit(1))),
        "distinct_lines": per("c_distinct_lines", "c_lines"), "upper": per("c_upper", "c_chars"),
        "marks": per("c_marks", "c_chars"), "digits": per("c_digits", "c_chars"), "bars": per("c_bars", "c_words"),
        "stops": per("c_stops", "c_words"),
    }


NAMES = ["log_chars", "word_chars", "line_words", "distinct", "richness", "distinct_lines", "upper", "marks", "digits", "bars",
         "stops"]


@dataclass(frozen=True)
class Rule:
    """All of (feature, above, bound): ``feature > bound`` where above, else ``feature <= bound``."""

    parts: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, above, bound in self.parts:
            v = x[:, NAMES.index(name)]
            out &= (v > bound) if above else (v <= bound)
        return out

    def column(self) -> Column:
        tests = [(F.col(n) > bound) if above else (F.col(n) <= bound) for n, above, bound in self.parts]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(x, bins, cuts, grad, hess, rows, depth, path, out):
    """One tree by the gain of the logistic loss; collects the rules of all its nodes and returns leaf updates."""
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = [(rows, float(np.clip(g / (h + 1.0), -4, 4)))]
    if depth == 0 or len(rows) < 20:
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        n = len(cuts[f]) + 1
        if n < 2:
            continue
        gs = np.bincount(bins[rows, f], grad[rows], n).cumsum()[:-1]
        hs = np.bincount(bins[rows, f], hess[rows], n).cumsum()[:-1]
        gain = gs ** 2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    _, f, k = best
    if f is None:
        return leaf
    left = bins[rows, f] <= k
    if not left.any() or left.all():
        return leaf
    found = []
    for side, above in ((rows[left], False), (rows[~left], True)):
        here = path + [(NAMES[f], above, float(cuts[f][k]))]
        out.append(Rule(_tight(here)))
        found += _grow(x, bins, cuts, grad, hess, side, depth - 1, here, out)
    return found


def _tight(path) -> tuple:
    """One bound for each feature and side."""
    best: dict[tuple[str, bool], float] = {}
    for name, above, bound in path:
        old = best.get((name, above), bound)
        best[name, above] = max(old, bound) if above else min(old, bound)
    return tuple((n, a, b) for (n, a), b in sorted(best.items()))


def _lasso(d: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the logistic loss with an L1 penalty; the intercept is free."""
    n, p = d.shape
    a = np.hstack([d, np.ones((n, 1))])
    step = 4.0 * n / (np.linalg.norm(a, 2) ** 2 + 1e-9)
    w = v = np.append(np.zeros(p), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    t = 1.0
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / n
        new = v - step * grad
        new[:p] = np.sign(new[:p]) * np.maximum(np.abs(new[:p]) - step * penalty, 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:p], float(w[p])


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Rules and weights from statistics ``x`` (columns as NAMES) and labels ``y``."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return Model((), math.log(share / (1 - share)))
    # bounds lie between two values that occur, so rounding of a statistic cannot flip a rule
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2), method="nearest"))
        cuts.append((values[1:] + values[:-1]) / 2)
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rng, z, found = np.random.default_rng(seed), np.full(len(y), math.log(share / (1 - share))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        grown: list[Rule] = []
        for leaf, update in _grow(x, bins, cuts, y - p, p * (1 - p), rows, DEPTH, [], grown):
            z[leaf] += SHRINK * update
        found += grown
    rules = list(dict.fromkeys(found))
    holds = np.stack([r.holds(x) for r in rules], axis=1) if rules else np.zeros((len(y), 0), dtype=bool)
    keep = [k for k in range(len(rules)) if 0 < holds[:, k].sum() < len(y)]
    w, intercept = _lasso(holds[:, keep].astype(float), y, PENALTY)
    return Model(tuple((rules[k], float(v)) for k, v in zip(keep, w, strict=True) if abs(v) > 1e-4), intercept)


def measured(docs: DataFrame) -> DataFrame:
    """The documents with the statistics beside them."""
    return docs.withColumns(statistics(F.col("text"))).withColumns(features())


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled documents (those with the smallest hash of their id)."""
    labelled = (labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
                .select("doc_id", F.col("quality").alias("_label")).dropDuplicates(["doc_id"])
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # the sample is the small side: at most max_rows rows of two numbers
    rows = measured(docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id")).select("_label", *NAMES).toPandas()
    rows = rows.sort_values(NAMES + ["_label"], kind="stable")
    return train(rows[NAMES].to_numpy(float), rows["_label"].to_numpy(float))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``held_out``, ``score`` (1: good) and ``predicted``."""
    model = fit(docs, labels, max_rows)
    own = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    return (measured(_whole(docs)).select(*own, held_out(F.col("_doc.doc_id")).alias("held_out"), model.column().alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def _whole(docs: DataFrame) -> DataFrame:
    """(_doc, text): all columns in one, so that no name of theirs meets a statistic's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, as they are, whose score reaches the threshold."""
    model = fit(docs, labels, max_rows)
    whole = _whole(docs)
    # the term of no weight keeps the optimiser from moving the test below the statistics, where
    # every rule would count its characters anew
    score = model.column() + F.rand(1) * 0
    return measured(whole).select("_doc", score.alias("_score")).where(F.col("_score") >= threshold).select("_doc.*")
