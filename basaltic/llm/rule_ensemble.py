"""Quality classifier: a sparse rule ensemble.

Shallow trees are grown on statistics of labelled texts, every path from a root is a rule (a conjunction of thresholds),
and a logistic model with lasso weights keeps few of them. The kept rules are compiled to Spark column expressions, so
scoring is one narrow pass without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltic.llm.line_rules import words_of

#: Labelled rows that a model is fitted on at most; those with the smallest hashes of their ids.
SAMPLE = 8_000
TREES, DEPTH, LEAF, CUTS = 24, 3, 20, 24


def statistics(docs: DataFrame) -> DataFrame:
    """The frame with the column `stats`, a struct of doubles computed from the whole text alone; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.select(*kept, words_of(text).alias("_words"), text.alias("_text"))
    count = lambda pattern: F.regexp_count("_text", F.lit(pattern)).cast("double")
    raw = once.select(
        *kept,
        F.size("_words").cast("double").alias("_n"),
        F.size(F.array_distinct("_words")).cast("double").alias("_u"),
        F.length(F.array_join("_words", "")).cast("double").alias("_chars"),
        count("[#*$%&|<>{}~^@\\\\]").alias("_symbols"),
        count(r"[\p{Lu}]+").alias("_caps"),
        count(r"\p{Lu}{2}").alias("_shouts"),
        count("[0-9]").alias("_digits"),
        count("[.!?;:,]").alias("_stops"),
        count("[!?]{2}").alias("_bangs"),
        count("\n").alias("_lines"),
    )
    n, chars = F.greatest("_n", F.lit(1.0)), F.greatest("_chars", F.lit(1.0))
    stats = {
        "log_words": F.log1p("_n"),
        "word_length": F.col("_chars") / n,
        "distinct": F.col("_u") / n,
        "distinct_log": F.log1p("_u") / F.log1p(n),
        "symbols": F.col("_symbols") / n,
        "caps": F.col("_caps") / n,
        "shouts": F.col("_shouts") / n,
        "digits": F.col("_digits") / chars,
        "stops": F.col("_stops") / n,
        "bangs": F.col("_bangs") / n,
        "lines": F.col("_lines") / n,
    }
    return raw.select(*kept, F.struct(*(v.alias(k) for k, v in stats.items())).alias("stats"))


STATISTICS = ("log_words", "word_length", "distinct", "distinct_log", "symbols", "caps", "shouts", "digits", "stops", "bangs", "lines")

#: One condition: (statistic, whether it must be at most the threshold, threshold).
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class Model:
    """Bias and weighted rules; the score is the logistic function of their sum."""

    bias: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self, stats: str = "stats") -> Column:
        """The score as a Spark column over a struct of statistics."""
        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            holds = F.lit(True)
            for name, low, at in conditions:
                value = F.col(f"{stats}.{name}")
                holds = holds & (value <= at if low else value > at)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The same on a matrix with the statistics as columns."""
        total = np.full(len(x), self.bias)
        for weight, conditions in self.rules:
            total += weight * holds(x, conditions)
        return 1 / (1 + np.exp(-total))


def holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, low, at in conditions:
        value = x[:, STATISTICS.index(name)]
        out &= value <= at if low else value > at
    return out


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, columns: np.ndarray, depth: int, path: tuple[Condition, ...], out: set) -> None:
    """Adds the paths below one node, split where the weighted Gini impurity falls most."""
    total, ones = weight.sum(), (weight * y).sum()
    if depth == 0 or len(y) < 2 * LEAF or ones in (0, total):
        return
    best = (1e-9, None, None)
    for c in columns:
        cuts = np.unique(np.quantile(x[:, c], np.linspace(0, 1, CUTS + 2)[1:-1]))
        side = np.searchsorted(cuts, x[:, c])  # value <= cuts[k] for side <= k
        n = np.cumsum(np.bincount(side, minlength=len(cuts) + 1))[:-1]
        w = np.cumsum(np.bincount(side, weight, len(cuts) + 1))[:-1]
        w1 = np.cumsum(np.bincount(side, weight * y, len(cuts) + 1))[:-1]
        ok = (n >= LEAF) & (len(y) - n >= LEAF)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = w1**2 / w + (w - w1) ** 2 / w + (ones - w1) ** 2 / (total - w) + (total - w - ones + w1) ** 2 / (total - w) - (ones**2 + (total - ones) ** 2) / total
        gain = np.where(ok, gain, 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], c, float(cuts[k]))
    if best[1] is None:
        return
    below = x[:, best[1]] <= best[2]
    for low, rows in ((True, below), (False, ~below)):
        longer = (*path, (STATISTICS[best[1]], low, best[2]))
        out.add(longer)
        grow(x[rows], y[rows], weight[rows], columns, depth - 1, longer, out)


def tightest(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """A path with one condition for each statistic and side: the strictest."""
    kept: dict[tuple[str, bool], float] = {}
    for name, low, at in path:
        old = kept.get((name, low))
        kept[name, low] = at if old is None else min(old, at) if low else max(old, at)
    return tuple(sorted((name, low, at) for (name, low), at in kept.items()))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic loss with an L1 penalty on all but the bias, by accelerated proximal gradient steps."""
    n, p = z.shape
    rate = y.mean()
    bias, w = float(np.log(rate / (1 - rate))), np.zeros(p)
    ahead_b, ahead_w, t = bias, w.copy(), 1.0
    step = 4.0 / (1 + np.linalg.norm(z, 2) ** 2 / n)
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-(ahead_b + z @ ahead_w))) - y
        new_b = ahead_b - step * gap.mean()
        raw = ahead_w - step * (z.T @ gap) / n
        new_w = np.sign(raw) * np.maximum(np.abs(raw) - step * penalty, 0)
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead_b = new_b + (old - 1) / t * (new_b - bias)
        ahead_w = new_w + (old - 1) / t * (new_w - w)
        bias, w = new_b, new_w
    return bias, w


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, seed: int = 7) -> Model:
    """A model from statistics and 0/1 labels; with few labels or one kind of label, a smoothed rate without rules."""
    n, ones = len(y), float(y.sum())
    rate = (ones + 1) / (n + 2)
    plain = Model(float(np.log(rate / (1 - rate))), ())
    if not 0 < ones < n:
        return plain
    rng, paths = np.random.default_rng(seed), set()
    for _ in range(TREES):
        rows = rng.choice(n, n)
        columns = rng.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]
        even = np.where(y[rows] == 1, 0.5 / ones, 0.5 / (n - ones))  # both kinds weigh the same in a tree
        grow(x[rows], y[rows], even, columns, DEPTH, (), paths)
    rules = sorted({tightest(p) for p in paths})
    if not rules:  # too few rows for any split
        return plain
    z = np.array([holds(x, r) for r in rules], float).T
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold of the same rows are one
    rules, z = [rules[i] for i in sorted(first)], z[:, sorted(first)]
    bias, w = lasso(z, y.astype(float), penalty)
    return Model(bias, tuple((float(a), r) for a, r in zip(w, rules) if abs(a) > 1e-6))


def id_check(column: str = "doc_id") -> Column:
    """crc32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` labelled documents outside the held-out fold (id_check mod folds = 0).

    The sample is fixed by a hash of the id; its ids and labels alone are broadcast, a set bounded by `sample`. Null ids and
    labels other than 0 and 1 are left out; of repeated labels the smallest counts, of repeated documents the one whose
    statistics come first, so that the fit does not depend on the order of tasks. Without labels, all documents score alike.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull() & (id_check() % folds != 0))
    chosen = usable.groupBy("doc_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = statistics(found).groupBy("doc_id").agg(F.first("_y").alias("_y"), F.min("stats").alias("stats")).collect()
    x = np.array([[r["stats"][s] for s in STATISTICS] for r in rows], float).reshape(-1, len(STATISTICS))
    order = np.lexsort((*x.T, [r["_y"] for r in rows])) if rows else []
    return fit(x[order] if rows else x, np.array([r["_y"] for r in rows], int)[order] if rows else np.zeros(0, int))


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches the threshold) of every document.

    Every row gets a score, empty and null texts too; repeated rows get the same one. Other columns are left out."""
    out = statistics(docs.select("doc_id", "text")).select("doc_id", (id_check() % folds == 0).alias("held_out"), model.column().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    # whole rows ride along as one struct, so no column's name can clash; the partition's number keeps the filter above the
    # statistics: pushed below, it would spell them out once for each condition
    rows = docs.select("text", F.struct("*").alias("row"))
    with_stats = statistics(rows).withColumn("part", F.spark_partition_id())
    return with_stats.where((model.column() >= threshold) & (F.col("part") >= 0)).select("row.*")
