"""Quality classification by a sparse rule ensemble compiled into Spark column expressions.

Text statistics are DataFrame expressions. Trees boosted on a bounded labelled sample are cut into conjunctive rules
(their paths), a lasso logistic regression weighs the rules, and those with weights become one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import crc_of_id, drawn, text_or_empty

STATISTICS = ["log_chars", "upper", "digits", "symbols", "stops", "distinct_words", "word_length", "longest_word", "distinct_lines", "words_per_line", "one_char_words", "repeats"]


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with a struct ``_stats`` of the statistics of each whole text; null counts as empty."""
    t = text_or_empty(text_col)
    per = lambda x, n: x / F.greatest(n, F.lit(1))
    base = df.withColumn("_words", F.filter(F.split(t, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).withColumn("_lines", F.split(t, "\n", -1))
    chars, words, lines = F.char_length(t), F.size("_words"), F.size("_lines")
    lengths = F.transform("_words", lambda w: F.char_length(w))
    stats = {
        "log_chars": F.log1p(chars.cast("double")),
        "upper": per(F.regexp_count(t, F.lit("[A-Z]")), chars),
        "digits": per(F.regexp_count(t, F.lit("[0-9]")), chars),
        "symbols": per(F.regexp_count(t, F.lit(r"[!-&(-+/:-@\[-`{-~]")), chars),
        "stops": per(F.regexp_count(t, F.lit(r"[.,]")), words),
        "distinct_words": per(F.size(F.array_distinct("_words")), words),
        "word_length": per(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), words),
        "longest_word": F.coalesce(F.array_max(lengths), F.lit(0)),
        "distinct_lines": per(F.size(F.array_distinct("_lines")), lines),
        "words_per_line": per(words, lines),
        "one_char_words": per(F.size(F.filter(lengths, lambda n: n == 1)), words),
        "repeats": per(F.size(F.filter(F.zip_with(F.slice("_words", 2, F.greatest(words - 1, F.lit(0))), "_words", lambda a, b: a == b), lambda x: x)), words),
    }
    return base.withColumn("_stats", F.struct(*[stats[s].cast("double").alias(s) for s in STATISTICS])).drop("_words", "_lines")


@dataclass(frozen=True)
class Condition:
    """statistic <= threshold, or statistic > threshold."""

    statistic: int
    threshold: float
    below: bool


@dataclass
class RuleModel:
    """score = sigmoid(intercept + sum of the weights of the rules that hold)."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self, stats: str = "_stats") -> Column:
        def holds(rule: tuple[Condition, ...]) -> Column:
            parts = [F.col(f"{stats}.{STATISTICS[c.statistic]}") <= c.threshold if c.below else F.col(f"{stats}.{STATISTICS[c.statistic]}") > c.threshold for c in rule]
            return reduce(lambda a, b: a & b, parts)

        total = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(float(w))).otherwise(F.lit(0.0)) for r, w in self.rules], F.lit(float(self.intercept)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, residual: np.ndarray, depth: int, least: int, path: tuple[Condition, ...], rules: set) -> np.ndarray:
    """Fit a regression tree on residuals by least squares over quantile cuts; adds its paths; returns the fit."""
    if depth:
        best = (1e-9, None)
        n, total = len(residual), residual.sum()
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, c = x[order, k], np.cumsum(residual[order])
            at = np.unique(np.linspace(least, n - least, 33).astype(int)) if n >= 2 * least else []
            for i in at:
                if 0 < i < n and v[i - 1] < v[i]:
                    gain = c[i - 1] ** 2 / i + (total - c[i - 1]) ** 2 / (n - i) - total**2 / n
                    if gain > best[0]:
                        best = (gain, (k, float((v[i - 1] + v[i]) / 2)))
        if best[1]:
            k, cut = best[1]
            low = x[:, k] <= cut
            out = np.empty(n)
            for side, below in ((low, True), (~low, False)):
                rule = (*path, Condition(k, cut, below))
                rules.add(rule)
                out[side] = _tree(x[side], residual[side], depth - 1, least, rule, rules)
            return out
    return np.full(len(residual), residual.mean())


def _holds(rules: list[tuple[Condition, ...]], x: np.ndarray) -> np.ndarray:
    return np.stack([np.logical_and.reduce([x[:, c.statistic] <= c.threshold if c.below else x[:, c.statistic] > c.threshold for c in r]) for r in rules], axis=1).astype(float)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.4, penalty: float = 0.002, steps: int = 400) -> RuleModel:
    """Boosted trees give the rules, proximal gradient descent (with momentum) their lasso logistic weights.

    With one class, or no row at all, the model is that class's rate alone (one half for no row), smoothed.
    """
    rate0 = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(rate0 / (1 - rate0)))
    if len(y) < 20 or y.min() == y.max():
        return RuleModel(start, [])
    rules: set[tuple[Condition, ...]] = set()
    total = np.full(len(y), start)
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        total += rate * np.clip(_tree(x, y - p, depth, least, (), rules) / max(1e-3, float((p * (1 - p)).mean())), -4, 4)
    ordered = sorted(rules, key=repr)
    if not ordered:
        return RuleModel(start, [])
    h = _holds(ordered, x)
    columns, where = np.unique(h, axis=1, return_index=True)  # rules that hold for the same rows are one
    where = where[(h[:, where].mean(axis=0) > 0) & (h[:, where].mean(axis=0) < 1)]
    ordered, h = [ordered[i] for i in where], h[:, where]
    mean = h.mean(axis=0)
    centred = h - mean
    step = 4 * len(y) / max(1e-9, np.linalg.norm(centred, 2) ** 2)
    w, b, v, t = np.zeros(h.shape[1]), start, np.zeros(h.shape[1]), 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(centred @ v + b))) - y
        b -= 4 * 0.25 * float(g.mean())
        new = v - step * (centred.T @ g) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b - mean @ w), [(ordered[i], float(w[i])) for i in kept])


def train_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000) -> RuleModel:
    """Fit on ``sample_rows`` labelled documents (all, if there are fewer) with crc32 mod 5 not 0, drawn by a hash of the id.

    Several labels of one id count as their mean, rounded, and null labels and ids are passed over. Where rows repeat an
    id, the first text is learned from. The sample's statistics (numbers, no texts) go to the driver.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & (crc_of_id(id_col) % 5 != 0))
    one_each = usable.groupBy(F.col(id_col).alias("_id")).agg(F.round(F.avg("quality")).alias("_y"))
    # At most sample_rows ids, so this broadcast has a proven size.
    chosen = F.broadcast(drawn(one_each, sample_rows, "_id", tag="quality sample"))
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))
    found = with_statistics(joined, "_text").select("_y", "_stats.*").toPandas()
    return fit_rules(found[STATISTICS].to_numpy(float), found["_y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1), which replaces a column of that name; all other columns stay as they are.

    Null and empty texts get the score of the empty text; no row is dropped, repeated rows are scored each.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    scored = with_statistics(packed, "_text").select("_row", model.score().alias("_score"))
    return scored.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != score_col], F.col("_score").alias(score_col))
