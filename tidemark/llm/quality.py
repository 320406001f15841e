"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow boosted trees are grown on the statistics of a bounded sample of labelled rows; every path from a root to a
node becomes a conjunctive rule; an L1-penalised logistic regression keeps few of the rules; these are compiled to one
Spark column expression, so scoring is a projection without a shuffle or Python.

Defined results: null and empty texts have statistics of zero and get the score these lead to; rows without a label,
or with a null one, teach nothing; without labels of both kinds the score is the labels' share of ones (0.5 without
labels); an empty table gives an empty result. Columns beyond the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import tokens

#: Labelled rows that are fitted at most, those of smallest hash.
SAMPLE_ROWS = 8_000
FOLDS = 5


STATISTICS = ("upper", "digit", "symbol", "exclaim", "distinct", "again", "word_chars", "line_words", "line_again", "size")


def with_statistics(df: DataFrame) -> DataFrame:
    """df with the numbers that a rule may use, columns _q_ and the names of STATISTICS; all of the whole text, all zero for an empty one.

    Words and lines are columns of their own first, and the numbers leave through a generator: neither filters nor rules on
    them are pushed below it, where each would make its numbers anew, so every number is made once a row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumns({"_q_words": tokens(text), "_q_lines": F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")})
    chars, found, lines = F.length(text), F.col("_q_words"), F.col("_q_lines")
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    of = lambda pattern: share(chars - F.length(F.regexp_replace(text, pattern, "")), chars)
    again = F.size(F.filter(found, lambda x, i: (i > 0) & (x == F.get(found, i - 1))))
    values = (
        of(r"\p{Lu}+"),
        of(r"[0-9]+"),
        of(r"[^\p{L}\p{N}\s.,;:!?'\"()-]+"),
        of(r"!+"),
        share(F.size(F.array_distinct(found)), F.size(found)),
        share(again, F.size(found)),
        share(chars, F.size(found)),
        share(F.size(found), F.size(lines)),
        share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        F.log1p(F.size(found).cast("double")),
    )
    df = df.withColumn("_q_all", F.struct(*(v.cast("double").alias(f"_q_{n}") for n, v in zip(STATISTICS, values, strict=True))))
    return df.select("*", F.inline_outer(F.array("_q_all"))).drop("_q_words", "_q_lines", "_q_all")


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold), all of which hold


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        """Over the columns of with_statistics."""
        total = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            holds = F.lit(True)
            for name, above, limit in rule:
                holds = holds & (F.col(f"_q_{name}") > limit if above else F.col(f"_q_{name}") <= limit)
            total = total + F.when(holds, float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 24, depth: int = 3, cuts: int = 32, least: int = 10) -> list[Rule]:
    """The paths of boosted regression trees on the logistic residual."""
    thresholds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, cuts + 2)[1:-1])) for j in range(x.shape[1])]
    margin, rules = np.zeros(len(y)), {}
    for _ in range(trees):
        residual, step = y - 1 / (1 + np.exp(-margin)), np.zeros(len(y))
        open_nodes: list[tuple[np.ndarray, Rule]] = [(np.ones(len(y), bool), ())]
        while open_nodes:
            inside, path = open_nodes.pop()
            step[inside] = residual[inside].mean()
            if len(path) == depth or inside.sum() < 2 * least:
                continue
            best = (1e-9, None)
            r, total, count = residual[inside], residual[inside].sum(), inside.sum()
            for j, limits in enumerate(thresholds):
                high = x[inside, j][:, None] > limits[None, :]
                n = high.sum(0)
                s = r @ high
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((n >= least) & (count - n >= least), s**2 / n + (total - s) ** 2 / (count - n) - total**2 / count, 0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (j, float(limits[gain.argmax()])))
            if best[1]:
                j, limit = best[1]
                for above in (True, False):
                    part = inside & ((x[:, j] > limit) == above)
                    rule = (*path, (names[j], above, limit))
                    rules[tuple(sorted(rule))] = None
                    open_nodes.append((part, rule))
        margin += 2.0 * step
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is free."""
    a = np.hstack([np.ones((len(y), 1)), z])
    rate = 4 * len(y) / (np.linalg.norm(a, 2) ** 2 + 1e-9)
    w, ahead, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    for _ in range(rounds):
        new = ahead - rate * (a.T @ (1 / (1 + np.exp(-a @ ahead)) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        w, ahead = new, new + (before - 1) / t * (new - w)
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 5e-4) -> RuleModel:
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = grow_rules(x, y, names)
    at = {n: j for j, n in enumerate(names)}
    z = np.array([np.all([(x[:, at[n]] > limit) == above for n, above, limit in rule], axis=0) for rule in rules], float).T.reshape(len(y), len(rules))
    intercept, weights = lasso_logistic(z, y, penalty)
    return RuleModel(intercept, tuple((float(w), r) for w, r in zip(weights, rules, strict=True) if w))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fitted on the statistics of at most sample_rows labelled rows outside fold 0, which are all that reaches the driver.

    A label's document is the row of its doc_id whose text hashes smallest, so repeated ids add no rows and the model is
    the same each time.
    """
    chosen = labels.select("doc_id", F.col("quality").cast("double").alias("y")).filter(F.col("y").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample_rows)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = rows.select("doc_id", "y", F.struct(F.xxhash64("text").alias("hash"), *(F.col(f"_q_{n}").alias(n) for n in STATISTICS)).alias("s"))
    rows = rows.groupBy("doc_id", "y").agg(F.min("s").alias("s")).select("y", *(F.col(f"s.{n}").alias(n) for n in STATISTICS))
    found = rows.toPandas().sort_values(["y", *STATISTICS])  # the same order each time, so the same model
    return fit_rules(found[list(STATISTICS)].to_numpy(float), found["y"].to_numpy(float), list(STATISTICS))


def score_quality(docs: DataFrame, model: RuleModel, cut: float = 0.3) -> DataFrame:
    """docs with score and predicted, which take the place of columns of these names."""
    scored = with_statistics(docs.drop("score", "predicted")).withColumn("score", model.score())
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int")).drop(*(f"_q_{n}" for n in STATISTICS))


def classify(docs: DataFrame, labels: DataFrame, cut: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = fit_quality(docs, labels, sample_rows)
    scored = score_quality(docs.select("doc_id", "text"), model, cut)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
