"""Quality classifier as a sparse ensemble of rules.

Statistics of a text feed small boosted trees; every path from a root to a node is a conjunctive
rule over statistics. A lasso logistic fit gives weights to a few rules, and these compile into one
Spark column expression that scores any frame with the statistics.

The fit sees a bounded sample of labelled rows (`SAMPLE`), on which the statistics, not the texts,
come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import held_out, labelled_sample
from tidemark.llm.line_rules import repeated_words
from tidemark.llm.words import AS_IS, find_words, slices

SAMPLE = 12_000
TREES, DEPTH, LASSO, ROUNDS = 40, 3, 1e-3, 400
THRESHOLD = 0.3
STATISTICS = (
    "n_words", "n_lines", "word_chars", "upper_share", "symbol_share", "digit_share", "point_share", "bar_share", "mark_share",
    "repeat_share", "distinct_share", "same_next_share", "words_per_line", "long_word_share",
)

_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, 0x41:0x5B] = True
_CLASSES[1, list(b"#*$%&<>")] = True
_CLASSES[2, 0x30:0x3A] = True
_CLASSES[3, list(b".,;:")] = True
_CLASSES[4, list(b"|")] = True
_CLASSES[5, list(b"!?")] = True


def statistics(docs: DataFrame) -> DataFrame:
    """`docs` without text, with the statistics of each whole text as doubles; all 0 for no words. Map-only."""
    columns = [c for c in docs.columns if c not in ("text", *STATISTICS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = find_words(batch.column("text"), fold=AS_IS)
            points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            n = np.diff(words.first)
            some = np.maximum(n, 1)
            low = words.start[np.minimum(words.first[:-1], max(0, len(words.start) - 1))] if len(words.start) else np.zeros(len(n), np.int64)
            high = words.end[np.maximum(words.first[1:] - 1, 0)] if len(words.end) else low
            low, high = np.where(n > 0, low, 0), np.where(n > 0, high, 0)
            chars = np.maximum(points[high] - points[low], 1)
            share = [(lambda c: (c[high] - c[low]) / chars)(np.concatenate([[0], np.cumsum(kind[words.data])])) for kind in _CLASSES]
            breaks = np.concatenate([[0], np.cumsum(words.data == 0x0A)])
            lines = np.where(n > 0, breaks[high] - breaks[low] + 1, 0)
            size = points[words.end] - points[words.start]
            sums = lambda x: np.add.reduceat(np.append(x, 0), np.minimum(words.first[:-1], len(x))) * (n > 0)
            repeat, distinct, same = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
            for i in np.flatnonzero(n):
                own = words.hash[words.first[i] : words.first[i + 1]]
                repeat[i], distinct[i], same[i] = repeated_words(own), len(np.unique(own)), (own[1:] == own[:-1]).sum()
            found = [n, lines, sums(size) / some, *share, repeat / some, distinct / some, same / some, n / np.maximum(lines, 1), sums(size > 20) / some]
            arrays = [pa.array(np.asarray(x, float)) for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *arrays], names=[*columns, *STATISTICS])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, kinds + ", ".join(f"{s} double" for s in STATISTICS))


class Condition(NamedTuple):
    statistic: int
    above: bool
    limit: float


Rule = tuple[Condition, ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= (x[:, c.statistic] > c.limit) == c.above
    return out


def _best_split(x: np.ndarray, gradient: np.ndarray, rows: np.ndarray, limits: list[np.ndarray]) -> tuple[float, int, float] | None:
    best, total, n = None, gradient[rows].sum(), len(rows)
    for k, cuts in enumerate(limits):
        if len(cuts) == 0:
            continue
        place = np.searchsorted(cuts, x[rows, k], side="left")
        count = np.cumsum(np.bincount(place, minlength=len(cuts) + 1))[:-1]
        left = np.cumsum(np.bincount(place, weights=gradient[rows], minlength=len(cuts) + 1))[:-1]
        fair = (count >= 5) & (n - count >= 5)
        if not fair.any():
            continue
        gain = np.where(fair, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1), -1)
        i = int(gain.argmax())
        if best is None or gain[i] > best[0]:
            best = (float(gain[i]), k, float(cuts[i]))
    return best if best and best[0] > total**2 / n + 1e-9 else None


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list[Rule]:
    """Paths to all nodes of boosted trees, each tree grown on a random half of the rows."""
    random, rules = np.random.default_rng(seed), {}
    limits = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64), method="lower")) for k in range(x.shape[1])]
    limits = [c[c < x[:, k].max()] for k, c in enumerate(limits)]
    score = np.full(len(x), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-score))
        leaves = [((), np.sort(random.choice(len(x), max(1, len(x) // 2), replace=False)))]
        for _ in range(depth):
            grown = []
            for rule, rows in leaves:
                split = _best_split(x, gradient, rows, limits) if len(rows) >= 10 else None
                if not split:
                    grown.append((rule, rows))
                    continue
                _, k, limit = split
                over = x[rows, k] > limit
                grown += [((*rule, Condition(k, False, limit)), rows[~over]), ((*rule, Condition(k, True, limit)), rows[over])]
            leaves = grown
            rules.update(dict.fromkeys(r for r, _ in leaves if r))
        for rule, rows in leaves:
            if rule and len(rows):
                p = 1 / (1 + np.exp(-score[rows]))
                score += holds(rule, x) * 0.3 * gradient[rows].sum() / ((p * (1 - p)).sum() + 1.0)
    return list(rules)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model with an absolute penalty: accelerated proximal steps."""
    n, k = z.shape
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, weights = float(np.log(base / (1 - base))), np.zeros(k)
    ahead, previous, v = weights.copy(), weights, np.ones(k)
    for _ in range(20):
        v = z.T @ (z @ v) / n
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * np.linalg.norm(z.T @ (z @ v) / n) + 0.25)
    for i in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(bias + z @ ahead, -30, 30))) - y
        moved = ahead - step * (z.T @ error) / n
        weights = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        bias -= float(error.mean())
        ahead = weights + i / (i + 3) * (weights - previous)
        previous = weights
    return weights, bias


class Model(NamedTuple):
    rules: list[Rule]
    weights: list[float]
    bias: float


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO) -> Model:
    """The model of at most `sample` labelled documents. Without any, every score is 1."""
    rows = statistics(labelled_sample(docs, labels, "quality", sample)).toPandas()
    if rows.empty:
        return Model([], [], float("inf"))
    # the order rows arrive in must not matter
    rows = rows.sort_values([*STATISTICS, "y"], ignore_index=True)
    x, y = rows[list(STATISTICS)].to_numpy(float), rows["y"].to_numpy(float)
    rules = tree_rules(x, y, trees, depth)
    marks = np.column_stack([holds(r, x) for r in rules]).astype(np.float32) if rules else np.zeros((len(x), 0), np.float32)
    weights, bias = lasso(marks, y, penalty)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Model([rules[i] for i in used], [float(weights[i]) for i in used], bias)


def compiled(model: Model) -> Column:
    """The score as a column over the statistics."""

    def test(c: Condition) -> Column:
        return F.col(STATISTICS[c.statistic]) > c.limit if c.above else F.col(STATISTICS[c.statistic]) <= c.limit

    total = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        condition = test(rule[0])
        for c in rule[1:]:
            condition = condition & test(c)
        total = total + F.when(condition, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs` (doc_id, text).

    Null, empty and blank texts have statistics 0 and a score like any other. Rows are scored alone.
    """
    score = compiled(train(docs, labels, **options))
    scored = statistics(docs.select("doc_id", "text")).select("doc_id", held_out("doc_id").alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
