"""Counterfactual-regularised toxicity classifier.

A sparse logistic model on hashed words and word beginnings of whole texts. For labelled texts that
name a group, copies are made in which group terms are swapped for others, and differences between
the score of a text and of its copy are penalised along with the loss: the model cannot lean on
the terms themselves, which lowers false positives on neutral mentions.

The fit sees a bounded sample of labelled rows (`SAMPLE`) in one task; all other work is map-only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.frames import held_out, labelled_sample, staged
from tidemark.llm.words import AS_IS, NOT_ALNUM, find_words, mix, range_hashes, slices

SAMPLE = 12_000
BITS = 20
STARTS = (4, 5, 6, 7, 8)
LASSO, SWAP_PENALTY, ROUNDS = 6e-4, 1.0, 200
# Terms that name groups, in sets whose members can replace each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf"),
    ("mexican", "american", "chinese", "indian", "russian", "arab", "german", "french"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)


def features(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) pairs, each once; with `only`, those features alone.

    Features are a lower-cased word and its first 4 to 8 bytes, hashed to `BITS` bits.
    """
    words = find_words(pc.utf8_lower(texts), gap=NOT_ALNUM, fold=AS_IS)
    number = np.repeat(np.arange(len(texts)), np.diff(words.first))
    found, mask = [], np.uint64((1 << BITS) - 1)
    size = words.end - words.start
    for k in (0, *STARTS):
        if k == 0:
            hashes, at = words.hash, number
        else:
            long = size >= k
            hashes, at = range_hashes(words.data, words.start[long], words.start[long] + k), number[long]
        hashed = (mix(hashes + np.uint64(k)) & mask).astype(np.int64)
        if only is not None:
            kept = only[hashed]
            hashed, at = hashed[kept], at[kept]
        found.append((at << BITS) | hashed)
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


class Swapper:
    """Texts with each group term replaced by the next one of its set."""

    def __init__(self, sets: tuple[tuple[str, ...], ...]):
        self.follow = {t: group[(i + 1) % len(group)] for group in sets for i, t in enumerate(group)}
        self.pattern = re.compile(r"(?i)\b(?:" + "|".join(sorted(self.follow, key=len, reverse=True)) + r")\b") if self.follow else None

    def __call__(self, text: str | None) -> str | None:
        """The swapped text, or None where there is nothing to swap."""
        if not text or not self.pattern or not self.pattern.search(text):
            return None
        return self.pattern.sub(lambda m: self.follow[m.group().lower()], text)


def _rows(batches: Iterator[pa.RecordBatch], sets) -> Iterator[pa.RecordBatch]:
    """(own, plus, minus, y): the features of a text, and of a text with swapped terms those that only it or only its copy has."""
    swap, kind = Swapper(sets), pa.list_(pa.int32())
    for batch in slices(batches, "text"):
        n = batch.num_rows
        texts = batch.column("text")
        swapped = [swap(t) for t in texts.to_pylist()]
        number, feature = features(texts.cast(pa.large_string()).fill_null(""))
        own = np.split(feature.astype(np.int32), np.searchsorted(number, np.arange(1, n)))
        plus, minus = [None] * n, [None] * n
        some = [i for i in range(n) if swapped[i] is not None]
        if some:
            number, feature = features(pa.array([swapped[i] for i in some], pa.large_string()))
            for i, other in zip(some, np.split(feature.astype(np.int32), np.searchsorted(number, np.arange(1, len(some)))), strict=True):
                plus[i], minus[i] = np.setdiff1d(own[i], other, True), np.setdiff1d(other, own[i], True)
        arrays = [pa.array(own, kind), pa.array(plus, kind), pa.array(minus, kind), batch.column("y").cast(pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=["own", "plus", "minus", "y"])


class Sparse:
    """Rows of features as one array of columns and the borders of rows; products go block by block."""

    def __init__(self, columns: np.ndarray, sizes: np.ndarray, width: int, block: int = 1 << 18):
        self.columns, self.borders, self.width = columns, np.concatenate([[0], np.cumsum(sizes)]), width
        ends = np.searchsorted(self.borders, np.arange(block, self.borders[-1] + block, block), "left")
        self.cuts = np.unique(np.concatenate([[0], np.minimum(ends, len(sizes)), [len(sizes)]]))

    def _blocks(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for i, j in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            yield i, j, self.columns[self.borders[i] : self.borders[j]], np.diff(self.borders[i : j + 1])

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Per row the sum of its features' weights."""
        out = np.zeros(len(self.borders) - 1)
        for i, j, columns, sizes in self._blocks():
            out[i:j] = np.bincount(np.repeat(np.arange(j - i), sizes), weights=weights[columns], minlength=j - i)
        return out

    def back(self, values: np.ndarray) -> np.ndarray:
        """Per feature the sum of its rows' values."""
        out = np.zeros(self.width)
        for i, j, columns, sizes in self._blocks():
            out += np.bincount(columns, weights=np.repeat(values[i:j], sizes), minlength=self.width)
        return out


def fit(own: Sparse, plus: Sparse, minus: Sparse, y: np.ndarray, lasso: float, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights of all features and the bias: proximal gradient steps with momentum.

    `plus` and `minus` have a row per text with a swapped copy: what only the text or only the copy has.
    """
    n, width, pairs = len(y), own.width, len(plus.borders) - 1
    target = y.astype(float)
    base = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    # toxic rows are few; they count more, so that 0.5 lies between the two kinds
    heft = np.where(target > 0, np.sqrt((1 - base) / base), 1.0)
    bias = float(np.log(base / (1 - base)))
    weights = np.zeros(width)

    def swaps(w: np.ndarray) -> np.ndarray | float:
        """Slope of the mean squared score change under swaps, as far as `w` causes it."""
        if not pairs:
            return 0.0
        gap = plus.times(w) - minus.times(w)
        return 2 * penalty * (plus.back(gap) - minus.back(gap)) / pairs

    # rare features may move further; all steps are then scaled by the steepest direction, so that none overshoots
    frequency = own.back(np.ones(n)) / n
    step = 1.0 / (np.sqrt(frequency * frequency.max()) + 1e-3) if width else weights
    v = np.sqrt(step)
    for _ in range(12 if width else 0):
        v /= np.linalg.norm(v)
        w = np.sqrt(step) * v
        v = np.sqrt(step) * (0.25 * own.back(heft * own.times(w)) / n + swaps(w))
    step = step / (1.1 * np.linalg.norm(v) + 1e-12) if width else step
    ahead, previous = weights.copy(), weights
    for k in range(rounds):
        error = heft * (1 / (1 + np.exp(-np.clip(bias + own.times(ahead), -30, 30))) - target)
        slope = own.back(error) / n + swaps(ahead)
        bias -= float(error.mean() / heft.max())
        moved = ahead - step * slope
        weights = np.sign(moved) * np.maximum(np.abs(moved) - step * lasso, 0)
        ahead = weights + min(0.9, k / (k + 3)) * (weights - previous)
        previous = weights
    return weights, bias


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lasso: float = LASSO, penalty: float = SWAP_PENALTY, rounds: int = ROUNDS, sets=IDENTITY_TERMS
) -> tuple[np.ndarray, np.ndarray, float]:
    """The model of at most `sample` labelled documents; without any, one that scores 0.

    Features of fewer than three sampled documents are left out before rows reach the fit; the list of
    the others is as long as there are hash values at most.
    """
    rows = staged(labelled_sample(docs, labels, "toxic", sample).mapInArrow(lambda b: _rows(b, sets), "own array<int>, plus array<int>, minus array<int>, y int"), "toxic-features")
    names = rows.select(F.explode("own").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where("n >= 3").select("f").toArrow().column("f").to_numpy()
    names = np.sort(names)

    def placed(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known features and how many each row has."""
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        at = np.minimum(np.searchsorted(names, values), max(0, len(names) - 1))
        known = names[at] == values if len(names) else np.zeros(len(values), bool)
        upto = np.concatenate([[0], np.cumsum(known)])
        return at[known].astype(np.int32), np.diff(upto[ends])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {c: ([np.zeros(0, np.int32)], [np.zeros(0, np.int64)]) for c in ("own", "plus", "minus")}
        y = [np.zeros(0, np.int32)]
        for batch in batches:
            y.append(batch.column("y").to_numpy())
            for name, (columns, sizes) in parts.items():
                lists = batch.column(name)
                lists = lists if name == "own" else lists.filter(lists.is_valid())
                for to, found in zip((columns, sizes), placed(lists), strict=True):
                    to.append(found)
        y = np.concatenate(y)
        if len(y):
            sparse = {name: Sparse(np.concatenate(columns), np.concatenate(sizes), len(names)) for name, (columns, sizes) in parts.items()}
            parts.clear()
            weights, bias = fit(**sparse, y=y, lasso=lasso, penalty=penalty, rounds=rounds)
            used = np.flatnonzero(weights)
            yield pa.RecordBatch.from_pydict({"names": [names[used].astype(np.int64)], "weights": [weights[used]], "bias": [bias]})

    found = rows.repartition(1).mapInArrow(one, "names array<long>, weights array<double>, bias double").collect()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    return np.array(found[0]["names"], np.int64), np.array(found[0]["weights"]), found[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """`docs` with score and predicted added (columns of these names are replaced).

    A null, empty or blank text has the score of a text without evidence. Rows are scored alone.
    """
    names, weights, bias = model
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast((names, weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, bias = shared.value
        table, known = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        table[names], known[names] = weights, True
        for batch in slices(batches, "text"):
            number, feature = features(batch.column("text").cast(pa.large_string()).fill_null(""), known)
            total = bias + np.bincount(number, weights=table[feature], minlength=batch.num_rows)
            values = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            values = np.where(np.isneginf(total), 0.0, values)
            arrays = [*(batch.column(c) for c in columns), pa.array(values), pa.array((values >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(columns).mapInArrow(run, f"{kinds}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs` (doc_id, text); null ids are not held out."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, **options))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
