"""Benchmark decontamination with a generalised suffix automaton of the benchmark items.

The automaton is built over item words and sent to the tasks; documents stream through it and the
length of the longest item substring that ends at each word is tracked. Where that length reaches
the window, the last words are hit. A benchmark beyond `words_per_block` words is cut into blocks
of items, one automaton each, so what a task holds has a bound at any benchmark size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType, StructType

from tidemark.llm.frames import set_aside
from tidemark.llm.words import NOT_ALNUM, chain, find_words, slices, text_bytes

WORDS_PER_BLOCK = 200_000
SEED = 3
ADDED = ("n_words", "spans", "items", "n_hit", "n_items", "contaminated")


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[int, list[str]] = {}  # ends of items shorter than the window
        ends: dict[int, set[str]] = {}
        short = []
        for item, words in items:
            state = 0
            for word in words:
                state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
                ends.setdefault(state, set()).add(item)
            if 0 < len(words) < window:
                short.append((item, words))
        # an item holds a window if one of its ends lies below the window's state in the tree of links
        found: dict[int, set[str]] = {}
        for state, names in ends.items():
            at = state
            while at > 0 and self.length[self.link[at]] >= window:
                at = self.link[at]
            if self.length[at] >= window:
                found.setdefault(at, set()).update(names)
        self.items = {state: sorted(names) for state, names in found.items()}
        for item, words in short:
            state = 0
            for word in words:
                state = self.next[state][self.vocabulary[word]]
            self.whole.setdefault(state, []).append(item)
        self.shortest = min([window, *(len(words) for _, words in short)])

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: int, to: int) -> int:
        clone = self._new(self.length[state] + 1, dict(self.next[to]), self.link[to])
        self.link[to] = clone
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        to = self.next[last].get(word)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
        new, state = self._new(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            to = self.next[state][word]
            self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, word, to)
        return new

    def stream(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first, end, items) of each window occurrence, by its end."""
        state, matched = 0, 0
        for i, word in enumerate(words):
            number = self.vocabulary.get(word)
            if number is None:
                state, matched = 0, 0
                continue
            while state and number not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if number in self.next[state]:
                state, matched = self.next[state][number], matched + 1
            at = state
            if matched >= self.window:
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                yield i + 1 - self.window, i + 1, self.items[at]
                at = self.link[at]
            while at > 0 and self.whole:
                if at in self.whole and self.length[at] <= matched:
                    yield i + 1 - self.length[at], i + 1, self.whole[at]
                at = self.link[at]


def item_words(texts: pa.Array) -> list[list[bytes]]:
    found = find_words(texts, gap=NOT_ALNUM, hashes=False)
    data, start, end = found.data.tobytes(), found.start.tolist(), found.end.tolist()
    words = [data[i:j] for i, j in zip(start, end, strict=True)]
    return [words[i:j] for i, j in zip(found.first[:-1], found.first[1:], strict=True)]


def blocks(benchmark: DataFrame, words_per_block: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, as lists of at most `words_per_block` words (one longer item stays whole)."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null")
    for row in rows.distinct().toLocalIterator():
        (words,) = item_words(pa.array([row["t"]]))
        if words:
            if held and size + len(words) > words_per_block:
                yield held
                held, size = [], 0
            held.append((row["i"], words))
            size += len(words)
    if held or not size:
        yield held


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [tuple(x) for x in out]


def _candidates(hashes: np.ndarray, seeds: np.ndarray, seed: int, shortest: int) -> list[tuple[int, int]]:
    """Word ranges outside of which no window can lie: all their `seed`-word runs occur in items."""
    runs = chain(hashes, seed)
    if len(runs) == 0 or len(seeds) == 0:
        return []
    at = np.minimum(np.searchsorted(seeds, runs), len(seeds) - 1)
    known = np.concatenate([[False], seeds[at] == runs, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    return [(i, j + seed - 1) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if j - i + seed - 1 >= shortest]


def _scan(docs: DataFrame, items: list[tuple[str, list[bytes]]], window: int, columns: list[str]) -> DataFrame:
    automaton = Automaton(items, window)
    seed = max(1, min(SEED, automaton.shortest))
    seeds = [np.zeros(0, np.uint64)]
    for _, words in items:
        seeds.append(chain(find_words(pa.array([b" ".join(words)]).cast(pa.string()), gap=NOT_ALNUM).hash, seed))
    shared = docs.sparkSession.sparkContext.broadcast((automaton, np.unique(np.concatenate(seeds))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = shared.value
        for batch in slices(batches, "text"):
            found = find_words(batch.column("text"), gap=NOT_ALNUM)
            spans, names = [], []
            for i in range(batch.num_rows):
                low, high = int(found.first[i]), int(found.first[i + 1])
                hits, met = [], set()
                for a, b in _candidates(found.hash[low:high], known, seed, automaton.shortest):
                    starts, ends = found.start[low + a : low + b].tolist(), found.end[low + a : low + b].tolist()
                    words = [found.data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
                    for first, end, items in automaton.stream(words):
                        hits.append((a + first, a + end))
                        met.update(items)
                spans.append([{"first": s, "end": e} for s, e in _merge(hits)])
                names.append(sorted(met))
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            counts = pa.array(np.diff(found.first), pa.int64())
            arrays = [*(batch.column(c) for c in columns), counts, pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "_n", "_spans", "_items"])

    added = StructType.fromDDL("_n bigint, _spans array<struct<first:bigint,end:bigint>>, _items array<string>")
    return docs.mapInArrow(run, StructType([docs.schema[c] for c in columns] + added.fields))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    coverage: int = 5,
    words_per_block: int = WORDS_PER_BLOCK,
    with_text: bool = True,
) -> DataFrame:
    """`docs` (without text where not `with_text`) with n_words, spans of hit words, items, n_hit and contaminated added.

    A window is `window` consecutive words of an item, or a shorter item whole. `contaminated`:
    some word is hit and hit words make up at least `coverage` percent. Null and blank texts have no
    words; null or wordless items are skipped; repeated items and rows count once and stay. Columns
    of `docs` named like the added ones are replaced. Map-only: one pass per block of the benchmark.
    """
    out, own = set_aside(docs.drop(*ADDED), ("text",))
    own = [to for to, c in zip(own, out.columns, strict=True) if with_text or c != "text"]
    cut = blocks(benchmark, words_per_block)
    items, k = next(cut), 0
    while items is not None:
        following = next(cut, None)
        columns = [c for c in out.columns if with_text or following is not None or c != "text"]
        out = _scan(out, items, window, columns)
        if k:
            out = out.withColumn("spans", F.concat("spans", "_spans")).withColumn("items", F.array_union("items", "_items")).drop("_n", "_spans", "_items")
        else:
            out = out.withColumnsRenamed({"_n": "n_words", "_spans": "spans", "_items": "items"})
        items, k = following, k + 1
    if k > 1:
        out = out.withColumn("spans", _merged(F.array_sort("spans")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    out = out.withColumns({"items": F.array_sort("items"), "n_hit": hit, "n_items": F.size("items").cast("long")})
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * coverage))
    return out.select(*own, *ADDED)


def _merged(spans):
    """Sorted spans with overlapping and touching ones joined."""

    def add(done, span):
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1),
            F.array(F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))),
        )
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= span["first"]), joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, F.expr("cast(array() as array<struct<first:bigint,end:bigint>>)"), add)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 5, span_words: int = 0) -> DataFrame:
    """`docs` without contaminated documents; of the others, hit spans of over `span_words` words are cut from the text.

    By default that is every hit span: a window, what touches it, or a shorter item whole. Columns
    are those of `docs`; an integer n_chars follows the text where it was cut. What a cut brings
    together is not searched again. Nulls, blanks and repeats as in `contamination`.
    """
    rows, own = set_aside(docs, ("text", "n_chars"))
    judged = contamination(rows, benchmark, window, coverage).where(~F.col("contaminated"))
    judged = judged.withColumn("_cut", F.filter("spans", lambda s: s["end"] - s["first"] > span_words))
    columns = rows.columns
    sized = "n_chars" in columns and isinstance(rows.schema["n_chars"].dataType, IntegralType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = find_words(batch.column("text"), gap=NOT_ALNUM, hashes=False)
            texts = batch.column("text").to_pylist()
            chars = batch.column("n_chars").to_pylist() if sized else []
            _, borders = text_bytes(batch.column("text"))
            for i, spans in enumerate(batch.column("_cut").to_pylist()):
                if spans:
                    raw, base = texts[i].encode(), found.first[i]
                    at, left = 0, []
                    for s in spans:
                        left.append(raw[at : found.start[base + s["first"]] - borders[i]])
                        at = found.end[base + s["end"] - 1] - borders[i]
                    texts[i] = b"".join([*left, raw[at:]]).decode()
                    if sized:
                        chars[i] = len(texts[i])
            changed = {"text": texts} | ({"n_chars": chars} if sized else {})
            arrays = [pa.array(changed[c], batch.column(c).type) if c in changed else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return judged.select(*columns, "_cut").mapInArrow(cut, rows.schema).select(*own)
