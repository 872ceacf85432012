"""Groups of spelling variants: an edit-distance join of a corpus vocabulary by asymmetric q-chunks.

Of two words within one edit the shorter is cut into two disjoint chunks of half its length, and one
edit leaves at least one of them whole. The other word shows its grams of that length with their
places, as far as a chunk can have got there. Chunk and gram meet in a hash join if they are equal and
at most one place apart; pairs that met are then verified.

A chunk that more than `DENSE` words share would make all their pairs. There both sides are joined on
what is left of the word beside the chunk, too: of two rests within one edit, either the shorter is the
longer without one letter, or both agree without the letter at one place. So few words ever meet in
one key that no group grows with the square of its words, and nothing is lost.

Counting reads all texts once, map-side counts come first; all else works on the vocabulary.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import staged
from tidemark.llm.words import LOWER, range_hashes, slices, text_bytes

DENSE = 32
BROADCAST_KEYS = 200_000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LEAD = 0xC3
_TABLE = reduce(lambda t, _: np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1), range(8), np.arange(256, dtype=np.uint32))
# bytes of a run up to which digests are taken for all runs at once
_SIDE_BY_SIDE = 48


def runs_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and start, end and text number of each maximal run of A-Z, a-z and U+00C0 to U+00FF."""
    data, borders = text_bytes(texts)
    data = LOWER[data]
    # these letters beyond ASCII are the byte C3 and one more
    lead = data == _LEAD
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _LETTER[data] | lead
    inside[1:-1] |= lead[:-1]
    opens = inside[:-1] & np.concatenate([[True], ~inside[:-2]]) if len(data) else inside[:0]
    inner = borders[1:-1]
    inner = inner[inner < len(data)]
    opens[inner[inside[inner]]] = True
    start = np.flatnonzero(opens)
    stops = np.flatnonzero(~inside)
    end = stops[np.searchsorted(stops, start)] if len(start) else start
    end = np.minimum(end, borders[np.searchsorted(borders, start, "right")]) if len(start) else end
    return data, start, end, np.searchsorted(borders, start, "right") - 1


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """crc32 of each byte range, begun with the crc32 `heads` of what stands before it."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -_SIDE_BY_SIDE))
    out = np.zeros(len(start), np.uint32)
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(heads[i]))
    order = order[long:]
    at, left = start[order], size[order]
    state = heads[order] ^ np.uint32(0xFFFFFFFF)
    for k in range(int(left[0]) if len(left) else 0):
        some = int(np.searchsorted(-left, -k))
        state[:some] = _TABLE[(state[:some] ^ data[at[:some] + k]) & 0xFF] ^ (state[:some] >> np.uint32(8))
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def vocabulary(docs: DataFrame, min_length: int = 7, min_count: int = 2, damaged: int | None = 31) -> DataFrame:
    """(word, n): words of at least `min_length` code points and their number, if that is `min_count` or more.

    `damaged`: of a run whose digest `h`, the crc32 of `<doc_id>:<run>`, is a multiple of it, the code
    point h % length is left out, which plants misspellings; None takes runs as they are. A null id
    stands for an empty one; null and empty texts have no runs; repeated rows count again.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            data, start, end, number = runs_of(batch.column("text"))
            changed: Counter[bytes] = Counter()
            if damaged:
                heads = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column("doc_id").to_pylist()], np.uint32)
                h = digests(data, start, end, heads[number])
                hit = h % damaged == 0
                for i in np.flatnonzero(hit).tolist():
                    word = data[start[i] : end[i]].tobytes().decode()
                    if len(word) > min_length:
                        place = int(h[i]) % len(word)
                        changed[(word[:place] + word[place + 1 :]).encode()] += 1
                start, end = start[~hit], end[~hit]
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            long = points[end] - points[start] >= min_length
            start, end = start[long], end[long]
            _, first, counts = np.unique(range_hashes(data, start, end), return_index=True, return_counts=True)
            words = [data[i:j].tobytes() for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            arrays = [pa.array(words + list(changed), pa.binary()).view(pa.string()), pa.array([*counts.tolist(), *changed.values()], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["word", "n"])

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _part(word: Column, begin: Column | int, size: Column) -> Column:
    """`size` code points from place `begin` (from 0) on."""
    return F.substr(word, (F.lit(begin) if isinstance(begin, int) else begin) + 1, size)


def _shown(words: DataFrame, longer: int, places: list[tuple[int, int]]) -> DataFrame:
    """(word, key, rest, longer): parts of each word as long as the chunks of words that are `longer` code points shorter.

    `places` are (chunk, shift): a part stands at the chunk's place plus the shift. Its key also holds
    length and chunk, so that only parts in allowed places are equal; rest is what is beside the part.
    """
    word, length = F.col("word"), F.length("word") - longer
    half = F.floor(length / 2).cast("int")
    place = F.explode(F.array(*(F.struct(F.lit(c).alias("chunk"), F.lit(s).alias("shift")) for c, s in places)))
    rows = words.select("word", length.alias("_length"), half.alias("_half"), place.alias("p")).withColumn("_at", F.col("_half") * F.col("p.chunk") + F.col("p.shift"))
    end = F.col("_at") + F.col("_half")
    key = F.xxhash64("_length", "p.chunk", _part(word, F.col("_at"), F.col("_half")))
    rest = F.concat(_part(word, 0, F.col("_at")), _part(word, end, F.length("word")))
    return rows.where(F.length("word") >= 4).select("word", key.alias("key"), rest.alias("rest"), F.lit(longer).alias("longer"))


def _keyed(shown: DataFrame, crowded: DataFrame, first: int, name: str) -> DataFrame:
    """(key, longer, `name`): the part's own key, or where words crowd on it one for each way to shorten the rest.

    A way is the place of the code point left out, or -1 for the rest as it is (`first` -1 shows that
    too). For a longer word the place does not count, any of its letters may be the added one.
    """
    ways = F.when(F.col("_crowd").isNull(), F.array(F.lit(-2))).otherwise(F.sequence(F.lit(first), F.length("rest") - 1))
    rows = shown.join(crowded.withColumn("_crowd", F.lit(1)), "key", "left").select("word", "key", "rest", "longer", F.explode(ways).alias("_way"))
    left = F.concat(_part(F.col("rest"), 0, F.col("_way")), _part(F.col("rest"), F.col("_way") + 1, F.length("rest")))
    left = F.when(F.col("_way") == -1, F.col("rest")).otherwise(left)
    place = F.when(F.col("longer") == 1, -1).otherwise(F.col("_way"))
    key = F.when(F.col("_way") == -2, F.col("key")).otherwise(F.xxhash64("key", place, left))
    return rows.select(key.alias("key"), "longer", F.col("word").alias(name))


def near_words(words: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b) of all words of `words` (word, distinct) one edit apart, each pair once, a the shorter or the smaller.

    Words of less than four code points have no chunks to speak of and are left out. Keys are hashes;
    what meets by chance does not pass the verification.
    """
    chunks = _shown(words, 0, [(0, 0), (1, 0)])
    # in a word as long the whole chunk keeps its place; a letter added before the second chunk moves it, one added later leaves the first
    grams = _shown(words, 0, [(0, 0), (1, 0)]).unionByName(_shown(words, 1, [(0, 0), (1, 1)]))
    crowded = staged(chunks.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("key"), "crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded
    met = _keyed(chunks, crowded, -1, "a").drop("longer").join(_keyed(grams, crowded, 0, "b"), "key")
    order = (F.col("longer") == 1) | (F.col("a") < F.col("b"))
    # a pair can meet by both chunks
    return met.where(order & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def grouped(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each of `words` (word, n), words being distinct.

    form is the near word of largest n, ties by code points, if that n is at least `ratio` times the
    word's own; root is where forms lead to. Forms gain by `ratio` each step, so chains are as short
    as the largest n has digits and never close.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least, else forms could lead in circles")
    words = staged(words, "vocabulary")
    pairs = staged(near_words(words.select("word")), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    known = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # the largest n, then the smallest word
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_minus"), F.col("near").alias("near"))).alias("best"))
    out = words.join(best, "word", "left")
    wins = -F.col("best._minus") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best._minus")).alias("form_n"))
    out = staged(out, "forms")
    roots = out.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = staged(roots.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            break
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, damaged: int | None = 31) -> DataFrame:
    """Spelling variants of all texts of `docs` (doc_id, text): `grouped` over `vocabulary`. Other columns are ignored."""
    return grouped(vocabulary(docs, min_length, min_count, damaged), ratio)
