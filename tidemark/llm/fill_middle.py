"""Fill-in-the-middle documents, cut between code points that are found with SWAR words.

A batch's UTF-8 bytes are viewed as 64-bit words. Arithmetic on a word marks the bytes that end a
code point, a popcount per word and its running sum tell how many units end up to each word, a
binary search in the sums finds the word of the k-th unit, and in it the byte is selected with one
multiplication and a comparison of all eight bytes at once. No text is decoded and no loop runs
over characters.

Map-only: where a document is cut and which form it takes follow from a digest of its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.frames import fresh
from tidemark.llm.words import slices, text_bytes

_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
_DRAWS = 4
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class Marks(NamedTuple):
    """Texts that stand before the three parts of an output."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def check(self) -> Marks:
        """A mark that begins as it ends could be found too early where a text stands before it."""
        for mark in self:
            if not mark or any(mark[:k] == mark[-k:] for k in range(1, len(mark))):
                raise ValueError(f"a mark must not be empty nor begin as it ends: {mark!r}")
        return self


def unit_ends(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes as 64-bit words in which each byte that ends a code point is 1 and all others are 0."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    # 10xxxxxx goes on with a unit: the top bit is set, the next one is not
    starts = ((words >> np.uint64(7)) & ~(words >> np.uint64(6)) & _ONES) ^ _ONES
    # a byte ends a unit if the next byte starts one
    return (starts[:-1] >> np.uint64(8)) | (starts[1:] << np.uint64(56))


class Units:
    """Rank and select over the code points of some bytes."""

    def __init__(self, data: np.ndarray):
        self.ends = unit_ends(data)
        self.upto = np.zeros(len(self.ends) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.upto[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each byte position."""
        word, byte = at >> 3, (at & 7).astype(np.uint64)
        below = (np.uint64(1) << (np.uint64(8) * byte)) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.ends[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte position after the k-th unit, k from 1."""
        word = np.searchsorted(self.upto[1:], k)
        left = (k - self.upto[word]).astype(np.uint64)
        # byte j holds the units that end in bytes 0 to j; its top bit stays where these reach `left`
        reached = ((self.ends[word] * _ONES | _TOPS) - left * _ONES) & _TOPS
        return word * 8 + 9 - np.bitwise_count(reached)


def cuts(data: np.ndarray, borders: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text: its units, the units before both cuts in ascending order, and the byte positions of these.

    `first` and `second` are draws of any size; a draw modulo units + 1 is a cut.
    """
    units = Units(data)
    before = units.rank(borders)
    n = np.diff(before)
    low, high = np.minimum(first % (n + 1), second % (n + 1)), np.maximum(first % (n + 1), second % (n + 1))
    at = [np.where(k > 0, units.select(np.maximum(before[:-1] + k, 1)), borders[:-1]) for k in (low, high)]
    return n, low, high, *at


def _formed(text: bytes, low: int, high: int, form: str, marks: list[bytes]) -> bytes:
    before, middle, after = text[:low], text[low:high], text[high:]
    p, s, m = marks
    if form == "psm":
        return b"".join((p, before, s, after, m, middle))
    return b"".join((s, after, p, before, m, middle)) if form == "spm" else text


def fill_middle(docs: DataFrame, seed: int = 1, rate: int = 90, suffix_first: int = 20, marks: Marks = Marks()) -> DataFrame:
    """`docs` (doc_id, text) with n, form, prefix_chars, middle_chars and output added.

    Of 100 documents `rate` are cut, and of these `suffix_first` take the form spm (suffix, prefix,
    middle), the others psm; the rest is plain, the text itself. A text that is null or empty or holds
    a mark is plain too. n counts code points; prefix_chars and middle_chars are null for plain rows.
    A null id draws as an empty one; rows that repeat an id draw alike, each for its own length.
    Columns of `docs` named like the added ones are replaced, all others are kept.
    """
    marks = marks.check()
    kept = [c for c in docs.columns if c not in ADDED]
    names = [fresh(docs.columns, f"draw_{k}") for k in range(_DRAWS)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = {name: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k, name in enumerate(names)}
    raw_marks = [m.encode() for m in marks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, borders = text_bytes(batch.column("text"))
            first, second, third, fourth = (batch.column(c).to_numpy() for c in names)
            n, low, high, low_at, high_at = cuts(data, borders, first, second)
            forms = np.where((n == 0) | (third % 100 >= rate), "plain", np.where(fourth % 100 < suffix_first, "spm", "psm")).tolist()
            outputs = []
            for i, form in enumerate(forms):
                text, start = data[borders[i] : borders[i + 1]].tobytes(), borders[i]
                if form != "plain" and any(m in text for m in raw_marks):
                    forms[i] = form = "plain"
                outputs.append(_formed(text, low_at[i] - start, high_at[i] - start, form, raw_marks))
            plain = np.array([form == "plain" for form in forms], bool)
            added = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(low, pa.int64(), mask=plain), pa.array(high - low, pa.int64(), mask=plain)]
            arrays = [*(batch.column(c) for c in kept), *added, pa.array(outputs, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *ADDED])

    kinds = [LongType(), StringType(), LongType(), LongType(), StringType()]
    schema = StructType([docs.schema[c] for c in kept] + [StructField(c, kind) for c, kind in zip(ADDED, kinds, strict=True)])
    return docs.select(*kept).withColumns(draws).mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made of; null where either is null."""
    after = lambda text, head, mark: F.substr(text, F.length(head) + F.lit(len(mark) + 1))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.split_part(body, F.lit(second), F.lit(1))
        rest = after(body, one, second)
        two = F.split_part(rest, F.lit(marks.middle), F.lit(1))
        return one, two, after(rest, two, marks.middle)

    before, behind, middle = parts(marks.prefix, marks.suffix)
    psm = F.concat(before, middle, behind)
    behind, before, middle = parts(marks.suffix, marks.prefix)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(before, middle, behind)).otherwise(output)
