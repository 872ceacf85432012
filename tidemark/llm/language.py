"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, all else between them is one blank, and n-grams of `SIZES` code points are
hashed to buckets. Counts per language and bucket are summed in the tasks first and then by Spark,
over all training texts. The matrix of log-probabilities is broadcast: languages times buckets never
exceed `CELLS`, since the number of buckets follows from the number of languages. Texts are
scored in numpy, a block of n-grams at a time: rows of the matrix are gathered and summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.frames import fresh
from tidemark.llm.words import mix, slices, text_bytes

SIZES = (1, 2, 3)
CELLS, MOST_BITS, LEAST_BITS = 1 << 22, 16, 8
SMOOTHING = 0.05
UNKNOWN = "und"
ADDED = ("lang_pred", "score")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIZE_MARKS = mix(np.arange(1, 17, dtype=np.uint64))
_BLOCK = 1 << 20
_LEAD = np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint32)


class Model(NamedTuple):
    """Languages in order, their log priors, and log-probabilities of shape (buckets, languages)."""

    langs: list[str]
    prior: np.ndarray
    matrix: np.ndarray
    bits: int


@cache
def letters() -> np.ndarray:
    """Per code point the lower-case letter, 0 for what is no letter."""
    return np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def code_points(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the borders of the texts among them."""
    starts = (data & 0xC0) != 0x80
    at = np.flatnonzero(starts)
    lead = data[at]
    extra = (lead >= 0xC0).astype(np.int8) + (lead >= 0xE0) + (lead >= 0xF0)
    value = lead & _LEAD[extra]
    for k in (1, 2, 3):
        more = np.flatnonzero((extra >= k) & (at + k < len(data)))
        value[more] = (value[more] << np.uint32(6)) | (data[at[more] + k] & 0x3F)
    return np.minimum(value, 0x10FFFF), np.searchsorted(at, borders)


def spelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, each text between blanks (0) and with one blank for all else, and the text's number."""
    points, borders = code_points(*text_bytes(texts))
    shown = letters()[points]
    number = np.repeat(np.arange(len(texts)), np.diff(borders) + 2)
    shown = np.insert(shown, np.repeat(borders, [1, *[2] * (len(borders) - 2), 1]) if len(borders) > 1 else borders[:0], 0)
    before = np.concatenate([[1], shown[:-1]])
    keep = (shown > 0) | (before > 0)
    keep[1:] |= number[1:] != number[:-1]
    return shown[keep], number[keep]


def ngrams(texts: pa.Array, bits: int, sizes: tuple[int, ...] = SIZES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size (text number, bucket) of every n-gram, in the order of texts. A blank alone is none.

    Up to three code points fit one 64-bit number; of longer n-grams the first ones fold over.
    """
    shown, number = spelled(texts)
    shown = shown.astype(np.uint64)
    packed, whole = shown, np.ones(len(shown), bool)
    for k in range(1, max(sizes, default=0) + 1):
        if k > 1:
            packed = ((packed[:-1] << np.uint64(21)) ^ (packed[:-1] >> np.uint64(43))) ^ shown[k - 1 :]
            # texts end and begin with a blank, and no two stand together inside
            whole = whole[:-1] & ((shown[k - 2 : -1] | shown[k - 1 :]) > 0)
        if k in sizes:
            at = np.flatnonzero(whole if k > 1 else shown > 0)
            yield number[at], (((packed[at] ^ _SIZE_MARKS[k % len(_SIZE_MARKS)]) * _STEP) >> np.uint64(64 - bits)).astype(np.int64)


def bits_for(languages: int) -> int:
    """Bits of a bucket, so that the matrix has at most `CELLS` cells."""
    bits = min(MOST_BITS, (CELLS // max(1, languages)).bit_length() - 1)
    if bits < LEAST_BITS:
        raise ValueError(f"{languages} languages leave less than {1 << LEAST_BITS} buckets each")
    return bits


def train(labelled: DataFrame, sizes: tuple[int, ...] = SIZES, smoothing: float = SMOOTHING) -> Model:
    """The model of all rows of `labelled` (text, lang) with a language; repeated rows count again.

    Null and empty texts count for the prior alone.
    """
    labelled = labelled.where(F.col("lang").isNotNull()).select("lang", "text")
    known = labelled.groupBy("lang").agg(F.count("*").alias("n")).limit((CELLS >> LEAST_BITS) + 1).orderBy("lang").collect()
    langs = [row["lang"] for row in known]
    bits = bits_for(len(langs))
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.array(langs, pa.string())
        total = np.zeros((len(langs), width), np.int64)
        for batch in slices(batches, "text"):
            lang = pc.index_in(batch.column("lang").cast(pa.string()), place).to_numpy().astype(np.int64)
            for number, bucket in ngrams(batch.column("text"), bits, sizes):
                total += np.bincount(lang[number] * width + bucket, minlength=total.size).reshape(total.shape)
        at = np.flatnonzero(total)
        for i in range(0, len(at), _BLOCK):
            some = at[i : i + _BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total.ravel()[some])], names=["cell", "n"])

    cells = labelled.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), width))
    counts.ravel()[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    rows = np.array([row["n"] for row in known], float)
    matrix = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * width))
    return Model(langs, np.log(rows / rows.sum()), np.ascontiguousarray(matrix.T, np.float32), bits)


def log_scores(texts: pa.Array, model: Model, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """Log of prior and likelihood, of shape (texts, languages), and the number of n-grams of each text."""
    total, n = np.tile(model.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    block = max(1, _BLOCK // max(1, len(model.langs)))
    for number, bucket in ngrams(texts, model.bits, sizes):
        n += np.bincount(number, minlength=len(texts))
        for i in range(0, len(bucket), block):
            part = number[i : i + block]
            begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            total[part[begins]] += np.add.reduceat(model.matrix[bucket[i : i + block]], begins, axis=0, dtype=np.float64)
    return total, n


def predict(docs: DataFrame, model: Model, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """`docs` with lang_pred and score added; columns of these names are replaced, all others are kept.

    score is the probability of the predicted language under the model; of languages that tie the
    first by name is taken. A text that is null or has no letter is `UNKNOWN` with score 0, and so is
    every text where no language was learned. Map-only; rows are scored alone.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in slices(batches, "text", 1 << 20):
            best, score = np.full(batch.num_rows, len(model.langs)), np.zeros(batch.num_rows)
            if model.langs:
                total, n = log_scores(batch.column("text"), model, sizes)
                some = n > 0
                best[some] = total[some].argmax(axis=1)
                score[some] = 1 / np.exp(total[some] - total[some].max(axis=1, keepdims=True)).sum(axis=1)
            arrays = [*(batch.column(c) for c in kept), pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *ADDED])

    schema = StructType([docs.schema[c] for c in kept] + [StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*kept).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id's text leaves 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang) with held_out, lang_pred and score, by the model of all rows that are not held out."""
    apart = fresh(docs.columns, "held_out")
    rows = docs.drop("held_out").withColumn(apart, held_out(F.col("doc_id")))
    model = train(rows.where(~F.col(apart)).select("text", "lang"))
    return predict(rows, model).withColumnRenamed(apart, "held_out")
