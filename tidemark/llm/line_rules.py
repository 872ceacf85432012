"""Line-first cleaning: lines that fail a rule go, then documents that lost too much text.

A line is judged alone by three kinds of rules: punctuation (a line of prose has a sentence end, is
not shouted and is not made of symbols), navigation (menus and cells set apart by bars, bullets or
arrows) and boilerplate (rights, licences, cookies, sign-ups). What is left of a document decides.
Document counts that guard against very short and repetitive texts are taken from the same pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.words import AS_IS, chain, find_words, slices

# Texts by which lines are known.
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*(\s|$)"
SEPARATORS = r"(^|\s)[|•·»›→—](\s|$)"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    r"(?i)all rights reserved|copyright (\(c\)|©|[0-9]{4})|©|cookie (policy|settings)|privacy policy|terms of (use|service)"
    r"|licensed under|released under|subscribe|sign up|log ?in|click here|read more|share this|powered by|lorem ipsum|javascript"
)
BOILERPLATE_WORDS = 30
SYMBOL_SHARE = 0.5
SEPARATOR_SHARE = 0.2
SHOUTED_SHARE = 0.5
WINDOW = 5

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, n_lines_removed long, kept_word_chars long, cleaned string"
)

_END, _SEPARATOR, _BOILERPLATE = re.compile(SENTENCE_END), re.compile(SEPARATORS), re.compile(BOILERPLATE)
_BLANKS = re.compile(r"[\x20\x09-\x0d]+")
_SYMBOL_BYTES = np.isin(np.arange(256), list(SYMBOLS.encode()))
_STARTS_POINT = (np.arange(256) & 0xC0) != 0x80


def line_fails(line: str) -> str | None:
    """The rule a line with words fails, or None."""
    words = _BLANKS.sub(" ", line.strip("\x20\x09\x0a\x0b\x0c\x0d")).split(" ")
    if len(words) <= BOILERPLATE_WORDS and _BOILERPLATE.search(line):
        return "boilerplate"
    if len(words) >= 3 and len(_SEPARATOR.findall(line)) >= SEPARATOR_SHARE * len(words):
        return "navigation"
    if not _END.search(line):
        return "punctuation"
    if len(words) >= 5:
        if sum(any(c in SYMBOLS for c in w) for w in words) > SYMBOL_SHARE * len(words):
            return "punctuation"
        if sum(w.endswith("!") and w.upper() == w for w in words) > SHOUTED_SHARE * len(words):
            return "punctuation"
    return None


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside a run of `window` words that the sequence holds twice or more."""
    runs = chain(hashes, window)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[: len(runs)] += twice
    edge[window : window + len(runs)] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def judge(text: str, most_lost: float) -> tuple[int, int, int, int, int, str]:
    """Duplicate lines, lines with words, lines removed, code points of words, of kept words, what is left."""
    seen, duplicates, lines, removed, all_chars, kept_chars, left = set(), 0, 0, 0, 0, 0, []
    for line in text.split("\n"):
        chars = len(_BLANKS.sub("", line))
        if not chars:
            left.append(line)
            continue
        lines += 1
        duplicates += line in seen
        seen.add(line)
        all_chars += chars
        if line_fails(line):
            removed += 1
        else:
            kept_chars += chars
            left.append(line)
    return duplicates, lines, removed, all_chars, kept_chars, "\n".join(left)


def clean(docs: DataFrame, most_lost: float = 0.5, min_words: int = 10, most_repeated: int = 20) -> DataFrame:
    """`docs` (doc_id, text) judged: counts, base_failed, kept, and the text that its lines' rules leave.

    `base_failed`: fewer than `min_words` words, or more than `most_repeated` percent of words inside
    repeated five-word windows. `kept`: not failed, and at most `most_lost` of the characters of
    words stood in removed lines. A null or blank text has zero counts, an empty cleaned text and
    fails. Repeated rows and null ids give a row each; other columns of `docs` are ignored.
    Map-only: a row is judged where it is read, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            words = find_words(texts, fold=AS_IS)
            points = np.concatenate([[0], np.cumsum(_STARTS_POINT[words.data])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL_BYTES[words.data])])
            points, symbols = (points[words.end] - points[words.start], symbols[words.end] - symbols[words.start])
            rows = []
            for i, text in enumerate(texts.to_pylist()):
                low, high = words.first[i], words.first[i + 1]
                n, repeated = int(high - low), repeated_words(words.hash[low:high])
                duplicates, lines, removed, chars, left_chars, left = judge(text or "", most_lost)
                failed = n < min_words or 100 * repeated > most_repeated * n
                rows.append(
                    (n, int(points[low:high].sum()), int(symbols[low:high].sum()), duplicates, repeated, failed,
                     not failed and chars - left_chars <= most_lost * chars, lines, removed, left_chars, left)
                )
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.large_string()]
            names = ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))]
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], names=names)

    ids = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, {COLUMNS}")
