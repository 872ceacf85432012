"""Text columns: whitespace, fingerprints, link titles, HTML escaping."""

from __future__ import annotations

import json
import unicodedata
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from tidemark import rules
from tidemark.functions.bind import let

# What counts as white space for str.strip, str.split and "\s": the controls, the Unicode spaces
# and U+001C..U+001F. Spelled out, as a plain character class is much faster than a property.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Characters known to be left alone by NFKC and to take part in no composition: ASCII but U+0001,
# the precomposed Latin letters, and the common dashes, quotes and bullets.
NFKC_STABLE = (
    "\\x00\\x02-\\x7fÀ-ıĴ-ľŁ-ňŊ-ž‐‒-―‘-‟†-•"
)

# Letters that case-insensitive matching takes for i, i, s and k: dotted capital I, dotless i,
# long s, Kelvin sign.
_ASCII_LIKE = "\u0130\u0131\u017f\u212a"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def strip_right(value: Column, char: str) -> Column:
    return F.rtrim(value, F.lit(char))


def normalize_whitespace(value: Column) -> Column:
    """Trimmed, with every run of white space as one blank."""
    return F.trim(F.regexp_replace(value, f"{SPACE}+", " "))


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def fold_case(value: Column) -> Column:
    """Lower case in which a case-insensitive ASCII literal is always visible to `contains`.

    Four letters match ASCII ones without lower-casing to them. Translating is slow, so only texts
    that hold one of them are translated.
    """

    def fold(text: Column) -> Column:
        unusual = reduce(or_, [text.contains(letter) for letter in _ASCII_LIKE])
        return F.lower(F.when(unusual, F.translate(text, _ASCII_LIKE, "iisk")).otherwise(text))

    return let(value, fold)


@F.arrow_udf(StringType())
def _exact_key(parts: pa.Array) -> pa.Array:
    """JSON lists of parts to normalised parts joined by pipes; most rows are null and stay so."""
    if parts.null_count == len(parts):
        return parts

    def join(row: str | None) -> str | None:
        if row is None:
            return None
        return "|".join(" ".join(unicodedata.normalize("NFKC", p).lower().split()) for p in json.loads(row))

    return pa.array([join(row) for row in parts.to_pylist()], pa.string())


def _key(parts: list[Column]) -> Column:
    """The parts normalised (null as empty, NFKC, lower case, trimmed, collapsed), joined by pipes.

    Rows whose characters NFKC leaves alone are done here on one string, with U+0001 between the
    parts until the blanks around it are gone. Only other rows reach the Python function.
    """
    present = [F.coalesce(p, F.lit("")) for p in parts]
    joined = F.concat_ws("\x01", *present)
    blanks = F.regexp_replace(F.lower(joined), f"{SPACE}+", " ")
    native = F.regexp_replace(F.trim(blanks), " ?\x01 ?", "|")
    shape = "\\x01".join([f"[{NFKC_STABLE}]*+"] * len(parts))
    return F.coalesce(_exact_key(F.when(~joined.rlike(f"^{shape}$"), F.to_json(F.array(*present)))), native)


def normalize_for_fingerprint(value: Column) -> Column:
    """Null becomes the empty string; then NFKC, lower case, trimmed and collapsed."""
    return _key([value])


def fingerprint(
    company_name: Column, title: Column, location: Column, url: Column, external_job_id: Column
) -> Column:
    """SHA-256 hex of the five normalised parts joined by a pipe (not escaped)."""
    return F.sha2(_key([company_name, title, location, url, external_job_id]), 256)


def title_from_link_text(text: Column) -> Column:
    """Link text as a title: collapsed, a stock title for blank or apply buttons, at most 160 long."""
    clean = normalize_whitespace(F.coalesce(text, F.lit("")))
    return (
        F.when((clean == "") | clean.rlike(f"(?iU){rules.APPLY_BUTTON}"), F.lit("Open position"))
        .when(F.length(clean) > 160, F.concat(F.substring(clean, 1, 157), F.lit("...")))
        .otherwise(clean)
    )


def html_escape(value: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value
