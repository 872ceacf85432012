"""Location text to one of US, REMOTE_US, INTERNATIONAL, UNKNOWN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark import rules
from tidemark.functions.bind import let
from tidemark.functions.text import normalize_whitespace, strip

US, REMOTE_US, INTERNATIONAL, UNKNOWN = "US", "REMOTE_US", "INTERNATIONAL", "UNKNOWN"
KEPT = (US, REMOTE_US)


def normalize_location(location: Column) -> Column:
    return normalize_whitespace(F.lower(F.coalesce(location, F.lit(""))))


def location_segments(normalized: Column) -> Column:
    """Alternatives listed in one location text; the text itself when nothing is left of them."""
    pieces = F.transform(F.split(normalized, f"(?iU){rules.LOCATION_SPLIT}", -1), strip)
    kept = F.filter(pieces, lambda p: p != "")
    return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(normalized)))


def mentions_state(segment: Column) -> Column:
    """A state code after a comma, or as a word that does not follow `in` or `of`."""
    codes = "|".join(rules.HOME_STATES)
    after_comma = segment.rlike(rf"(?iU),\s*({codes})\b")
    words = F.split(F.trim(F.regexp_replace(segment, r"(?U)[\s,\x1c-\x1f]+", " ")), " ")

    def any_state(tokens: Column) -> Column:
        def is_state(word: Column, i: Column) -> Column:
            code = F.regexp_replace(word, "[^a-z]", "").isin(*rules.HOME_STATES)
            return code & ((i == 0) | ~F.get(tokens, i - 1).isin("in", "of"))

        return F.exists(F.transform(tokens, is_state), lambda hit: hit)

    return after_comma | let(words, any_state)


def classify_segment(segment: Column) -> Column:
    def has(pattern: str) -> Column:
        return segment.rlike(f"(?iU){pattern}")

    return (
        F.when(segment == "", F.lit(UNKNOWN))
        .when(has(rules.REMOTE_ABROAD) | has(rules.ABROAD), F.lit(INTERNATIONAL))
        .when(has(rules.REMOTE_HOME) | has(rules.REMOTE_PREFIX), F.lit(REMOTE_US))
        .when(has(rules.HOME_COUNTRY) | has(rules.HOME_STATE_NAMES) | mentions_state(segment), F.lit(US))
        .when(has(rules.HOME_CITIES), F.lit(US))
        .when(has(rules.REMOTE_WORD), F.lit(REMOTE_US))
        .otherwise(F.lit(UNKNOWN))
    )


def classify_location(location: Column) -> Column:
    """One foreign alternative makes the whole text foreign; one unknown makes it unknown."""

    def verdict(kinds: Column) -> Column:
        return (
            F.when(F.array_contains(kinds, INTERNATIONAL), F.lit(INTERNATIONAL))
            .when(F.array_contains(kinds, UNKNOWN), F.lit(UNKNOWN))
            .when(F.array_contains(kinds, US), F.lit(US))
            .otherwise(F.lit(REMOTE_US))
        )

    def kinds(normalized: Column) -> Column:
        return let(location_segments(normalized), lambda segments: F.transform(segments, classify_segment))

    return let(let(normalize_location(location), kinds), verdict)


def is_us_or_remote(location: Column) -> Column:
    return classify_location(location).isin(*KEPT)
