"""The digest of new entry-level software jobs.

`digest_fragments` is the document as ordered rows: it is sorted and written by many tasks and has
no size limit. `digest_document` glues the same rows into one text for a mail.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import rules
from tidemark.functions.timestamps import local_day, within_local_day
from tidemark.functions.text import html_escape
from tidemark.operators.lists import digest_eligible, filter_jobs, seen_since, with_company_name

# fixed values: document texts
HTML_OPEN = (
    '<html><body style="font-family:system-ui,Segoe UI,Roboto,sans-serif;font-size:15px;line-height:1.5;">'
)
HTML_HEAD = '<h2 style="margin:0 0 12px;">New entry-level SWE jobs — {day}</h2>'
HTML_SECTION_OPEN = '<h3 style="margin:20px 0 8px;">'
HTML_SECTION_LIST = '</h3><ul style="margin:0;padding-left:20px;">'
HTML_ITEM_OPEN = '<li style="margin-bottom:10px;"><a href="'
HTML_META_OPEN = '<br/><span style="color:#555;font-size:13px;">'
TEXT_HEAD = "New entry-level SWE jobs — {day}"
SUBJECT = "New Entry-Level SWE Jobs — {day}"
EMPTY_HTML = "<p>No new entry-level SWE jobs today.</p>"
EMPTY_TEXT = "No new entry-level SWE jobs today."


def select_digest_jobs(
    jobs: DataFrame,
    companies: DataFrame,
    as_of: Column,
    *,
    lookback_hours: int | None = None,
    zone: str = rules.TIME_ZONE,
    day: date | str | None = None,
) -> DataFrame:
    """Digest candidates with company names: the lookback window when set and not 0, else the day,
    which is the one of `as_of` in the zone where none is given."""
    if lookback_hours:
        recent = seen_since(jobs, as_of, lookback_hours)
    elif day is not None:
        recent = filter_jobs(jobs, first_seen_day=day, zone=zone)
    else:
        recent = jobs.filter(within_local_day(F.col("first_seen_at"), local_day(as_of, zone), zone))
    return with_company_name(digest_eligible(recent), companies)


def digest_window(lookback_hours: int | None, zone: str = rules.TIME_ZONE) -> str:
    return f"last {lookback_hours} hours (UTC)" if lookback_hours else f"today in {zone}"


def digest_items(candidates: DataFrame) -> DataFrame:
    """Each candidate rendered as an HTML list item and as text lines."""
    place = F.nullif(F.col("location"), F.lit(""))
    meta = F.concat_ws(" — ", place, F.date_format("posted_at", "yyyy-MM-dd"))
    return candidates.select(
        "company_name",
        "company_id",
        "title",
        "id",
        F.concat(
            F.lit(HTML_ITEM_OPEN),
            html_escape(F.col("url")),
            F.lit('">'),
            html_escape(F.col("title")),
            F.lit("</a>"),
            F.when(meta != "", F.concat(F.lit(HTML_META_OPEN), html_escape(meta), F.lit("</span>"))).otherwise(
                F.lit("")
            ),
            F.lit("</li>"),
        ).alias("html"),
        F.concat(
            F.lit("- "),
            F.col("title"),
            F.lit("\n  "),
            F.col("url"),
            F.when(meta != "", F.concat(F.lit("\n  "), meta)).otherwise(F.lit("")),
        ).alias("text"),
    )


def digest_fragments(candidates: DataFrame) -> DataFrame:
    """Section heads, items and section ends: (company_name, part, company_id, title, id, html, text).

    In that order the fragments are the body of the document.
    """
    none = F.lit(None)
    items = digest_items(candidates).withColumn("part", F.lit(1))
    sections = items.select("company_name").distinct()
    head = sections.select(
        "company_name",
        F.concat(
            F.lit(HTML_SECTION_OPEN), html_escape(F.col("company_name")), F.lit(HTML_SECTION_LIST)
        ).alias("html"),
        F.concat(F.lit("## "), "company_name").alias("text"),
        F.lit(0).alias("part"),
    )
    tail = sections.select(
        "company_name", F.lit("</ul>").alias("html"), F.lit("").alias("text"), F.lit(2).alias("part")
    )
    marks = head.unionByName(tail).withColumns(
        {"company_id": none.cast("bigint"), "title": none.cast("string"), "id": none.cast("bigint")}
    )
    columns = ["company_name", "part", "company_id", "title", "id", "html", "text"]
    return items.select(columns).unionByName(marks.select(columns))


def ordered_fragments(fragments: DataFrame) -> DataFrame:
    return fragments.orderBy("company_name", "part", "company_id", "title", "id")


def _dated(template: str, day: Column) -> Column:
    before, after = template.split("{day}")
    return F.concat(F.lit(before), day, F.lit(after))


def digest_document(candidates: DataFrame, day: date | str | Column) -> DataFrame:
    """One row (subject, html, text) of any number of fragments; a large day is better written as `digest_fragments`."""
    day = day.cast("string") if isinstance(day, Column) else F.lit(str(day))
    fragments = digest_fragments(candidates)
    rows = F.array_sort(
        F.collect_list(F.struct("company_name", "part", "company_id", "title", "id", "html", "text"))
    )
    body = fragments.agg(rows.alias("rows"))
    html = F.concat(
        _dated(HTML_OPEN + HTML_HEAD, day),
        F.array_join(F.col("rows.html"), ""),
        F.lit("</body></html>"),
    )
    text = F.concat(_dated(TEXT_HEAD + "\n\n", day), F.array_join(F.col("rows.text"), "\n"))
    empty = F.size("rows") == 0
    return body.select(
        _dated(SUBJECT, day).alias("subject"),
        F.when(empty, F.lit(EMPTY_HTML)).otherwise(html).alias("html"),
        F.when(empty, F.lit(EMPTY_TEXT)).otherwise(F.rtrim(text, F.lit("\n"))).alias("text"),
    )
