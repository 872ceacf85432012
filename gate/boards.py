"""Queries for HTML pages and rendered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gate.providers import companies
from gate.registry import query
from gate.surrogates import SQL_LINKS, SQL_PAGES, pages
from tidemark.operators import boards, discovery, providers
from tidemark.operators.providers import PAGE_SPAN


@query(
    "page_links",
    f"WITH {SQL_PAGES}, {SQL_LINKS} SELECT page_id, rank AS pos, url FROM links_v",
)
def page_links(spark, d):
    return boards.page_links(pages(spark, d)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url")


def board_captures(spark, d, kind: str, careers: str, method: str = "html") -> DataFrame:
    """Pages as captures of companies whose careers url is made from the page number."""
    k = F.col("page_id").cast("string")
    return pages(spark, d).select(
        "page_id",
        "company_id",
        F.lit("2002-01-01").cast("timestamp").alias("cycle_ts"),
        F.lit(kind).alias("source_type"),
        F.lit(method).alias("method"),
        "page_ordinal",
        "page_url",
        F.lit(200).alias("status_code"),
        "body",
        F.concat(F.lit("Company "), F.col("company_id").cast("string")).alias("company_name"),
        F.replace(F.lit(careers), F.lit("{n}"), k).alias("careers_url"),
        F.create_map().cast("map<string,string>").alias("source_config"),
    )


_ORDINAL = f"page_ordinal * {PAGE_SPAN} AS ordinal"


@query(
    "gem_postings",
    f"""WITH {SQL_PAGES} SELECT company_id, {_ORDINAL}, 'https://jobs.gem.com/co' || page_id || '/' || page_id AS url,
      'Role at co' || page_id AS title, CAST(page_id AS VARCHAR) AS external_job_id FROM pages_v WHERE page_id % 11 = 0""",
)
def gem_postings(spark, d):
    found = boards.gem(board_captures(spark, d, "gem", "https://jobs.gem.com/CO{n}/x"))
    return found.select("company_id", "ordinal", "url", "title", "external_job_id")


@query(
    "icims_postings",
    f"""WITH {SQL_PAGES}, p AS (SELECT *, 'https://careers-co' || page_id || '.icims.com/jobs/' || page_id || '/software-engineer/job' AS url
        FROM pages_v WHERE page_id % 11 = 1),
      w AS (SELECT *, substring(body, greatest(strpos(body, url) - 200, 1), 400 + least(strpos(body, url) - 201, 0)) AS near FROM p)
    SELECT company_id, {_ORDINAL}, url, coalesce(nullif(trim(regexp_extract(near, '>([^<]{{4,120}})</', 1)), ''), 'Open position') AS title,
      CAST(page_id AS VARCHAR) AS external_job_id FROM w
    UNION ALL SELECT company_id, {_ORDINAL}, 'https://careers-co' || page_id || '.icims.com/jobs/' || CASE page_id % 11 WHEN 6 THEN 'search?page=2' ELSE CAST(page_id AS VARCHAR) END,
      'Open position', CASE WHEN page_id % 11 = 9 THEN CAST(page_id AS VARCHAR) END FROM pages_v WHERE page_id % 11 IN (6, 9)""",
)
def icims_postings(spark, d):
    found = boards.icims(board_captures(spark, d, "icims", "https://careers-co{n}.icims.com/jobs"))
    return found.select("company_id", "ordinal", "url", "title", "external_job_id")


@query(
    "smartrecruiters_html_postings",
    f"""WITH {SQL_PAGES} SELECT company_id, {_ORDINAL}, 'https://jobs.smartrecruiters.com/co' || page_id || '/posting/' || page_id AS url,
      'Open position' AS title FROM pages_v WHERE page_id % 11 = 2""",
)
def smartrecruiters_html_postings(spark, d):
    rows = board_captures(spark, d, "smartrecruiters", "https://jobs.smartrecruiters.com/co{n}")
    return boards.smartrecruiters_html(rows).select("company_id", "ordinal", "url", "title")


def page_anchors(spark, d) -> DataFrame:
    """Links of pages as anchors, with made-up texts and selector ranks."""
    links = boards.page_links(pages(spark, d).withColumn("origin", F.regexp_extract("page_url", "^https?://[^/?#]+", 0)))
    n = F.col("page_id") * 7 + F.col("pos")
    text = F.element_at(
        F.array(*[F.lit(t) for t in ANCHOR_TEXTS]), (n % len(ANCHOR_TEXTS) + 1).cast("int")
    )
    folder = F.element_at(F.array(*[F.lit(t) for t in ANCHOR_PATHS]), (n % len(ANCHOR_PATHS) + 1).cast("int"))
    return links.select(
        "page_id",
        "company_id",
        F.lit("2002-01-01").cast("timestamp").alias("cycle_ts"),
        "page_ordinal",
        "page_url",
        "origin",
        F.col("pos").alias("anchor_ordinal"),
        F.concat(folder, (n % 13).cast("string")).alias("href"),
        text.alias("text"),
        F.when(n % 4 == 0, F.lit("Austin")).alias("location"),
        (n % 3).cast("int").alias("selector_rank"),
    )


ANCHOR_TEXTS = [
    "Software Engineer", "  Data   Engineer II ", "Apply", "Apply now", "Privacy", "", "View openings", "Sign in",
    "Senior Backend Engineer, Payments Platform", "Apply for this role today and join us", "Blog",
]
ANCHOR_PATHS = ["/jobs/", "/job/", "/careers/p", "/about", "/login/", "/requisition/", "/associate/job/", "/positions?id=", "/blog/job"]

SQL_ANCHORS = f"""anchors_v AS (
  SELECT page_id, company_id, page_ordinal, page_url, origin, rank AS anchor_ordinal,
    ({ANCHOR_PATHS!r})[1 + (page_id * 7 + rank) % {len(ANCHOR_PATHS)}] || ((page_id * 7 + rank) % 13) AS href,
    ({ANCHOR_TEXTS!r})[1 + (page_id * 7 + rank) % {len(ANCHOR_TEXTS)}] AS text,
    CASE WHEN (page_id * 7 + rank) % 4 = 0 THEN 'Austin' END AS location, (page_id * 7 + rank) % 3 AS selector_rank
  FROM links_v)"""


@query(
    "workday_rendered_postings",
    f"""WITH {SQL_PAGES}, {SQL_LINKS}, {SQL_ANCHORS}, hits AS (
      SELECT *, origin || href AS url, min(selector_rank) OVER (PARTITION BY page_id) AS best FROM anchors_v WHERE href LIKE '%/job/%')
    SELECT company_id, page_ordinal * {PAGE_SPAN} + min(anchor_ordinal) AS ordinal, url,
      coalesce(nullif(trim(arg_min(text, anchor_ordinal)), ''), 'Untitled') AS title
    FROM hits WHERE selector_rank = best GROUP BY page_id, company_id, page_ordinal, url""",
)
def workday_rendered_postings(spark, d):
    rows = boards.workday_anchor_rows(page_anchors(spark, d)).withColumn("company_name", F.lit("x"))
    return providers.rendered_rows(rows).select("company_id", "ordinal", "url", "title")


@query(
    "rendered_list_postings",
    f"""WITH {SQL_PAGES}, {SQL_LINKS}, {SQL_ANCHORS}
    SELECT company_id, page_ordinal * {PAGE_SPAN} + anchor_ordinal AS ordinal, CASE WHEN anchor_ordinal % 2 = 0 THEN origin || href ELSE 'http' || href END AS url,
      coalesce(nullif(trim(text), ''), 'Untitled') AS title, location, TIMESTAMP '2001-02-03' AS posted_at
    FROM anchors_v WHERE anchor_ordinal % 5 <> 4""",
)
def rendered_list_postings(spark, d):
    n = F.col("anchor_ordinal")
    url = F.when(n % 5 == 4, F.lit("")).when(n % 2 == 0, F.col("href")).otherwise(F.concat(F.lit("http"), "href"))
    rows = page_anchors(spark, d).withColumns(
        {"pos": n, "url": url, "title": F.col("text"), "posted_on": F.lit("2001-02-03"), "company_name": F.lit("x")}
    )
    return providers.rendered_rows(rows).select("company_id", "ordinal", "url", "title", "location", "posted_at")


@query(
    "chosen_methods",
    f"""WITH {SQL_PAGES}, {SQL_LINKS}, n AS (SELECT *, count(*) FILTER (WHERE page_id % 2 = 0) OVER w AS plain,
        count(*) FILTER (WHERE page_id % 2 = 1) OVER w AS rendered FROM links_v WINDOW w AS (PARTITION BY company_id))
    SELECT company_id, page_id, url FROM n
    WHERE page_id % 2 = CASE WHEN plain < 12 AND rendered > 0 THEN 1 ELSE 0 END""",
)
def chosen_methods(spark, d):
    rows = boards.page_links(pages(spark, d)).withColumns(
        {
            "method": F.when(F.col("page_id") % 2 == 0, F.lit("html")).otherwise(F.lit("rendered")),
            "cycle_ts": F.lit("2002-01-01").cast("timestamp"),
        }
    )
    return boards.choose_method(rows, "html", "rendered", 12).select("company_id", "page_id", "url")
