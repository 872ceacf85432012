"""HTML pages to links and postings.

Everything a page yields is computed inside its own row with array expressions: first-seen order
and uniqueness come from array_distinct, fallbacks from a `when` on the first stage's size. The
only shuffle is in `choose_method`, on one count per company.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import rules
from tidemark.functions.bind import let, with_computed
from tidemark.functions.text import strip, strip_right
from tidemark.functions.urls import gem_board_url, gem_slug, path, resolve_url
from tidemark.operators.providers import page_setting, shape_postings
from tidemark.session import small_side


def raw_hrefs(html: Column) -> Column:
    """Href values in page order, without mail, phone and script links."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"(?iU){rules.HREF}"), F.lit(1))

    def is_page(href: Column) -> Column:
        test = F.lit(True)
        for scheme in rules.NON_PAGE_SCHEMES:
            test = test & ~href.startswith(scheme)
        return test

    return F.filter(found, is_page)


def extract_hrefs(html: Column, base: Column) -> Column:
    """Absolute urls of a page's links, each once, in first-seen order."""
    return F.array_distinct(F.transform(raw_hrefs(html), lambda h: resolve_url(base, strip(h))))


def first_of_each_url(items: Column) -> Column:
    """Of an array of struct(url, pos, ...) the first item of each url, in page order.

    Equal urls are next to each other once sorted, so long pages need no search per link.
    """

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["url"] != x["url"]))

    def in_page_order(kept: Column) -> Column:
        by_place = F.array_sort(F.transform(kept, lambda x: F.struct(x["pos"].alias("pos"), x.alias("item"))))
        return F.transform(by_place, lambda x: x["item"])

    return let(let(F.array_sort(items), firsts), in_page_order)


def page_links(pages: DataFrame, html: str = "body", base: str = "page_url") -> DataFrame:
    """One row per link of a page: (..., pos, url). The page text is not carried along."""
    links = extract_hrefs(F.col(html), F.col(base))
    return pages.select(*[c for c in pages.columns if c != html], F.posexplode(links).alias("pos", "url"))


def gem_links(html: Column, base: Column) -> Column:
    """Job links of a board page; filtered hrefs when there are none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"(?iU){rules.GEM_JOB_URL}"), F.lit(0))
    known = F.struct(
        F.array_distinct(found).alias("hits"),
        gem_slug(base).alias("company"),
        strip_right(gem_board_url(base), "/").alias("prefix"),
    )

    def links(x: Column) -> Column:
        hits, company = x["hits"], x["company"]

        def own(u: Column) -> Column:
            slug = F.regexp_extract(u, f"(?iU){rules.GEM_JOB_URL}", 1)
            return company.isNull() | (F.lower(slug) == F.lower(company))

        def listed(u: Column) -> Column:
            low = F.lower(u)
            on_board = company.isNull() | low.contains(F.concat(F.lit("jobs.gem.com/"), company, F.lit("/")))
            fresh = (strip_right(u, "/") != x["prefix"]) & ~F.array_contains(hits, u)
            return low.contains("jobs.gem.com") & fresh & on_board

        fallback = F.filter(extract_hrefs(html, base), listed)
        return let(F.filter(hits, own), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(fallback))

    return let(known, links)


def gem_title(url: Column) -> Column:

    def title(parts: Column) -> Column:
        numbered = (F.size(parts) >= 2) & F.element_at(parts, -1).rlike(r"^(?:\p{Nd}+$|am9icG9zd)")
        return F.when(numbered, F.concat(F.lit("Role at "), F.get(parts, F.lit(0)))).otherwise(F.lit("Open role"))

    return let(F.split(F.trim(path(url), F.lit("/")), "/", -1), title)


def gem_external_id(url: Column) -> Column:
    """Last path piece unless it is blank or letters only."""
    tail = F.substring_index(strip_right(url, "/"), "/", -1)
    return F.when((tail != "") & ~tail.rlike(r"^\p{L}+$"), tail)


def icims_items(html: Column, base: Column) -> Column:
    """Array of (url, title): numbered job links, else hrefs on the host's job pages."""
    text = F.coalesce(html, F.lit(""))
    hrefs = F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(f"(?iU){rules.ICIMS_JOB_HREF}"), F.lit(1)), strip)
    )

    def titled(x: Column) -> Column:
        return F.struct(x["url"].alias("url"), _title_near(text, x["href"]).alias("title"))

    def listed(u: Column) -> Column:
        low = F.lower(u)
        on_job_page = path(u).rlike(f"(?iU){rules.ICIMS_JOB_PATH}")
        return low.contains("icims.com") & on_job_page & ~low.contains("/login")

    def untitled(u: Column) -> Column:
        return F.struct(u.alias("url"), F.lit("Open position").alias("title"))

    def choose(found: Column) -> Column:
        firsts = first_of_each_url(found)
        fallback = F.transform(F.filter(extract_hrefs(html, base), listed), untitled)
        return F.when(F.size(found) > 0, F.transform(firsts, titled)).otherwise(fallback)

    def resolved(href: Column, i: Column) -> Column:
        return F.struct(resolve_url(base, href).alias("url"), i.alias("pos"), href.alias("href"))

    return let(F.transform(hrefs, resolved), choose)


def _title_near(html: Column, href: Column) -> Column:
    """Text of the first tag around the first mention of a link; the window starts before it."""

    def window(at: Column) -> Column:
        start = F.greatest(at - rules.ICIMS_TITLE_RADIUS, F.lit(1))
        return F.substring(html, start, at + rules.ICIMS_TITLE_RADIUS - start)

    title = strip(F.regexp_extract(let(F.position(href, html), window), rules.ICIMS_TITLE, 1))
    return F.coalesce(F.nullif(title, F.lit("")), F.lit("Open position"))


def icims_external_id(url: Column) -> Column:
    """Last all-digit path piece."""
    digits = F.filter(F.split(url, "/", -1), lambda p: p.rlike(r"^\p{Nd}+$"))
    return F.try_element_at(digits, F.lit(-1))


def smartrecruiters_links(html: Column, base: Column) -> Column:
    return F.filter(
        extract_hrefs(html, base),
        lambda u: F.lower(u).contains("smartrecruiters.com")
        & (F.lower(u).contains("/posting/") | F.lower(u).contains("/job/")),
    )


def _link_postings(captures, source_type, links: Column, title, external_id=None) -> DataFrame:
    rows = captures.select(*captures.columns, F.posexplode(links).alias("pos", "url")).drop("body")
    rows = with_computed(rows, title=title(F.col("url")))
    columns = {"title": F.col("title"), "url": F.col("url")}
    if external_id:
        columns["external_job_id"] = external_id(F.col("url"))
    return shape_postings(
        rows,
        source_type,
        keep=("method",),
        raw_payload=F.to_json(F.struct("title", "url")),
        **columns,
    )


def gem(captures: DataFrame) -> DataFrame:
    captures = with_computed(captures, board=gem_board_url(page_setting("careers_url")))
    return _link_postings(captures, "gem", gem_links(F.col("body"), F.col("board")), gem_title, gem_external_id).drop("method")


def smartrecruiters_html(captures: DataFrame) -> DataFrame:
    captures = with_computed(captures, careers=page_setting("careers_url"))
    links = smartrecruiters_links(F.col("body"), F.col("careers"))
    return _link_postings(captures, "smartrecruiters", links, lambda _: F.lit("Open position"))


def icims(captures: DataFrame) -> DataFrame:
    """Keeps `method`, so that `choose_method` can pick between the plain and the rendered page."""
    captures = with_computed(captures, careers=page_setting("careers_url"))
    careers = F.col("careers")
    items = F.posexplode(icims_items(F.col("body"), careers)).alias("pos", "item")
    rows = captures.select(*captures.columns, items).drop("body")
    url = F.col("item.url")
    return shape_postings(
        rows,
        "icims",
        keep=("method",),
        external_job_id=icims_external_id(url),
        title=F.col("item.title"),
        url=url,
        raw_payload=F.to_json("item"),
    )


def choose_method(
    postings: DataFrame, structured: str, rendered: str, enough: int = 1, small: bool = False
) -> DataFrame:
    """Keep one capture method per company and cycle.

    The structured one with at least `enough` postings; else the rendered one if it has any;
    else whatever the structured one gave. `small` says that there are few enough companies to
    broadcast the choices.
    """
    chosen = (
        postings.groupBy("company_id", "cycle_ts")
        .agg(
            F.count_if(F.col("method") == structured).alias("n_structured"),
            F.count_if(F.col("method") == rendered).alias("n_rendered"),
        )
        .select(
            "company_id",
            "cycle_ts",
            F.when(
                (F.col("n_structured") < enough) & (F.col("n_rendered") > 0), F.lit(rendered)
            ).otherwise(F.lit(structured)).alias("method"),
        )
    )
    return postings.join(small_side(chosen, small), ["company_id", "cycle_ts", "method"], "left_semi")


def workday_anchor_rows(anchors: DataFrame) -> DataFrame:
    """Job links of rendered Workday pages: the first selector that found any, each url once.

    Returns rows for `rendered_rows`: (company_id, cycle_ts, page_ordinal, page_url, pos, url,
    title, location, posted_on).
    """
    page = ["company_id", "cycle_ts", "page_ordinal", "page_url"]
    found = anchors.filter(F.col("href").contains("/job/")).select(
        *page,
        "anchor_ordinal",
        "selector_rank",
        resolve_url(F.col("page_url"), F.col("href")).alias("url"),
        strip(F.coalesce("text", F.lit(""))).alias("title"),
    )
    by_url = found.groupBy(*page, "url", "selector_rank").agg(
        F.min("anchor_ordinal").alias("pos"), F.min_by("title", "anchor_ordinal").alias("title")
    )
    winner = by_url.groupBy(*page).agg(F.min("selector_rank").alias("selector_rank"))
    return by_url.join(winner, [*page, "selector_rank"], "left_semi").select(
        *page,
        "pos",
        "url",
        "title",
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("posted_on"),
    )
