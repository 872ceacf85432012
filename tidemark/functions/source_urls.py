"""Board and probe urls derived from a company's source type and configuration map."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark import rules
from tidemark.functions.text import blank_to_null
from tidemark.functions.urls import gem_board_url, smartrecruiters_slug, without_slash


def setting(config: Column, *keys: str) -> Column:
    """First non-blank value among the alias keys, else null."""
    return F.coalesce(*[blank_to_null(F.try_element_at(config, F.lit(k))) for k in keys])


def _prefixed(prefix: str, value: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), value, F.lit(suffix))


def careers_url_or_error(source_type: Column, config: Column) -> Column:
    """Struct(url, error): exactly one of the two is set."""
    board = setting(config, "board_token", "token")
    site = setting(config, "company", "site")
    org = setting(config, "organization", "org")
    page = setting(config, "careers_url", "page_url")
    careers = setting(config, "careers_url")
    company = setting(config, "company")
    url = (
        F.when(source_type == "greenhouse", _prefixed("https://boards.greenhouse.io/", board))
        .when(source_type == "lever", _prefixed("https://jobs.lever.co/", site))
        .when(
            source_type == "ashby",
            F.coalesce(
                _prefixed("https://jobs.ashbyhq.com/", org),
                setting(config, "posting_api_url"),
                F.lit("https://jobs.ashbyhq.com/"),
            ),
        )
        .when(
            source_type == "smartrecruiters",
            F.coalesce(without_slash(careers), _prefixed("https://jobs.smartrecruiters.com/", company)),
        )
        .when(source_type == "gem", gem_board_url(careers))
        .when(source_type.isin("workday", "icims", rules.GENERIC), without_slash(page))
        .otherwise(F.coalesce(page, F.lit("")))
    )
    error = (
        F.when(source_type == "greenhouse", F.lit("Greenhouse source_config requires board_token"))
        .when(source_type == "lever", F.lit("Lever source_config requires company"))
        .when(
            source_type == "smartrecruiters",
            F.lit("SmartRecruiters source_config requires company or careers_url"),
        )
        .when(source_type == "gem", F.lit("Gem source_config requires careers_url"))
        .otherwise(F.concat(source_type, F.lit(" source_config requires careers_url")))
    )
    return F.struct(url.alias("url"), F.when(url.isNull(), error).alias("error"))


def careers_url_for(source_type: Column, config: Column) -> Column:
    return careers_url_or_error(source_type, config)["url"]


def validation_url_for(source_type: Column, config: Column) -> Column:
    """Public probe url, or null when the type or its configuration offers none."""
    board = setting(config, "board_token", "token")
    site = setting(config, "company", "site")
    org = setting(config, "organization", "org")
    slug = F.coalesce(setting(config, "company"), smartrecruiters_slug(setting(config, "careers_url")))
    return (
        F.when(source_type == "greenhouse", _prefixed("https://boards-api.greenhouse.io/v1/boards/", board, "/jobs"))
        .when(source_type == "lever", _prefixed("https://api.lever.co/v0/postings/", site))
        .when(
            source_type == "ashby",
            F.coalesce(
                setting(config, "posting_api_url"),
                _prefixed("https://api.ashbyhq.com/posting-api/job-board/", org),
            ),
        )
        .when(
            source_type == "smartrecruiters",
            _prefixed("https://api.smartrecruiters.com/v1/companies/", slug, "/postings"),
        )
        .when(
            source_type.isin("workday", "icims", "gem", rules.GENERIC), careers_url_for(source_type, config)
        )
    )


def expects_json(source_type: Column) -> Column:
    return source_type.isin(*rules.JSON_SOURCE_TYPES)


def is_not_found(status_code: Column, message: Column) -> Column:
    """A 404, from the status when there is one, else from the wording of the message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    worded = low.contains("404") & low.rlike("not found|status|client error")
    return F.when(status_code.isNotNull(), status_code == 404).otherwise(worded)


def not_found_detail(source_type: Column, config: Column, message: Column) -> Column:
    """What to record for a source that answered 404."""

    def named(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label} "), value, F.lit(" returned 404"))

    def value_or_mark(key: str) -> Column:
        return F.coalesce(F.try_element_at(config, F.lit(key)), F.lit("?"))

    return (
        F.when(source_type == "greenhouse", named("Greenhouse board_token", value_or_mark("board_token")))
        .when(source_type == "lever", named("Lever company slug", value_or_mark("company")))
        .when(
            source_type == "ashby",
            named("Ashby organization", F.coalesce(setting(config, "organization", "org"), F.lit("?"))),
        )
        .when(source_type == "smartrecruiters", named("SmartRecruiters company", value_or_mark("company")))
        .when(source_type == "workday", F.lit("Workday careers_url returned 404"))
        .when(source_type == "icims", F.lit("iCIMS careers_url returned 404"))
        .when(source_type == "gem", F.lit("Gem careers_url returned 404"))
        .when(source_type == rules.GENERIC, F.lit("Generic Playwright careers_url returned 404"))
        .otherwise(F.coalesce(message, F.lit("source returned 404")))
    )


def parse_bool(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*rules.TRUE_WORDS)


def looks_like_job_board(body: Column, source_type: Column) -> Column:
    """Board marks for known kinds of source; otherwise a page of some length with a job hint."""
    text = F.coalesce(body, F.lit(""))
    low = F.lower(text)
    return (
        ((source_type == "gem") & low.contains("jobs.gem.com"))
        | ((source_type == "icims") & low.contains("icims") & low.contains("/jobs/"))
        | ((source_type == "workday") & low.contains("workday"))
        | ((source_type == "smartrecruiters") & (low.contains("smartrecruiters") | low.contains("posting")))
        | ((F.length(text) >= rules.JOB_BOARD_MIN_LENGTH) & text.rlike(f"(?iU){rules.JOB_BOARD_HINTS}"))
    )
