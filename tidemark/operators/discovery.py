"""Source discovery over crawled pages, and job links of unstructured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark import rules
from tidemark.functions.bind import let, with_computed
from tidemark.functions.text import blank_to_null, fold_case, strip, strip_right, title_from_link_text
from tidemark.functions.urls import (
    bare_path,
    host,
    path,
    icims_board_url,
    registrable_domain,
    resolve_url,
    same_site,
    split_url,
    without_fragment,
    without_query,
    workday_board_url,
)
from tidemark.operators.boards import first_of_each_url, raw_hrefs

PAGE = ["company_id", "page_ordinal", "page_url"]


# ---- candidate links of a page ------------------------------------------------------------
def candidate_links(html: Column, base: Column, limit: int = rules.CANDIDATE_LIMIT) -> Column:
    """Array of (score, url): the page's most promising links, best first, ties by url.

    All within the row: links and iframes are resolved, made unique, scored, sorted and cut.
    """
    iframes = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(f"(?iU){rules.IFRAME_SRC}"), F.lit(1))
    raw = F.filter(F.transform(F.concat(raw_hrefs(html), iframes), strip), _is_web_reference)
    points = rules.LINK_SCORES

    def link(href: Column, i: Column) -> Column:
        return F.struct(without_fragment(resolve_url(base, href)).alias("url"), i.alias("pos"), href.alias("href"))

    def rank(page: Column) -> Column:
        def scored(x: Column) -> Column:
            def total(link_host: Column) -> Column:
                on_board = F.exists(F.array(*map(F.lit, rules.BOARD_HOSTS)), lambda h: link_host.contains(h))
                score = (
                    _points(F.concat_ws(" ", x["url"], x["href"]).rlike(f"(?iU){rules.LINK_HINT}"), points["hint"])
                    + _points(on_board, points["board_host"])
                    + _points(registrable_domain(link_host) == page["domain"], points["same_domain"])
                    + _points(link_host == page["host"], points["same_host"])
                )
                return F.struct((-score).alias("rank"), x["url"].alias("url"))

            return let(host(x["url"]), total)

        links = F.filter(F.transform(page["raw"], link), lambda x: x["url"].rlike("^https?:"))
        # Equal urls differ in score only through the href text, and the first href decides.
        return F.filter(F.transform(first_of_each_url(links), scored), lambda x: x["rank"] < 0)

    page = let(
        host(base),
        lambda h: F.struct(h.alias("host"), registrable_domain(h).alias("domain"), F.array_distinct(raw).alias("raw")),
    )
    best = F.slice(F.array_sort(let(page, rank)), 1, limit)
    return F.transform(best, lambda x: F.struct((-x["rank"]).alias("score"), x["url"].alias("url")))


def _points(test: Column, points: int) -> Column:
    return F.when(test, F.lit(points)).otherwise(F.lit(0))


def _is_web_reference(href: Column) -> Column:
    test = href != ""
    for scheme in rules.NON_PAGE_SCHEMES:
        test = test & ~href.startswith(scheme)
    return test


# ---- provider signatures ------------------------------------------------------------------
def signature_candidates(pages: DataFrame, html: str = "body", url: str = "page_url") -> DataFrame:
    """Provider signatures in a page's text and url, at most one per rule.

    Adds (rule_ordinal, provider, confidence, source_type, source_config, evidence) and drops the
    page text. A rule's pattern is tried only on pages that contain its host name.
    """
    text = F.concat(F.coalesce(F.col(html), F.lit("")), F.lit("\n"), F.coalesce(F.col(url), F.lit("")))
    kept = [c for c in pages.columns if c != html]
    read = with_computed(pages.select(*kept, text.alias("_text")), _folded=fold_case(F.col("_text")))
    hosts = dict.fromkeys(_HOSTS)
    tested = with_computed(read, **{f"_on_{i}": F.col("_folded").contains(h) for i, h in enumerate(hosts)})
    on_host = {h: F.col(f"_on_{i}") for i, h in enumerate(hosts)}
    matched = with_computed(tested, **_matches(F.col("_text"), on_host, F.col(url)))
    found = F.array(*_signatures(on_host))
    hits = matched.select(*kept, F.posexplode(found).alias("rule_ordinal", "_hit"))
    return hits.filter(F.col("_hit").isNotNull()).select(*kept, "rule_ordinal", "_hit.*")


_HOSTS = (
    "greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com", "icims.com", "jobs.gem.com",
    "taleo.net", "eightfold.ai", "oraclecloud.com",
)


def _matches(text: Column, on_host: dict[str, Column], page_url: Column) -> dict[str, Column]:
    """First match of every pattern, searched only in pages that name its host."""

    def first(word: str, pattern: str) -> Column:
        return F.when(on_host[word], blank_to_null(F.regexp_extract(text, f"(?iU){pattern}", 1)))

    slug, word_url = r"([a-z0-9_-]+)", r"""[^"'\s<>]"""

    def host_token(page: Column) -> Column:
        token = F.get(F.split(F.trim(bare_path(page), F.lit("/")), "/", -1), F.lit(0))
        return F.when(page["netloc"].endswith("greenhouse.io") & ~token.isin("", "embed", "jobs"), token)

    return {
        "_gh_api": first("greenhouse.io", rf"boards-api\.greenhouse\.io/v1/boards/{slug}/"),
        "_gh_board": first("greenhouse.io", rf"(?:boards|job-boards)\.greenhouse\.io/{slug}"),
        "_gh_host": F.when(on_host["greenhouse.io"], let(split_url(page_url), host_token)),
        "_lever": first("lever.co", rf"jobs\.lever\.co/{slug}"),
        "_lever_api": first("lever.co", rf"api\.lever\.co/v0/postings/{slug}"),
        "_ashby": first("ashbyhq.com", rf"jobs\.ashbyhq\.com/{slug}"),
        "_ashby_api": first("ashbyhq.com", rf"api\.ashbyhq\.com/posting-api/job-board/{slug}"),
        "_workday": let(
            first("myworkdayjobs.com", rf"(https?://[a-z0-9.-]*\.myworkdayjobs\.com/{word_url}+)"),
            lambda u: workday_board_url(strip_right(u, "/")),
        ),
        "_smart": first("smartrecruiters.com", rf"jobs\.smartrecruiters\.com/{slug}"),
        "_icims": let(
            first("icims.com", rf"(https?://[a-z0-9.-]*\.icims\.com{word_url}*)"),
            lambda u: icims_board_url(strip_right(u, "/")),
        ),
        "_gem": first("jobs.gem.com", rf"jobs\.gem\.com/{slug}"),
        "_taleo": first("taleo.net", rf"(https?://{word_url}*taleo\.net{word_url}*)"),
        "_eightfold": first("eightfold.ai", rf"(https?://{word_url}*eightfold\.ai{word_url}*)"),
        "_oracle": first(
            "oraclecloud.com", rf"(https?://[a-z0-9.-]*\.oraclecloud\.com/hcmUI/CandidateExperience{word_url}*)"
        ),
    }


def _signatures(on_host: dict[str, Column]) -> list[Column]:
    def candidate(value, provider, confidence, config, evidence, supported=True) -> Column:
        return F.when(
            value.isNotNull(),
            F.struct(
                F.lit(provider).alias("provider"),
                F.lit(confidence).alias("confidence"),
                F.lit(provider if supported else None).cast("string").alias("source_type"),
                F.create_map(*[c for k, v in config.items() for c in (F.lit(k), v)]).alias("source_config"),
                F.concat(F.lit(evidence), value).alias("evidence"),
            ),
        )

    def prefixed(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value)

    names = "gh_api gh_board gh_host lever lever_api ashby ashby_api workday smart icims taleo eightfold oracle"
    gh_api, gh_board, gh_host, lever, lever_api, ashby, ashby_api, workday, smart, icims, taleo, eightfold, oracle = (
        F.col(f"_{n}") for n in names.split()
    )
    gem = prefixed("https://jobs.gem.com/", F.col("_gem"))
    taleo_hit = F.coalesce(
        candidate(taleo, "taleo", 82, {"careers_url": strip_right(taleo, "/")}, "Taleo URL: ", False),
        F.when(
            on_host["taleo.net"],
            F.struct(
                F.lit("taleo").alias("provider"),
                F.lit(70).alias("confidence"),
                F.lit(None).cast("string").alias("source_type"),
                F.create_map().cast("map<string,string>").alias("source_config"),
                F.lit("Taleo reference in page (no board URL extracted)").alias("evidence"),
            ),
        ),
    )
    # fixed values: providers, confidences and evidence texts, in matching order
    return [
        candidate(gh_api, "greenhouse", 100, {"board_token": gh_api}, "Greenhouse API board token: "),
        candidate(gh_board, "greenhouse", 95, {"board_token": gh_board}, "Greenhouse board URL token: "),
        candidate(lever, "lever", 100, {"company": lever}, "Lever jobs URL slug: "),
        candidate(lever_api, "lever", 98, {"company": lever_api}, "Lever API slug: "),
        candidate(ashby, "ashby", 100, {"organization": ashby}, "Ashby jobs org: "),
        candidate(ashby_api, "ashby", 98, {"organization": ashby_api}, "Ashby posting API org: "),
        candidate(workday, "workday", 90, {"careers_url": workday}, "Workday host: "),
        candidate(
            smart,
            "smartrecruiters",
            88,
            {"company": smart, "careers_url": prefixed("https://jobs.smartrecruiters.com/", smart)},
            "SmartRecruiters board: ",
        ),
        candidate(icims, "icims", 85, {"careers_url": icims}, "iCIMS URL: "),
        candidate(gem, "gem", 84, {"careers_url": gem}, "Gem jobs board: "),
        taleo_hit,
        candidate(eightfold, "eightfold", 84, {"careers_url": strip_right(eightfold, "/")}, "Eightfold URL: ", False),
        candidate(oracle, "oracle", 86, {"careers_url": strip_right(oracle, "/")}, "Oracle Cloud HCM: ", False),
        candidate(gh_host, "greenhouse", 92, {"board_token": gh_host}, "Greenhouse host path token: "),
    ]


def best_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate per company: supported first, then confidence, then earliest page and rule."""
    rank = F.struct(
        F.col("source_type").isNull(), -F.col("confidence"), F.col("page_ordinal"), F.col("rule_ordinal")
    )
    values = F.struct("provider", "confidence", "source_type", "source_config", "evidence")
    return candidates.groupBy("company_id").agg(F.min_by(values, rank).alias("best")).select("company_id", "best.*")


def discovery_results(landings: DataFrame, best: DataFrame) -> DataFrame:
    """Discovery result and bucket per company.

    `landings` has one row per company: (company_id, landing_url, fetch_error); companies without
    a candidate keep their row.
    """
    supported = F.col("source_type").isNotNull()
    provider = F.col("provider")
    names = ", ".join(sorted(rules.SOURCE_TYPES))
    unsupported_reason = F.concat(
        F.col("evidence"),
        F.lit(". Provider '"),
        provider,
        F.lit(f"' is detected but not auto-enabled (supported scrapers: {names})."),
    )
    error = F.col("fetch_error")
    reason = (
        F.when(error.isNotNull(), F.concat(F.lit("Failed to fetch careers landing page: "), error))
        .when(supported, F.col("evidence"))
        .when(provider.isNotNull(), unsupported_reason)
        .otherwise(F.lit(rules.NO_SIGNATURE))
    )
    usable = error.isNull() & provider.isNotNull()
    return landings.join(best, "company_id", "left").select(
        "company_id",
        F.when(usable, provider).otherwise(F.lit("")).alias("source_type"),
        F.when(usable, F.col("source_config"))
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("source_config"),
        F.when(usable, provider).alias("provider_detected"),
        (usable & supported).alias("supported"),
        F.when(usable & supported, F.lit("high"))
        .when(usable, F.lit("medium"))
        .otherwise(F.lit("none"))
        .alias("confidence"),
        reason.alias("reason"),
        F.when(
            usable & ~supported, F.coalesce(F.try_element_at("source_config", F.lit("careers_url")), "landing_url")
        )
        .otherwise(F.col("landing_url"))
        .alias("final_careers_url"),
        F.when(error.isNotNull(), F.lit("errors"))
        .when(supported, F.lit("configured_supported"))
        .when(provider.isNotNull(), F.lit("detected_unsupported"))
        .otherwise(F.lit("still_unknown"))
        .alias("bucket"),
    )


# ---- job links of unstructured pages ------------------------------------------------------
def is_rejected_url(url: Column, text: Column) -> Column:
    """Login, legal, culture and apply links."""
    trimmed = strip(text)
    return (
        url.rlike(f"(?iU){rules.REJECT_URL}")
        | F.concat_ws(" ", url, text).rlike(f"(?iU){rules.REJECT_TEXT}")
        | trimmed.rlike(f"(?iU){rules.APPLY_BUTTON}")
        | (text.rlike(r"(?iU)\bapply\b") & (F.length(trimmed) < 24))
    )


def is_job_link(url: Column, text: Column) -> Column:
    parts = split_url(url)
    where = F.concat_ws(" ", bare_path(parts), parts["query"], text)
    hinted = where.rlike(f"(?iU){rules.ACCEPT_TEXT}") | where.rlike(f"(?iU){rules.JOB_PATH_HINT}")
    return _is_web_reference(url) & ~url.startswith("#") & ~is_rejected_url(url, text) & hinted


def job_link_score(url: Column, text: Column) -> Column:
    """Points of a job link, -1 for other links."""
    low = F.lower(F.concat_ws(" ", url, text))
    p = rules.JOB_LINK_SCORES
    score = (
        F.lit(p["base"])
        + _points(low.contains("/job/") | low.contains("/jobs/"), p["job_path"])
        + _points(low.contains("engineer") | low.contains("software"), p["role"])
        + _points(low.contains("requisition") | low.contains("posting"), p["requisition"])
        + _points(F.length(strip(text)) > 8, p["long_text"])
    )
    return F.when(is_job_link(url, text), score).otherwise(F.lit(-1))


def anchor_links(anchors: DataFrame, page: list[str] = PAGE) -> DataFrame:
    """Anchors that are job links, resolved and titled: (page, pos, url, title, location)."""
    text = strip(F.coalesce("text", F.lit("")))
    href = strip(F.coalesce("href", F.lit("")))
    rest = anchors.drop("text", "href")
    given = with_computed(anchors, _text=text, _href=href).select(*rest.columns, F.col("_text").alias("text"), "_href")
    resolved = with_computed(given, url=resolve_url(F.col("page_url"), F.col("_href")))
    return resolved.filter((F.col("_href") != "") & is_job_link(F.col("url"), F.col("text"))).select(
        *page, F.col("anchor_ordinal").alias("pos"), "url", title_from_link_text(F.col("text")).alias("title"), "location"
    )


def merge_page_links(links: DataFrame, page: list[str], order: list[str], max_links: int | None = rules.MAX_LINKS) -> DataFrame:
    """As merge_links, for groups that are pages: one shuffle, and a page's links are in one task.

    A link that is the first of its url takes a place; what comes after the last place is left out.
    """
    by_url = Window.partitionBy(*page, "url").orderBy(*order)
    seen = Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = links.repartition(*page).withColumn("_new", (F.row_number().over(by_url) == 1).cast("int"))
    rows = rows.withColumn("_place", F.sum("_new").over(seen).cast("int"))
    if max_links is not None:
        rows = rows.filter((F.col("_place") < max_links) | ((F.col("_place") == max_links) & (F.col("_new") == 1)))
    best = F.min_by(F.struct("title", "location"), F.struct(-F.length("title"), *order))
    return rows.groupBy(*page, "url").agg(F.min("_place").alias("rank"), best.alias("best")).select(*page, "rank", "url", "best.*")


def merge_links(links: DataFrame, group: list[str], order: list[str], max_links: int | None = rules.MAX_LINKS) -> DataFrame:
    """Links of a group merged by url in order, the longest title winning, until `max_links` are held; None: all.

    Once the last place is taken the group is closed: later links neither join nor improve a title.
    The result keeps (group, rank, url, title, location), rank being the order of first sight.
    """
    if max_links is None:
        best = F.min_by(F.struct("title", "location"), F.struct(-F.length("title"), F.struct(*order)))
        merged = links.groupBy(*group, "url").agg(F.min(F.struct(*order)).alias("first"), best.alias("best"))
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("first"))
        return merged.withColumn("rank", rank).select(*group, "rank", "url", "best.*")
    firsts = links.groupBy(*group, "url").agg(F.min(F.struct(*order)).alias("first"))
    ranked = firsts.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*group).orderBy("first"))
    ).filter(F.col("rank") <= max_links)
    # At most max_links rows per group are left, so this window is bounded.
    last_place = F.max(F.when(F.col("rank") == max_links, F.col("first")))
    places = ranked.withColumn("closed_at", last_place.over(Window.partitionBy(*group)))
    position = F.struct(*order)
    held = links.join(places.select(*group, "url", "rank", "closed_at"), [*group, "url"]).filter(
        F.col("closed_at").isNull() | (position <= F.col("closed_at"))
    )
    # Longest title first, then earliest: min over (-length, position).
    return (
        held.groupBy(*group, "url", "rank")
        .agg(F.min_by(F.struct("title", "location"), F.struct(-F.length("title"), position)).alias("best"))
        .select(*group, "rank", "url", "best.*")
    )


def job_links(
    anchors: DataFrame, max_links: int | None = rules.MAX_LINKS, by: tuple[str, ...] = ("company_id",)
) -> DataFrame:
    """Job links per company (or other key): merged within each page, then over the pages in order."""
    page = [*by, "page_ordinal", "page_url"]
    per_page = merge_page_links(anchor_links(anchors, page), page, ["pos"], max_links)
    return merge_links(per_page.withColumnRenamed("rank", "pos"), list(by), ["page_ordinal", "pos"], max_links)


# ---- crawl frontier -----------------------------------------------------------------------
def follow_score(url: Column) -> Column:
    low = F.lower(path(url))
    hinted = F.exists(F.array(*map(F.lit, rules.FOLLOW_PATH_HINTS)), lambda h: low.contains(h))
    p = rules.FOLLOW_SCORES
    return (
        _points(hinted, p["path_hint"])
        + _points(low.rlike(f"(?iU){rules.JOB_PATH_HINT}"), p["job_hint"])
        + _points(low.isin(*rules.FOLLOW_EXACT_PATHS), p["exact"])
    )


def next_pages(
    links: DataFrame, visited: DataFrame | None = None, limit: int = rules.FOLLOW_LIMIT
) -> DataFrame:
    """Pages of the same site worth visiting next: per page the best `limit` by score, then url.

    `links` has (company_id, page_ordinal, page_url, landing_url, pos, url) with absolute urls; of
    links that differ only in query or fragment the first is kept. `visited` (company_id, url) are
    left out at the end.
    """
    own = links.filter(same_site(F.col("landing_url"), F.col("url")))
    firsts = (
        with_computed(own, page_key=without_query(F.col("url")))
        .groupBy(*PAGE, "page_key")
        .agg(F.min_by("url", "pos").alias("url"))
        .withColumn("score", follow_score(F.col("url")))
        .filter((F.col("score") > 0) & ~is_rejected_url(F.col("url"), F.lit("")))
    )
    best = firsts.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("score"), "url"))
    ).filter(F.col("rank") <= limit)
    found = best.select(*PAGE, "rank", "score", "url")
    return found.join(visited.select("company_id", "url"), ["company_id", "url"], "left_anti") if visited else found
