"""Provider payloads to postings.

Each provider is a function from sourced captures (see `with_source`) to postings. It scans its
own captures, reads the body once as VARIANT, explodes the items and projects them; there is no
shuffle. `ordinal` orders the postings of one snapshot: page by page, item by item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import rules
from tidemark.functions import variants as V
from tidemark.functions.bind import with_computed
from tidemark.functions.source_urls import setting
from tidemark.functions.text import strip, strip_right
from tidemark.functions.timestamps import parse_iso
from tidemark.functions.urls import origin, resolve_url, smartrecruiters_slug
from tidemark.schemas import POSTING_COLUMNS
from tidemark.session import small_side

# Postings one page can hold before `ordinal` would run into the next page; see validate_postings.
PAGE_SPAN = 1 << 24


def with_source(captures: DataFrame, companies: DataFrame, small: bool = False) -> DataFrame:
    """Captures with the company's name, careers url and configuration.

    `small` says that `companies` was found small enough to broadcast.
    """
    source = companies.select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), "careers_url", "source_config"
    )
    return captures.join(small_side(source, small), "company_id")


def shape_postings(items: DataFrame, source_type: str, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """Postings from exploded items with columns `page_ordinal` and `pos`; missing fields are null.

    `type_errors` names the fields whose captured value had a type the posting does not allow.
    """
    text_null = F.lit(None).cast("string")
    values = {
        "company_name": F.col("company_name"),
        "source_type": F.lit(source_type),
        "posted_at": F.lit(None).cast("timestamp"),
        **columns,
    }
    errors = values.pop("type_errors", F.array().cast("array<string>"))
    return items.select(
        "company_id",
        "cycle_ts",
        *keep,
        (F.col("page_ordinal").cast("bigint") * PAGE_SPAN + F.col("pos")).alias("ordinal"),
        *[values.get(name, text_null).alias(name) for name in POSTING_COLUMNS],
        F.array_compact(errors).alias("type_errors"),
    )


def _items(captures: DataFrame, find_items, *fields: str, **picks) -> DataFrame:
    """One row per object in the list that `find_items` picks from the parsed body.

    The named fields of the item are read once, as `f_<name>`, and each pick, an expression over
    them that is used more than once, is computed once as `p_<name>`.
    """
    parsed = with_computed(captures, doc=V.parse(F.col("body"))).drop("body")
    rows = parsed.select("*", F.posexplode(V.objects(find_items(F.col("doc")))).alias("pos", "item")).drop("doc")
    read = with_computed(rows, **{f"f_{name.replace('.', '_')}": V.field(F.col("item"), name) for name in fields})
    return with_computed(read, **{f"p_{name}": value for name, value in picks.items()}) if picks else read


def _f(name: str) -> Column:
    return F.col(f"f_{name.replace('.', '_')}")


def _p(name: str) -> Column:
    return F.col(f"p_{name}")


def _capped(text: Column, most: int | None) -> Column:
    """The first `most` characters of a description; None: all of it."""
    return text if most is None else F.substring(text, 1, most)


def _type_error(name: str, value: Column) -> Column:
    return F.when(V.not_text(value), F.lit(name))


def greenhouse(captures: DataFrame, description_cap: int | None = rules.DESCRIPTION_CAP) -> DataFrame:
    items = _items(
        captures,
        lambda doc: V.field(doc, "jobs"),
        "id", "title", "location", "location.name", "absolute_url", "url", "content", "updated_at", "first_published",
        url=V.first_truthy(_f("absolute_url"), _f("url")),
        posted=V.first_truthy(_f("updated_at"), _f("first_published")),
    )
    return shape_postings(
        items,
        "greenhouse",
        external_job_id=V.to_text(_f("id")),
        title=V.text_or(_f("title"), "Untitled"),
        location=F.when(V.is_kind(_f("location"), "OBJECT"), V.string(_f("location.name"))).otherwise(
            F.nullif(V.string(_f("location")), F.lit(""))
        ),
        url=V.text_or(_p("url"), F.col("careers_url")),
        description_text=_capped(V.to_text(_f("content")), description_cap),
        posted_at=V.timestamp(_p("posted"), "s"),
        raw_payload=F.to_json("item"),
        type_errors=F.array(_type_error("location", _f("location.name"))),
    )


def lever(captures: DataFrame, description_cap: int | None = rules.DESCRIPTION_CAP) -> DataFrame:
    items = _items(
        captures,
        lambda doc: doc,
        "id", "text", "title", "categories.location", "categories.team", "hostedUrl", "applyUrl",
        "descriptionPlain", "description", "createdAt", "updatedAt",
        title=V.first_truthy(_f("text"), _f("title")),
        url=V.first_truthy(_f("hostedUrl"), _f("applyUrl")),
        places=F.transform(
            F.slice(V.elements(_f("categories.location")), 1, 5), lambda x: F.coalesce(V.to_text(x), F.lit("None"))
        ),
    )
    return shape_postings(
        items,
        "lever",
        external_job_id=V.to_text(_f("id")),
        title=V.text_or(_p("title"), "Untitled"),
        team=V.to_text(_f("categories.team")),
        location=F.coalesce(
            V.string(_f("categories.location")), F.when(F.size(_p("places")) > 0, F.array_join(_p("places"), ", "))
        ),
        url=V.text_or(_p("url"), F.col("careers_url")),
        description_text=_capped(V.to_text(V.first_truthy(_f("descriptionPlain"), _f("description"))), description_cap),
        posted_at=V.timestamp(V.first_truthy(_f("createdAt"), _f("updatedAt")), "ms"),
        raw_payload=F.to_json("item"),
    )


def ashby(captures: DataFrame, description_cap: int | None = rules.DESCRIPTION_CAP) -> DataFrame:
    place = V.first_truthy(_f("location"), _f("locationName"))
    items = _items(
        captures,
        lambda doc: F.coalesce(V.field(doc, "jobs"), doc),
        "id", "title", "location", "locationName", "jobUrl", "url", "descriptionPlain", "descriptionHtml",
        "description", "team", "employmentType", "publishedDate", "updatedAt",
        place=place,
        inner=V.first_truthy(V.field(place, "name"), V.field(place, "primaryLocation")),
        url=V.first_truthy(_f("jobUrl"), _f("url")),
    )
    nested = V.is_kind(_p("inner"), "OBJECT")
    inner_name = F.when(nested, V.field(_p("inner"), "name")).otherwise(_p("inner"))
    return shape_postings(
        items,
        "ashby",
        external_job_id=V.to_text(_f("id")),
        title=V.text_or(_f("title"), "Untitled"),
        team=V.to_text(_f("team")),
        location=F.when(V.is_kind(_p("place"), "OBJECT"), V.string(inner_name)).otherwise(V.to_text(_p("place"))),
        employment_type=V.to_text(_f("employmentType")),
        url=V.text_or(_p("url"), F.col("careers_url")),
        description_text=_capped(
            V.to_text(V.first_truthy(_f("descriptionPlain"), _f("descriptionHtml"), _f("description"))), description_cap
        ),
        posted_at=V.timestamp(V.first_truthy(_f("publishedDate"), _f("updatedAt")), None),
        raw_payload=F.to_json("item"),
        type_errors=F.array(
            F.when(V.is_kind(_p("place"), "OBJECT") & V.not_text(inner_name), F.lit("location"))
        ),
    )


def page_setting(*keys: str) -> Column:
    """Configured page url, else the company's careers url, without closing slashes."""
    return strip_right(F.coalesce(setting(F.col("source_config"), *keys), F.col("careers_url")), "/")


def workday(
    captures: DataFrame, keep: tuple[str, ...] = (), description_cap: int | None = rules.DESCRIPTION_CAP
) -> DataFrame:
    captures = with_computed(captures, careers=page_setting("careers_url", "page_url"))
    careers = F.col("careers")

    def place_name(x: Column) -> Column:
        named = V.first_truthy(V.field(x, "descriptor"), V.field(x, "name"))
        return F.when(V.is_kind(x, "OBJECT"), F.when(V.truthy(named), V.to_text(named))).otherwise(V.string(x))

    place = V.first_truthy(_f("locationsText"), _f("location"))
    items = _items(
        captures,
        lambda doc: V.first_truthy(V.field(doc, "jobPostings"), V.field(doc, "jobs")),
        "title", "name", "jobPostingTitle", "bulletFields", "jobPostingId", "id", "locationsText", "location",
        "externalPath", "externalUrl", "jobPostingUrl", "url", "postedOn", "startDate", "jobDescription", "description",
        title=V.first_truthy(_f("title"), _f("name"), _f("jobPostingTitle")),
        ident=V.first_truthy(_f("bulletFields"), _f("jobPostingId"), _f("id")),
        place=V.string(place),
        places=F.array_compact(F.transform(V.elements(place), place_name)),
        own=V.text_or(V.first_truthy(_f("externalPath"), _f("externalUrl")), ""),
        other=V.text_or(V.first_truthy(_f("externalPath"), _f("jobPostingUrl")), ""),
        given=V.text_or(_f("url"), ""),
    )
    own, other, given = _p("own"), _p("other"), _p("given")
    own_path = (own != "") & ~own.startswith("http")
    other_path = F.when(~own_path & (given == "") & ~other.startswith("http"), other).otherwise(F.lit(""))
    path = F.when(own_path, own).otherwise(other_path)
    on_site = resolve_url(F.concat(origin(careers), F.lit("/")), F.ltrim(path, F.lit("/")))
    url = (
        F.when(path != "", on_site).when(given != "", given).when(other != "", other).otherwise(careers)
    )
    ident_list = V.elements(_p("ident"))
    return shape_postings(
        items,
        "workday",
        keep=keep,
        external_job_id=F.when(
            F.size(ident_list) > 0, F.coalesce(V.to_text(F.get(ident_list, F.lit(0))), F.lit("None"))
        ).otherwise(V.to_text(_p("ident"))),
        title=V.text_or(_p("title"), "Untitled"),
        location=F.coalesce(_p("place"), F.when(F.size(_p("places")) > 0, F.array_join(_p("places"), ", "))),
        url=url,
        description_text=_capped(V.to_text(V.first_truthy(_f("jobDescription"), _f("description"))), description_cap),
        posted_at=V.timestamp(V.first_truthy(_f("postedOn"), _f("startDate"))),
        raw_payload=F.to_json("item"),
    )


def smartrecruiters_company(config: Column, careers_url: Column) -> Column:
    return F.coalesce(
        setting(config, "company"),
        smartrecruiters_slug(F.coalesce(setting(config, "careers_url"), careers_url, F.lit(""))),
    )


def smartrecruiters(captures: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    slug = smartrecruiters_company(F.col("source_config"), F.col("careers_url"))
    captures = with_computed(captures, board=F.concat(F.lit("https://jobs.smartrecruiters.com/"), slug))
    board = F.col("board")
    careers = F.coalesce(F.nullif(page_setting("careers_url"), F.lit("")), board)
    parts = [_f(f"location.{k}") for k in ("city", "region", "country")]
    items = _items(
        captures,
        lambda doc: V.field(doc, "content"),
        "id", "uuid", "name", "title", "location", "location.city", "location.region", "location.country",
        "location.fullLocation", "ref", "refNumber", "typeOfEmployment.label", "releasedDate", "createdOn", "postedDate",
        ident=V.first_truthy(_f("id"), _f("uuid")),
        ref=V.first_truthy(_f("ref"), _f("refNumber")),
        title=V.first_truthy(_f("name"), _f("title")),
        filled=F.array_compact(F.array(*[F.when(V.truthy(p), V.string(p)) for p in parts])),
    )
    in_parts = V.is_kind(_f("location"), "OBJECT")
    full, label = _f("location.fullLocation"), _f("typeOfEmployment.label")
    wrong_part = F.exists(F.array(*parts), lambda p: V.truthy(p) & V.not_text(p))
    return shape_postings(
        items,
        "smartrecruiters",
        keep=keep,
        external_job_id=V.to_text(_p("ident")),
        title=V.text_or(_p("title"), "Untitled"),
        location=F.when(
            in_parts,
            F.when(F.size(_p("filled")) > 0, F.array_join(_p("filled"), ", ")).otherwise(V.string(full)),
        ).otherwise(V.string(_f("location"))),
        employment_type=V.string(label),
        url=F.when(V.truthy(_p("ref")), F.concat(board, F.lit("/"), V.to_text(_p("ref"))))
        .when(V.truthy(_p("ident")), F.concat(board, F.lit("/posting/"), V.to_text(_p("ident"))))
        .otherwise(careers),
        posted_at=V.timestamp(V.first_truthy(_f("releasedDate"), _f("createdOn"), _f("postedDate"))),
        raw_payload=F.to_json("item"),
        type_errors=F.array(
            F.when(in_parts & (wrong_part | ((F.size(_p("filled")) == 0) & V.not_text(full))), F.lit("location")),
            _type_error("employment_type", label),
        ),
    )


def rendered_rows(
    rows: DataFrame, source_type: str = "workday", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows scraped from a rendered list (url, title, location, posted_on) as postings.

    Rows without a url are dropped, relative urls are seen from `page_url`.
    """
    url = F.when(F.col("url").startswith("http"), F.col("url")).otherwise(
        resolve_url(F.col("page_url"), F.col("url"))
    )
    title = strip(F.when(F.col("title") != "", F.col("title")).otherwise(F.lit("Untitled")))
    kept = rows.filter(F.col("url") != "").withColumn("title", title).withColumn("url", url)
    return shape_postings(
        kept,
        source_type,
        keep=keep,
        title=F.when(F.col("title") != "", F.col("title")).otherwise(F.lit("Untitled")),
        location=F.col("location"),
        url=F.col("url"),
        posted_at=parse_iso(F.col("posted_on")),
        raw_payload=F.to_json(F.struct("location", "posted_on", "title", "url")),
    )


def generic_links(links: DataFrame) -> DataFrame:
    """Merged job links (title, url, location) as postings of the generic source type."""
    return shape_postings(
        links,
        rules.GENERIC,
        title=F.when(F.col("title") != "", F.col("title")).otherwise(F.lit("Untitled")),
        location=F.col("location"),
        url=F.when(F.col("url") != "", F.col("url")).otherwise(page_setting("careers_url", "page_url")),
        raw_payload=F.to_json(F.struct("location", "title", "url")),
    )
