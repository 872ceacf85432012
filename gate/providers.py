"""Queries for the provider payload jobs: postings are written as payloads, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gate.registry import query
from gate.surrogates import companies, postings, sql_postings, table
from tidemark.operators import ingest, providers
from tidemark.plans.cycle import collect_postings

PAGE_SIZE = 64


def captures_of(rows: DataFrame, item: Column, opening: str, closing: str, kind: str, method: str = "api") -> DataFrame:
    """Bodies of at most PAGE_SIZE items each, in posting order."""
    pages = (
        rows.withColumn("page_ordinal", F.floor(F.col("ordinal") / PAGE_SIZE).cast("int"))
        .withColumn("json", item)
        .groupBy("company_id", "cycle_ts", "page_ordinal")
        .agg(F.array_sort(F.collect_list(F.struct("ordinal", "json"))).alias("items"))
    )
    return pages.select(
        "company_id",
        F.lit(kind).alias("source_type"),
        "cycle_ts",
        F.lit(method).alias("method"),
        "page_ordinal",
        F.lit("https://example.com/api").alias("page_url"),
        F.lit(200).alias("status_code"),
        F.lit("application/json").alias("content_type"),
        F.concat(F.lit(opening), F.array_join("items.json", ","), F.lit(closing)).alias("body"),
    )


def k() -> Column:
    return F.col("ordinal")


def iso() -> Column:
    return F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def seconds() -> Column:
    return F.unix_timestamp("posted_at")


def variant3(a: Column, b: Column, c: Column) -> Column:
    return F.when(k() % 3 == 0, F.to_json(a)).when(k() % 3 == 1, F.to_json(b)).otherwise(F.to_json(c))


def sourced(spark, d, item, opening, closing, kind):
    return providers.with_source(captures_of(postings(spark, d), item, opening, closing, kind), companies(spark, d))


OUT = ["company_id", "ordinal", "company_name", "external_job_id", "title", "team", "location", "employment_type", "url", "description_text", "posted_at"]


def _sql(title, location, url, external="CAST(ordinal AS VARCHAR)", team="NULL", employment="NULL", description="NULL", posted="posted_at"):
    return f"""WITH {sql_postings()} SELECT company_id,
      (ordinal // {PAGE_SIZE}) * {providers.PAGE_SPAN} + row_number() OVER (PARTITION BY company_id, ordinal // {PAGE_SIZE} ORDER BY ordinal) - 1 AS ordinal,
      company_name, {external} AS external_job_id, {title} AS title, CAST({team} AS VARCHAR) AS team, {location} AS location,
      CAST({employment} AS VARCHAR) AS employment_type, {url} AS url, CAST({description} AS VARCHAR) AS description_text, {posted} AS posted_at
    FROM postings_v"""


CAREERS = "'https://example.com/careers'"


@query(
    "greenhouse_postings",
    _sql(
        "CASE WHEN ordinal % 3 = 0 THEN title ELSE 'Untitled' END",
        "CASE ordinal % 3 WHEN 0 THEN location WHEN 1 THEN nullif(location, '') END",
        f"CASE WHEN ordinal % 3 < 2 THEN url ELSE {CAREERS} END",
        external="CASE WHEN ordinal % 3 < 2 THEN CAST(ordinal AS VARCHAR) END",
        description="CASE WHEN ordinal % 3 = 0 THEN description_text END",
        posted="CASE WHEN ordinal % 3 < 2 THEN posted_at END",
    ),
)
def greenhouse_postings(spark, d):
    item = variant3(
        F.struct(
            k().alias("id"), "title", F.struct(F.col("location").alias("name")).alias("location"),
            F.col("url").alias("absolute_url"), F.col("description_text").alias("content"), iso().alias("updated_at"),
        ),
        F.struct(
            k().alias("id"), F.lit("").alias("title"), F.col("location"), F.lit("").alias("absolute_url"), "url",
            seconds().alias("first_published"),
        ),
        F.struct(F.struct().alias("location"), F.lit("last week").alias("updated_at")),
    )
    return providers.greenhouse(sourced(spark, d, item, '{"jobs":[5,', "]}", "greenhouse")).select(OUT)


@query(
    "lever_postings",
    _sql(
        "CASE WHEN ordinal % 3 < 2 THEN title ELSE 'Untitled' END",
        "CASE ordinal % 3 WHEN 0 THEN location WHEN 1 THEN 'a, b, c, 4, e' END",
        f"CASE WHEN ordinal % 3 < 2 THEN url ELSE {CAREERS} END",
        team="CASE WHEN ordinal % 3 = 0 THEN team WHEN ordinal % 3 = 1 THEN '7' END",
        description="CASE ordinal % 3 WHEN 0 THEN nullif(description_text, '') WHEN 1 THEN description_text ELSE '' END",
    ),
)
def lever_postings(spark, d):
    millis = seconds() * 1000
    item = variant3(
        F.struct(
            k().alias("id"), F.col("title").alias("text"), F.struct("location", "team").alias("categories"),
            F.col("url").alias("hostedUrl"), F.col("description_text").alias("descriptionPlain"), millis.alias("createdAt"),
        ),
        F.struct(
            k().cast("string").alias("id"), "title", F.lit(0).alias("text"),
            F.parse_json(F.lit('{"location":["a","b","c",4,"e","f"],"team":7}')).alias("categories"),
            F.col("url").alias("applyUrl"), F.col("description_text").alias("description"), millis.alias("updatedAt"),
        ),
        F.struct(k().alias("id"), F.lit("").alias("descriptionPlain"), F.lit("").alias("description"), iso().alias("createdAt"), F.lit("x").alias("categories")),
    )
    return providers.lever(sourced(spark, d, item, "[", ",null]", "lever")).select(OUT)


@query(
    "ashby_postings",
    _sql(
        "title",
        "CASE ordinal % 3 WHEN 0 THEN location WHEN 1 THEN 'Springfield' ELSE nullif(location, '') END",
        f"CASE WHEN ordinal % 3 < 2 THEN url ELSE {CAREERS} END",
        team="team",
        employment="CASE WHEN ordinal % 3 = 0 THEN 'FullTime' END",
        description="CASE WHEN ordinal % 3 < 2 THEN nullif(description_text, '') END",
        posted="CASE WHEN ordinal % 3 < 2 THEN posted_at END",
    ),
)
def ashby_postings(spark, d):
    description = F.nullif("description_text", F.lit(""))
    item = variant3(
        F.struct(
            k().alias("id"), "title", F.lit("").alias("location"), F.col("location").alias("locationName"),
            F.col("url").alias("jobUrl"), description.alias("descriptionHtml"), "team",
            F.lit("FullTime").alias("employmentType"), iso().alias("publishedDate"),
        ),
        F.struct(
            k().alias("id"), "title", F.struct(F.struct(F.lit("Springfield").alias("name")).alias("primaryLocation")).alias("location"),
            "url", description.alias("description"), "team", iso().alias("updatedAt"),
        ),
        F.struct(k().alias("id"), "title", F.struct(F.col("location").alias("name"), F.lit(1).alias("n")).alias("location"), "team", seconds().alias("publishedDate")),
    )
    rows = postings(spark, d)
    boards = captures_of(rows, item, "[", "]", "ashby")
    wrapped = F.when(F.col("page_ordinal") % 2 == 0, F.concat(F.lit('{"jobs":'), "body", F.lit("}"))).otherwise(F.col("body"))
    return providers.ashby(providers.with_source(boards.withColumn("body", wrapped), companies(spark, d))).select(OUT)


@query(
    "workday_postings",
    _sql(
        "CASE WHEN ordinal % 3 < 2 THEN title ELSE 'Untitled' END",
        "CASE ordinal % 3 WHEN 0 THEN coalesce(location, 'fallback') WHEN 1 THEN 'Reno, Paris, Oslo' END",
        f"""CASE ordinal % 3 WHEN 0 THEN 'https://example.com/job/' || ordinal WHEN 1 THEN url ELSE {CAREERS} END""",
        external="CASE ordinal % 3 WHEN 0 THEN 'R' || ordinal WHEN 1 THEN CAST(ordinal AS VARCHAR) ELSE '0' END",
        description="CASE WHEN ordinal % 3 = 0 THEN nullif(description_text, '') END",
        posted="CASE ordinal % 3 WHEN 0 THEN posted_at + INTERVAL 1000000000 SECOND WHEN 1 THEN posted_at END",
    ),
)
def workday_postings(spark, d):
    item = variant3(
        F.struct(
            "title", F.concat(F.lit("//job/"), k().cast("string")).alias("externalPath"),
            F.when(F.col("location") != "", F.col("location")).alias("locationsText"),
            F.when(F.col("location").isNull(), F.lit("fallback")).otherwise(F.col("location")).alias("location"),
            F.array(F.concat(F.lit("R"), k().cast("string"))).alias("bulletFields"),
            ((seconds() + 1_000_000_000) * 1000).alias("postedOn"), F.col("description_text").alias("jobDescription"),
        ),
        F.struct(
            F.col("title").alias("name"), F.col("url").alias("externalUrl"), F.col("url"),
            F.parse_json(F.lit('["Reno",{"descriptor":"Paris","name":"x"},{"name":"Oslo"},{"name":""},3]')).alias("location"),
            F.array().cast("array<string>").alias("bulletFields"), k().alias("jobPostingId"), iso().alias("startDate"),
        ),
        F.struct(F.lit(0).alias("id"), F.lit("Posted Yesterday").alias("postedOn")),
    )
    return providers.workday(sourced(spark, d, item, '{"total":1,"jobPostings":[', "]}", "workday")).select(OUT)


@query(
    "smartrecruiters_postings",
    _sql(
        "title",
        "CASE ordinal % 3 WHEN 0 THEN concat_ws(', ', 'Austin', nullif(location, ''), 'US') WHEN 1 THEN location ELSE 'whole' END",
        """'https://jobs.smartrecruiters.com/co' || company_id || CASE ordinal % 3 WHEN 0 THEN '/ref' || ordinal WHEN 1 THEN '/posting/' || ordinal ELSE '/5' END""",
        external="CASE WHEN ordinal % 3 < 2 THEN CAST(ordinal AS VARCHAR) END",
        employment="CASE WHEN ordinal % 3 = 0 THEN 'Full-time' END",
    ),
)
def smartrecruiters_postings(spark, d):
    item = variant3(
        F.struct(
            k().cast("string").alias("id"), F.col("title").alias("name"),
            F.struct(F.lit("Austin").alias("city"), F.col("location").alias("region"), F.lit("US").alias("country")).alias("location"),
            F.concat(F.lit("ref"), k().cast("string")).alias("ref"), F.struct(F.lit("Full-time").alias("label")).alias("typeOfEmployment"),
            iso().alias("releasedDate"),
        ),
        F.struct(k().alias("uuid"), "title", "location", F.lit("").alias("ref"), seconds().alias("createdOn")),
        F.struct(
            "title", F.struct(F.lit("").alias("city"), F.lit("whole").alias("fullLocation")).alias("location"),
            F.lit(5).alias("refNumber"), F.lit("full").alias("typeOfEmployment"), iso().alias("postedDate"),
        ),
    )
    rows = sourced(spark, d, item, '{"content":[', "]}", "smartrecruiters")
    config = F.create_map(F.lit("company"), F.concat(F.lit("co"), F.col("company_id").cast("string")))
    return providers.smartrecruiters(rows.withColumn("source_config", config)).select(OUT)


@query(
    "description_cap",
    """SELECT CAST(doc_id AS VARCHAR) AS external_job_id, length(t) AS n, sha256(t) AS digest
    FROM (SELECT doc_id, substring(text, 1, 50000) AS t FROM documents)""",
)
def description_cap(spark, d):
    """Whole document texts as job contents."""
    rows = table(spark, d, "documents").select(
        ((F.col("doc_id") % 25) + 1).alias("company_id"), F.lit("2002-01-01").cast("timestamp").alias("cycle_ts"),
        F.col("doc_id").alias("ordinal"), "text",
    )
    item = F.to_json(F.struct(F.col("ordinal").alias("id"), F.col("text").alias("content")))
    bodies = captures_of(rows, item, '{"jobs":[', "]}", "greenhouse")
    found = providers.greenhouse(providers.with_source(bodies, companies(spark, d)))
    return found.select(
        "external_job_id", F.length("description_text").cast("bigint").alias("n"), F.sha2("description_text", 256).alias("digest")
    )


@query(
    "description_cut",
    """SELECT CAST(doc_id AS VARCHAR) AS external_job_id, length(text) AS n_whole, length(substring(text, 1, 1000)) AS n, sha256(substring(text, 1, 1000)) AS digest
    FROM documents""",
)
def description_cut(spark, d):
    """All documents as job contents, read with a cap of 1000 characters and with none."""
    rows = table(spark, d, "documents").select(
        ((F.col("doc_id") % 25) + 1).alias("company_id"), F.lit("2002-01-01").cast("timestamp").alias("cycle_ts"),
        F.col("doc_id").alias("ordinal"), "text",
    )
    item = F.to_json(F.struct(F.col("ordinal").alias("id"), F.col("text").alias("descriptionPlain")))
    bodies = captures_of(rows, item, "[", "]", "lever")
    cut, whole = (collect_postings(bodies, companies(spark, d), description_cap=cap) for cap in (1000, None))
    whole = whole.select("external_job_id", F.length("description_text").cast("bigint").alias("n_whole"))
    cut = cut.select("external_job_id", F.length("description_text").cast("bigint").alias("n"), F.sha2("description_text", 256).alias("digest"))
    return cut.join(whole, "external_job_id")


@query(
    "all_provider_postings",
    f"""WITH {sql_postings()} SELECT company_id, CASE company_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'ashby' END AS source_type,
      CAST(ordinal AS VARCHAR) AS external_job_id, title, url, posted_at FROM postings_v""",
)
def all_provider_postings(spark, d):
    """Every company's captures go to the branch of its source type; the outputs form one table."""
    rows = postings(spark, d)
    kinds = ["greenhouse", "lever", "ashby"]
    shapes = [
        (F.struct(k().alias("id"), "title", F.col("url").alias("absolute_url"), iso().alias("updated_at")), '{"jobs":[', "]}"),
        (F.struct(k().alias("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"), (seconds() * 1000).alias("createdAt")), "[", "]"),
        (F.struct(k().alias("id"), "title", F.col("url").alias("jobUrl"), iso().alias("publishedDate")), "[", "]"),
    ]
    bodies = None
    for i, (kind, (item, opening, closing)) in enumerate(zip(kinds, shapes)):
        part = captures_of(rows.filter(F.col("company_id") % 3 == i), F.to_json(item), opening, closing, kind)
        bodies = part if bodies is None else bodies.unionByName(part)
    source = F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 3 + 1).cast("int"))
    found = collect_postings(bodies, companies(spark, d).withColumn("source_type", source))
    return found.select("company_id", "source_type", "external_job_id", "title", "url", "posted_at")


@query(
    "validated_snapshots",
    f"""WITH {sql_postings()}, bad AS (SELECT company_id, min(p) AS p FROM (SELECT company_id,
        CASE WHEN ordinal % 1000 = 7 AND company_id < 5 THEN 'title: missing' WHEN company_id = 9 THEN 'team: longer than 512' END AS p
        FROM postings_v) WHERE p IS NOT NULL GROUP BY company_id)
    SELECT n_nationkey::BIGINT + 1 AS company_id, TIMESTAMP '2002-01-01' AS cycle_ts,
      CASE WHEN p IS NULL THEN 'ok' ELSE 'failed' END AS outcome, 'invalid posting: ' || p AS error
    FROM nation LEFT JOIN bad ON bad.company_id = n_nationkey + 1""",
)
def validated_snapshots(spark, d):
    """One bad posting fails its company's whole snapshot."""
    rows = postings(spark, d).withColumns(
        {
            "title": F.when(~((k() % 1000 == 7) & (F.col("company_id") < 5)), F.col("title")),
            "team": F.when(F.col("company_id") == 9, F.repeat(F.lit("x"), 513)).otherwise(F.col("team")),
        }
    )
    all_ok = companies(spark, d).select(
        F.col("id").alias("company_id"), F.lit("2002-01-01").cast("timestamp").alias("cycle_ts"),
        F.lit("ok").alias("outcome"), F.lit(None).cast("string").alias("error"),
    )
    return ingest.validate_postings(rows, all_ok)
