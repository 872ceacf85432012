"""Content-addressed WARC archive: payload bytes once by digest, record headers apart.

An archive is a folder of two tables. `payloads` has each distinct payload once under its SHA-256.
`headers` has one row per record: the exact header block and the digest of its payload. Joining
the two gives records back, byte for byte; a payload whose digest does not verify fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"


def payload(html: Column | str) -> Column:
    """UTF-8 bytes; none for null."""
    return F.encode(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")), "UTF-8")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def header_block(revisit: Column, date: str) -> Column:
    """The header block of a record, without the blank line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    return F.concat_ws(
        BREAK,
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("_owner")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("_bytes")).cast("string")),
    )


def write_archive(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, date: str = "2026-01-01T00:00:00Z") -> None:
    """Archives `pages` (page_id, url, html) into `folder`, which must be new.

    Of records with equal payloads of at least `revisit_bytes` bytes, those with the largest page_id
    are responses and the others revisit it; smaller payloads are all responses. A null html is an
    empty payload, a null url leaves out its header line. Rows repeating the largest id are all
    responses. A row without id revisits the largest id there is, else it is a response.

    Copies of a payload meet as one row per task before the shuffle.
    """
    rows = pages.select("page_id", "url", payload("html").alias("_payload")).withColumns(
        {"digest": F.sha2("_payload", 256), "_sha1": F.sha1("_payload"), "_bytes": F.length("_payload").cast("long")}
    )
    stored = rows.groupBy("digest").agg(F.first("_payload").alias("payload"))
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    owners = rows.where(F.col("_bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("_owner"), F.count("*").alias("_n"))
    # one row per payload that has revisits
    owners = owners.where((F.col("_n") > 1) & F.col("_owner").isNotNull()).drop("_n")
    records = rows.drop("_payload").join(owners, "digest", "left")
    revisit = F.col("_owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_owner"))
    records.select("digest", header_block(revisit, date).alias("header")).write.option("compression", "zstd").parquet(f"{folder}/headers")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(header, digest, payload) of each record; a revisit has the payload it refers to.

    Each payload is verified against its digest once, before the join.
    """
    headers = spark.read.schema("digest string, header string").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("digest"))).cast("binary"))
    return headers.join(payloads.select("digest", checked.alias("payload")), "digest", "left")


def field(name: str) -> Column:
    """A header's value, null where the record has no such line."""
    found = F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(F.col("header").contains(f"\r\n{name}: "), found)


def record_bytes(records: DataFrame) -> DataFrame:
    """`records` with `record`, the bytes as they stand in a WARC file: header, blank line, body, two breaks."""
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    head = F.encode(F.concat(F.col("header"), F.lit(2 * BREAK)), "UTF-8")
    return records.withColumn("record", F.concat(head, body, F.lit((2 * BREAK).encode())))


def index(records: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), all from the records read."""
    number = lambda value: F.try_element_at(F.split(F.regexp_replace(value, "[<>]", ""), ":"), F.lit(3)).try_cast("long")
    return records.select(
        number(field("WARC-Record-ID")).alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number(field("WARC-Refers-To")).alias("refers_to"),
    )
