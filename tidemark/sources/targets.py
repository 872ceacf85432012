"""Company lists from files: the targets CSV and the companies JSON array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark import rules
from tidemark.functions import variants as V
from tidemark.functions.source_urls import careers_url_or_error, parse_bool
from tidemark.functions.text import strip

CONFIG = "map<string,string>"


def config_from_variant(document: Column) -> Column:
    """A JSON object as a map of texts; nested values stay JSON."""
    entries = F.try_variant_get(document, "$", "map<string,variant>")
    return F.transform_values(entries, lambda _, v: V.to_text(v))


def records(lines: DataFrame) -> DataFrame:
    """(file, record, text) of CSV lines (file, block, n, value), where a quoted field may hold line breaks.

    `block` is the file split a line stands in and n orders the lines of a split. A line begins a record
    if an even number of quotes stands before it in its file. So quotes are counted per split first,
    then records, and sums over the splits before tell each split's lines what came before them. A file
    is read by as many tasks as it has splits. Blank lines between records are none and do not count.
    """
    split = ["file", "block"]
    quoted = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    upto = lambda amount, window: F.coalesce(F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = Window.partitionBy("file").orderBy("block")
    quotes = quoted.groupBy(*split).agg(F.sum("quotes").alias("sum")).select(*split, upto("sum", splits).alias("before"))
    inside = Window.partitionBy(*split).orderBy("n")
    opened = quoted.join(quotes, split).withColumn("open", (F.col("before") + upto("quotes", inside)) % 2 == 1)
    opened = opened.where(F.col("open") | (F.trim(F.rtrim("value", F.lit("\r"))) != "")).withColumn("begins", (~F.col("open")).cast("int"))
    counts = opened.groupBy(*split).agg(F.sum("begins").alias("sum")).select(*split, upto("sum", splits).alias("earlier"))
    numbered = opened.join(counts, split).withColumn("record", F.col("earlier") + F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a line with all of its record needs no other
    whole = ~F.col("open") & (F.col("quotes") % 2 == 0)
    parts = numbered.where(~whole).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("parts"))
    joined = parts.select("file", "record", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("text"))
    return numbered.where(whole).select("file", "record", F.col("value").alias("text")).unionByName(joined).withColumn("text", F.rtrim("text", F.lit("\r")))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Raw target rows, all text, with `line_number` counting records from 2 within each file.

    Files share the columns of the first. Records are found in all splits of a file at once.
    """
    columns = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns
    missing = [c for c in rules.TARGET_COLUMNS if c not in columns]
    if missing:
        raise ValueError(f"CSV missing required columns: {', '.join(missing)}")
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value"
    )
    fields = F.from_csv("text", ", ".join(f"`{c}` string" for c in columns), {"quote": '"', "escape": '"', "multiLine": "true"})
    rows = records(lines).where(F.col("record") > 1).select(fields.alias("row"), F.col("record").cast("bigint").alias("line_number"))
    return rows.select(*(F.col("row")[c].alias(c) for c in rules.TARGET_COLUMNS), "line_number")


def parse_targets(raw: DataFrame) -> DataFrame:
    """Typed target rows with `row_error`, null for good rows."""
    clean = {c: strip(F.coalesce(c, F.lit(""))) for c in rules.TARGET_COLUMNS}
    config_text = clean["source_config_json"]
    document = V.parse(config_text)
    line = F.concat(F.lit("line "), F.col("line_number").cast("string"), F.lit(": "))
    error = (
        F.when(clean["name"] == "", F.lit("name is required"))
        .when(clean["careers_url"] == "", F.concat(F.lit("careers_url is required for '"), clean["name"], F.lit("'")))
        .when((config_text != "") & document.isNull(), F.lit("invalid source_config_json"))
        .when(
            (config_text != "") & ~V.is_kind(document, "OBJECT"), F.lit("source_config_json must be a JSON object")
        )
    )
    return raw.select(
        *[clean[c].alias(c) for c in ("name", "category", "source_list", "careers_url")],
        F.lower(clean["source_type"]).alias("source_type"),
        F.coalesce(config_from_variant(document), F.create_map().cast(CONFIG)).alias("source_config"),
        clean["priority"].alias("priority"),
        parse_bool(clean["enabled"]).alias("enabled"),
        "line_number",
        F.concat(line, error).alias("row_error"),
    )


def split_targets(parsed: DataFrame, on_bad_row: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects). `fail` raises the error of the first bad line, `quarantine` goes on."""
    rejects = parsed.filter(F.col("row_error").isNotNull())
    if on_bad_row == "fail":
        first = rejects.orderBy("line_number").select("row_error").limit(1).collect()
        if first:
            raise ValueError(first[0]["row_error"])
    elif on_bad_row != "quarantine":
        raise ValueError("on_bad_row is 'fail' or 'quarantine'")
    return parsed.filter(F.col("row_error").isNull()).drop("row_error"), rejects


def read_companies_json(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of companies, ready for `upsert_companies`.

    The careers url is derived where absent; `enabled` is null where the key is absent.
    """
    files = spark.read.text(path, wholetext=True).select(V.parse(F.col("value")).alias("doc"))
    if files.filter(~V.is_kind(F.col("doc"), "ARRAY")).limit(1).count():
        raise ValueError("companies.json must be a JSON array")
    items = files.select(F.posexplode(V.elements(F.col("doc"))).alias("pos", "item"))
    return company_rows(items)


def company_rows(items: DataFrame) -> DataFrame:
    """(pos, item VARIANT) to import rows; `row_error` names a key or setting that is missing."""
    item = F.col("item")
    kind, config = V.to_text(V.field(item, "source_type")), config_from_variant(V.field(item, "source_config"))
    given, enabled = V.field(item, "careers_url"), V.field(item, "enabled")
    derived = careers_url_or_error(kind, config)
    return items.select(
        V.to_text(V.field(item, "name")).alias("name"),
        F.when(V.truthy(given), V.to_text(given)).otherwise(derived["url"]).alias("careers_url"),
        kind.alias("source_type"),
        config.alias("source_config"),
        F.when(enabled.isNotNull(), V.truthy(enabled)).alias("enabled"),
        F.lit(None).cast("string").alias("last_error"),
        (F.col("pos") + 1).cast("bigint").alias("ordinal"),
        F.when(~V.truthy(given), derived["error"]).alias("row_error"),
    )
