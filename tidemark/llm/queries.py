"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import chat, decontaminate, fill_middle, jaccard, language, line_dedup, line_rules, mixing, rule_ensemble, spelling, toxicity, warc, wrapper
from tidemark.llm.frames import table
from tidemark.llm.oracles import ORACLES  # noqa: F401
from tidemark.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived and read back."""
    folder = f"{shared_folder(spark)}/llm/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    return warc.index(warc.read_records(spark, folder))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document left and removed, with a digest of the text left."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean(table(spark, sf_dir, "documents")).drop("cleaned")


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), with_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# what a turn of the test table asks for, and which fields the tools take
TOOLS = {"lookup": {"words": "integer", "topic": "string"}, "count": {"words": "integer", "exact": "boolean?"}, "translate": {"topic": "string", "to": "string"}}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations with the tool traffic that their turns stand for, since the table itself has none.

    A user's turn also makes a call, named after the turn, and the assistant's turn that follows is
    its result. A call comes after the call of the last user turn before it. Calls of the tool
    `translate` lack a field, and some results come without a call.
    """
    turn, words = F.col("turn"), F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"))
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), (F.pmod(F.floor(turn / 2), F.lit(3)) + 1).cast("int"))
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    topic = F.coalesce("text", F.lit(""))
    arguments = F.when(
        tool == "lookup", F.create_map(F.lit("topic"), topic, F.lit("words"), words.cast("string"))
    ).when(tool == "count", F.create_map(F.lit("words"), words.cast("string"))).otherwise(F.create_map(F.lit("topic"), topic))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    base = conversations.select("conv_id", "turn", "role", "text")
    nothing = F.lit(None).cast("string")
    texts = base.withColumns({"call_id": nothing, "kind": F.lit("text"), "tool": nothing, "arguments": F.lit(None).cast("map<string,string>"), "after": nothing})
    calls = base.where(user).withColumns(
        {"role": F.lit("assistant"), "text": nothing, "call_id": name(turn), "kind": F.lit("call"), "tool": tool, "arguments": arguments, "after": name(turn - 2)}
    )
    results = base.where(answer).withColumns(
        {"role": F.lit("tool"), "call_id": name(turn - 1), "kind": F.lit("result"), "tool": nothing, "arguments": F.lit(None).cast("map<string,string>"), "after": nothing}
    )
    return texts.unionByName(calls).unionByName(results)


@query
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's messages with linked, ordered and checked tool calls."""
    tools = [F.struct(F.lit(t).alias("tool"), F.create_map(*(F.lit(x) for kv in s.items() for x in kv)).alias("schema")) for t, s in TOOLS.items()]
    schemas = spark.range(1).select(F.inline(F.array(*tools)))
    linked = chat.link(tool_messages(table(spark, sf_dir, "conversations")), schemas)
    return linked.withColumn("errors", F.array_join("errors", ","))


@query
def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages"))


@query
def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


@query
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form and cuts, with digests of the output and of the text rebuilt from it."""
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
