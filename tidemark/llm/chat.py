"""Chat formatting with linked tool calls, as DataFrame operations.

Calls meet their results in a hash join on the identifier. A call may come after another call; chains
are followed by doubling, so a chain of n calls takes log2(n) joins. Messages are ordered by depth,
then turn. Arguments are checked against the tool's schema field by field, and each message is
written as canonical JSON: keys sorted, no blanks, nulls left out.

Messages stay one row each, so no conversation, however long, is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.frames import staged


def canonical(value: Column) -> Column:
    """Canonical JSON of a string map: sorted keys, no blanks; null for null."""
    entries = F.array_sort(F.map_entries(value))
    parts = F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.coalesce(json_text(e["value"]), F.lit("null"))))
    return F.when(value.isNotNull(), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def json_text(value: Column) -> Column:
    """A JSON string of any text."""
    listed = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, cyclic) of `calls` (conv_id, call_id, after), ids unique.

    A call whose predecessor is null or unknown has depth 0. Calls on or behind a cycle have no
    place in a topological order: depth null, cyclic true.
    """
    known = calls.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_id"))
    # a call without predecessor gets a key of its own, so that such calls do not meet in one task
    key = F.coalesce("after", F.concat(F.lit("\0"), F.xxhash64("call_id").cast("string")))
    links = calls.withColumn("_key", key).join(known, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_key") == F.col("_id")), "left").select(
        "conv_id", "call_id", F.col("_id").alias("to"), F.when(F.col("_id").isNotNull(), 1).otherwise(0).cast("long").alias("steps")
    )
    links = staged(links, "chains")
    total, reached = links.count(), 1
    # after k rounds a link spans 2**k calls; one that still goes on after all calls were spanned is in a cycle
    while reached <= total and links.where(F.col("to").isNotNull()).limit(1).count():
        far = links.select(F.col("conv_id").alias("_conv"), F.col("call_id").alias("_from"), F.col("to").alias("_to"), F.col("steps").alias("_steps"))
        near = links.withColumn("_key", F.coalesce("to", F.concat(F.lit("\0"), F.xxhash64("call_id").cast("string"))))
        joined = near.join(far, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_key") == F.col("_from")), "left")
        links = staged(
            joined.select("conv_id", "call_id", F.col("_to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")), "chains"
        )
        reached *= 2
    open_ = F.col("to").isNotNull()
    return links.select("conv_id", "call_id", F.when(~open_, F.col("steps")).alias("depth"), open_.alias("cyclic"))


def argument_errors(arguments: Column, schema: Column) -> Column:
    """Names of arguments that break `schema` (map of name to "type" or "type?"), sorted.

    An argument fails if it is missing and not optional, unknown, or not of its type: integer,
    number, boolean or string. A null schema (unknown tool) fails all there are, as "*".
    """
    fits = lambda kind, value: (
        F.when(kind == "integer", value.rlike(r"^-?(0|[1-9][0-9]*)$"))
        .when(kind == "number", value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
        .when(kind == "boolean", value.isin("true", "false"))
        .otherwise(kind == "string")
    )
    given = F.coalesce(arguments, F.create_map().cast("map<string,string>"))
    wrong = F.filter(
        F.map_keys(schema),
        lambda k: F.when(F.element_at(given, k).isNull(), ~F.element_at(schema, k).endswith("?")).otherwise(
            ~fits(F.regexp_replace(F.element_at(schema, k), r"\?$", ""), F.element_at(given, k))
        ),
    )
    unknown = F.filter(F.map_keys(given), lambda k: ~F.array_contains(F.map_keys(schema), k))
    return F.when(schema.isNull(), F.array(F.lit("*"))).otherwise(F.array_sort(F.concat(wrong, unknown)))


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Messages in order, with calls and results linked and checked.

    `messages`: conv_id, turn, role, text, call_id, kind ("text", "call", "result"), tool, arguments
    (map<string,string>), after (call_id of an earlier call). `schemas`: tool, schema.

    Adds n_calls and n_results (of the id in the conversation), linked (a call has a result, a result
    has a call), errors (of a call's arguments), depth, cyclic and message (canonical JSON). A message
    is at the depth of its call, a result half a step later in `place`; plain texts stay at depth 0.
    Sorting by (conv_id, place nulls last, turn) gives the topological order. Null ids link nothing. Of an id
    called twice both rows count as linked, and the chain of the id follows its smallest `after`.
    Null roles, tools and texts are left out of the JSON. Repeated rows stay.
    """
    messages = staged(messages.select("conv_id", "turn", "role", "text", "call_id", "kind", "tool", "arguments", "after"), "messages")
    named = messages.where(F.col("call_id").isNotNull() & F.col("kind").isin("call", "result"))
    is_call = F.col("kind") == "call"
    ids = named.groupBy("conv_id", "call_id").agg(
        F.count_if(is_call).alias("n_calls"), F.count_if(~is_call).alias("n_results"), F.min(F.when(is_call, F.col("after"))).alias("after")
    )
    ids = staged(ids, "call-ids")
    deep = depths(ids.where(F.col("n_calls") > 0).select("conv_id", "call_id", "after"))
    facts = ids.drop("after").join(
        deep.withColumnsRenamed({"conv_id": "_c", "call_id": "_i"}), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i")), "left"
    ).drop("_c", "_i")
    facts = facts.withColumnsRenamed({"conv_id": "_c", "call_id": "_i"})
    # rows that link nothing get keys of their own, so that those of a long conversation do not meet in one task
    own = F.concat(F.lit("\0"), F.xxhash64("turn", "text", "tool").cast("string"))
    key = F.when(F.col("kind").isin("call", "result") & F.col("call_id").isNotNull(), F.col("call_id")).otherwise(own)
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_key") == F.col("_i"))
    rows = messages.withColumn("_key", key).join(facts.hint("shuffle_hash"), on, "left").drop("_c", "_i", "_key")
    tools = schemas.groupBy("tool").agg(F.first("schema").alias("schema")).withColumnRenamed("tool", "_tool")
    rows = rows.join(tools, (F.col("tool") == F.col("_tool")) & is_call, "left").drop("_tool")
    role = F.col("kind")
    fields = {
        "arguments": F.when(role == "call", F.coalesce(canonical(F.col("arguments")), F.lit("{}"))),
        "content": F.when(role == "call", None).otherwise(json_text(F.col("text"))),
        "name": F.when(role == "call", json_text(F.col("tool"))),
        "role": json_text(F.col("role")),
        "tool_call_id": F.when(role.isin("call", "result"), json_text(F.col("call_id"))),
    }
    parts = F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()))
    return rows.select(
        "conv_id", "turn", "role", "kind", "call_id",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"),
        F.coalesce((F.col("n_calls") > 0) & (F.col("n_results") > 0), F.lit(False)).alias("linked"),
        F.when(is_call, argument_errors(F.col("arguments"), F.col("schema"))).alias("errors"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "depth",
        F.when(F.coalesce(F.col("kind"), F.lit("text")).isin("call", "result"), 2 * F.col("depth") + F.when(role == "result", 1).otherwise(0)).otherwise(0).cast("long").alias("place"),
        F.concat(F.lit("{"), parts, F.lit("}")).alias("message"),
    )
