"""Tool calls of conversations, linked to their results.

Calls and results are each reduced to one row per conversation and identifier, hash-joined,
ordered by what they depend on, checked against the tools' schemas, and written as canonical
JSON: keys sorted, no white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelwise.llm.scratch import settle

#: A parameter of a tool: name, type (string, integer, number, boolean, array, object), required.
Param = tuple[str, str, bool]

_KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
          "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}
_KEY = ["conv_id", "call_id"]
_ONE = "id string, name string, arguments string, after array<string>"
_CALL = (f"{_ONE}, function struct<name:string, arguments:string>, tool_calls array<struct<"
         "id:string, name:string, arguments:string, after:array<string>,"
         " function:struct<name:string, arguments:string>>>")
_RESULT = "id string, tool_call_id string, content string"


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no white space; null if it is not JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def json_string(text: Column) -> Column:
    """A JSON string, or null."""
    quoted = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a table (conv_id, turn, role, text).

    A turn of the assistant that is a JSON object is a call if it has a name, or a function
    with one, and several calls if it has a list `tool_calls` of such; arguments may be JSON
    or a string of JSON. A turn of role tool is a result, of the call that its `tool_call_id`
    or `id` names; without JSON, of the first call in the turn before it. Of the plain turns,
    a user's is a call of the tool `answer`, after the turn two before if that is a user's
    as well, and an assistant's is the result of the turn before it if that is a user's.
    Results that belong to no call have no identifier. Other roles are neither.
    """
    text, nothing = F.col("text"), F.array().cast("array<string>")
    object_ = F.ltrim(text).startswith("{")
    c = F.when((F.col("role") == "assistant") & object_, F.from_json(text, _CALL))
    r = F.when((F.col("role") == "tool") & object_, F.from_json(text, _RESULT))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text",
                        c.alias("c"), r.alias("r"))

    def one(x: Column) -> Column:
        return F.struct(
            x["id"].alias("id"), F.coalesce(x["function"]["name"], x["name"]).alias("name"),
            F.coalesce(x["function"]["arguments"], x["arguments"]).alias("arguments"),
            F.coalesce(x["after"], nothing).alias("after"))

    listed = F.coalesce(F.transform("c.tool_calls", one), F.array(one(F.col("c"))))
    own = F.filter(listed, lambda x: x["name"].isNotNull())
    rows = rows.withColumn("own", F.coalesce(own, F.array().cast(
        "array<struct<id:string,name:string,arguments:string,after:array<string>>>")))
    user, made = F.col("role") == "user", F.size("own") > 0
    # What the one and two turns before are, by a hash join of one row per turn.
    seen = rows.filter(user | made).groupBy("conv_id", "turn").agg(
        F.max(user).alias("user"), F.min(F.get("own", F.lit(0))["id"]).alias("id"))
    prior = settle(seen.filter("turn is not null"))
    for back in (1, 2):
        rows = rows.join(prior.select(
            F.col("conv_id").alias("p_conv"), (F.col("turn") + back).alias("p_turn"),
            F.col("user").alias(f"user{back}"), F.col("id").alias(f"id{back}")),
            (F.col("conv_id") == F.col("p_conv")) & (F.col("turn") == F.col("p_turn")), "left"
        ).drop("p_conv", "p_turn")
    before = F.when(F.col("user2"), F.array((F.col("turn") - 2).cast("string"))).otherwise(nothing)
    prompt = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt")))
    plain = F.array(F.struct(
        F.col("turn").cast("string").alias("id"), F.lit("answer").alias("name"),
        prompt.alias("arguments"), before.alias("after")))
    call = F.when(user, plain).otherwise(F.col("own"))
    calls = rows.filter(user | made).select("conv_id", "turn", F.explode(call).alias("x")).select(
        "conv_id", "turn", F.col("x.id").alias("call_id"), F.col("x.name").alias("tool"),
        F.col("x.arguments").alias("arguments"), F.col("x.after").alias("after"))
    told = F.col("role") == "tool"
    answered = F.when(F.col("user1"), (F.col("turn") - 1).cast("string"))
    id_ = F.coalesce("r.tool_call_id", "r.id")
    results = rows.filter(told | ((F.col("role") == "assistant") & ~made)).select(
        "conv_id", "turn",
        F.when(told, F.coalesce(id_, "id1")).otherwise(answered).alias("call_id"),
        F.when(told & id_.isNotNull(), F.col("r.content")).otherwise(text).alias("content"))
    return calls, results


def argument_errors(tool: Column, arguments: Column, schemas: dict[str, list[Param]]) -> Column:
    """Sorted array of what a call's arguments (canonical JSON) have against the schema."""
    value = F.try_parse_json(arguments)
    found = F.when(~tool.isin(*schemas) | tool.isNull(), F.array(F.lit("unknown tool")))
    for name, params in schemas.items():
        checks = []
        for param, kind, required in params:
            own = F.try_variant_get(value, f"$.{param}", "variant")
            is_ = F.coalesce(F.schema_of_variant(own), F.lit("VOID"))
            absent = F.coalesce(is_ == "VOID", F.lit(True))
            wrong = ~is_.rlike(f"^({_KINDS[kind]})$")
            checks.append(F.when(absent, F.lit(f"missing {param}") if required else F.lit(None))
                          .when(wrong, F.lit(f"type {param}")))
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        extra = F.transform(
            F.array_except(keys, F.array(*(F.lit(p[0]) for p in params)).cast("array<string>")),
            lambda k: F.concat(F.lit("unknown "), k))
        found = found.when(tool == name, F.concat(F.array_compact(F.array(*checks).cast(
            "array<string>")), extra))
    return F.when(arguments.isNull(), F.array(F.lit("no JSON"))).otherwise(F.array_sort(found))


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest way back to a call that comes after none.

    Calls on a circle, or behind one, get no row. Calls that lie 2, 4, 8.. steps back are
    found by joining such tables with themselves; a level is then put together from the
    longest stretch down. Rounds grow with the logarithm of the longest chain. The tables
    hold, per call, the different calls so many steps back: one in a plain chain.
    """
    links = calls.select(*_KEY, F.explode(F.array_distinct("after")).alias("before"))
    known = calls.select("conv_id", F.col("call_id").alias("before"))
    back = [settle(links.join(known, ["conv_id", "before"], "left_semi"))]
    # A way of as many steps as a conversation has calls leads over a circle.
    most = calls.groupBy("conv_id").count().agg(F.max("count")).head()[0] or 0
    while not back[-1].isEmpty() and 1 << (len(back) - 1) < most:
        far = back[-1].withColumnRenamed("call_id", "via").withColumnRenamed("before", "far")
        near = back[-1].withColumnRenamed("before", "via")
        back.append(settle(near.join(far, ["conv_id", "via"]).select(
            *_KEY, F.col("far").alias("before")).distinct()))
    found = calls.select(*_KEY, F.col("call_id").alias("at"), F.lit(0).alias("level"))
    for k in reversed(range(len(back))):
        on = found.join(back[k].withColumnRenamed("call_id", "at"), ["conv_id", "at"])
        on = settle(on.select(*_KEY, F.col("before").alias("at"),
                              (F.col("level") + (1 << k)).alias("level")).distinct())
        rest = found.join(on.select(*_KEY).distinct(), _KEY, "left_anti")
        found = settle(on.union(rest.select(*on.columns)))
    return found.filter(F.col("level") < most).select(*_KEY, "level").distinct()


def link_calls(
    calls: DataFrame, results: DataFrame, schemas: dict[str, list[Param]]
) -> DataFrame:
    """(conv_id, call_id, call_turn, result_turn, n_calls, n_results, level, status, errors,
    json), one row per conversation and identifier, and one per row that lacks either.

    calls are (conv_id, turn, call_id, tool, arguments, after), results (conv_id, turn,
    call_id, content). Of several calls or results of one identifier the earliest counts
    (ties: the least by its content), and n_calls and n_results tell of the others. level
    orders a conversation's calls after those they depend on; null on a circle. status is
    orphan (a result alone), unlinked (no conversation or identifier), invalid (errors is not
    empty, or a call it comes after is missing, or a circle), unanswered, or ok. json holds
    arguments, id, name and result. Texts of any length, empty ones too, are kept whole.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    call = F.struct("turn", "tool", canonical(F.col("arguments")).alias("arguments"), "after")
    result = F.struct("turn", "content")
    first = settle(calls.filter(named).withColumn("c", call).groupBy(*_KEY).agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n_calls")))
    answer = results.filter(named).withColumn("r", result).groupBy(*_KEY).agg(
        F.min("r").alias("r"), F.count(F.lit(1)).alias("n_results"))
    graph = first.select(*_KEY, F.col("c.after").alias("after"))
    levels = settle(call_levels(graph))
    missing = graph.select(*_KEY, F.explode("after").alias("before")).join(
        first.select("conv_id", F.col("call_id").alias("before")), ["conv_id", "before"],
        "left_anti").groupBy(*_KEY).agg(F.lit(True).alias("lost"))
    rows = first.join(answer, _KEY, "full").join(levels, _KEY, "left").join(
        settle(missing), _KEY, "left")
    unlinked = calls.filter(~named).select(
        *_KEY, call.alias("c"), F.lit(None).cast(rows.schema["r"].dataType).alias("r"),
        F.lit(1).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"))
    unlinked = unlinked.union(results.filter(~named).select(
        *_KEY, F.lit(None).cast(rows.schema["c"].dataType), result,
        F.lit(0).cast("long"), F.lit(1).cast("long")))
    rows = rows.select(*_KEY, "c", "r", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
                       F.coalesce("n_results", F.lit(0)).alias("n_results"), "level", "lost")
    rows = rows.union(unlinked.withColumn("level", F.lit(None).cast("int")).withColumn(
        "lost", F.lit(None).cast("boolean")))
    errors = F.when(F.col("c").isNotNull(), F.concat(
        argument_errors(F.col("c.tool"), F.col("c.arguments"), schemas),
        F.when(F.col("lost"), F.array(F.lit("missing call"))).otherwise(
            F.array().cast("array<string>")),
        F.when(named & F.col("level").isNull(), F.array(F.lit("circle"))).otherwise(
            F.array().cast("array<string>"))))
    status = (
        F.when(~named, "unlinked").when(F.col("c").isNull(), "orphan")
        .when(F.size("errors") > 0, "invalid").when(F.col("r").isNull(), "unanswered")
        .otherwise("ok"))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce("c.arguments", F.lit("null")),
        F.lit(',"id":'), json_string(F.col("call_id")),
        F.lit(',"name":'), json_string(F.col("c.tool")),
        F.lit(',"result":'), json_string(F.col("r.content")), F.lit("}"))
    return rows.withColumn("errors", errors).select(
        *_KEY, F.col("c.turn").alias("call_turn"), F.col("r.turn").alias("result_turn"),
        "n_calls", "n_results", "level", status.alias("status"),
        F.concat_ws(";", "errors").alias("errors"), json.alias("json"))
