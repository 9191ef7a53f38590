"""Tool-call linking in conversations, in DataFrame expressions only.

Messages carry tool calls and results as JSON. Calls and results of a conversation are
joined by their identifier, after results have been summed up per identifier, so that a
call meets one row. Calls may name others whose results they need; a call's level is one
more than the highest level it needs, and (level, turn, index) is an order in which
every call comes after what it needs. Arguments are checked against the schema of the
tool, and each call is written with its result as canonical JSON: keys sorted, no spaces.

No conversation is gathered in one task, so one that holds most messages does no harm.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postpulse.llm.storage import stored, table

CALLS = ("struct<tool_calls: array<struct<id: string, name: string, arguments: string, "
         "after: array<string>>>>")
RESULT = "struct<tool_call_id: string, content: string>"

# Schemas of tools: arguments with their type and whether they are required.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE",
    "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*",
}
CHAT_TOOLS: Schemas = {
    "configure": {"instructions": ("string", True)},
    "answer": {"question": ("string", True), "turn": ("integer", True)},
}


# --- parsing ------------------------------------------------------------------
def calls_of(messages: DataFrame) -> DataFrame:
    """A row for each tool call in messages of assistants: ``conv_id``, ``turn``,
    ``index``, ``call_id``, ``name``, ``arguments`` (JSON) and ``after``."""
    parsed = F.from_json("text", CALLS)["tool_calls"]
    rows = messages.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode(parsed).alias("index", "c"))
    return rows.select(
        "conv_id", "turn", "index", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"), F.array_distinct(
            F.coalesce("c.after", F.array().cast("array<string>"))).alias("after"))


def results_of(messages: DataFrame) -> DataFrame:
    """A row for each message of a tool: ``conv_id``, ``turn``, ``call_id``, ``content``."""
    parsed = F.from_json("text", RESULT)
    return messages.filter(F.col("role") == "tool").select(
        "conv_id", "turn", parsed["tool_call_id"].alias("call_id"),
        parsed["content"].alias("content"))


# --- order --------------------------------------------------------------------
def with_levels(calls: DataFrame) -> DataFrame:
    """Add ``level`` (null in and behind cycles) and ``unknown``, how many identifiers
    in ``after`` no call of the conversation has.

    Takes one round per level; each passes only identifiers.
    """
    ids = calls.groupBy("conv_id", "call_id").agg(F.lit(True).alias("known"))
    needs = stored(calls.select(
        "conv_id", "call_id", F.explode("after").alias("need")).distinct(), "needs")
    other = ids.select(F.col("conv_id").alias("c"), F.col("call_id").alias("need_id"), "known")
    found = needs.join(
        other, needs["conv_id"].eqNullSafe(other["c"]) & (needs["need"] == other["need_id"]), "left")
    found = stored(found.select("conv_id", "call_id", "need", F.coalesce(
        "known", F.lit(False)).alias("known")), "found-needs")
    unknown = found.groupBy("conv_id", "call_id").agg(
        F.sum(F.when(F.col("known"), 0).otherwise(1)).alias("unknown"),
        F.sum(F.when(F.col("known"), 1).otherwise(0)).alias("open"))
    # Calls without known needs are on level 0; only the others take part in the rounds.
    waiting = stored(found.filter("known").select("conv_id", "call_id", "need"), "waiting")
    sizes = waiting.groupBy("conv_id", "call_id").agg(F.count("*").alias("open"))
    levels = waiting.sparkSession.createDataFrame([], "conv_id {}, call_id string, level int".format(
        dict(calls.dtypes)["conv_id"]))
    count = 0
    while True:
        step = levels.select(F.col("conv_id").alias("c"), F.col("call_id").alias("need_id"), "level")
        behind = sizes.select(F.col("conv_id").alias("w"), F.col("call_id").alias("w_id"), "open")
        reached = waiting.join(
            behind, waiting["conv_id"].eqNullSafe(behind["w"]) & (waiting["need"] == behind["w_id"]),
            "left").select(waiting["conv_id"], waiting["call_id"], "need", F.when(
                F.col("open").isNull(), F.lit(0)).alias("at_once"))
        reached = reached.join(
            step, reached["conv_id"].eqNullSafe(step["c"]) & (reached["need"] == step["need_id"]),
            "left").select(reached["conv_id"], reached["call_id"],
                           F.coalesce("at_once", "level").alias("below"))
        counted = reached.groupBy("conv_id", "call_id").agg(
            F.count("*").alias("n"), F.count("below").alias("ready"), F.max("below").alias("top"))
        levels = stored(counted.filter("n = ready").select(
            "conv_id", "call_id", (F.col("top") + 1).alias("level")), "levels")
        now = levels.count()
        if now == count:
            break
        count = now
    facts = unknown.join(
        levels.withColumnsRenamed({"conv_id": "c", "call_id": "l_id"}),
        unknown["conv_id"].eqNullSafe(F.col("c")) & (unknown["call_id"] == F.col("l_id")), "left"
    ).select(unknown["conv_id"].alias("f_conv"), unknown["call_id"].alias("f_id"), "unknown",
             F.when(F.col("open") == 0, F.lit(0)).otherwise(F.col("level")).alias("f_level"))
    facts = stored(facts, "facts")
    joined = calls.join(facts, calls["conv_id"].eqNullSafe(F.col("f_conv"))
                        & (calls["call_id"] == F.col("f_id")), "left")
    return joined.select(
        *[calls[c] for c in calls.columns],
        F.when(F.col("f_id").isNull(), F.lit(0)).otherwise(F.col("f_level")).alias("level"),
        F.coalesce("unknown", F.lit(0)).alias("unknown"))


# --- arguments ----------------------------------------------------------------
def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with the arguments of a call, as a sorted array of strings."""
    value = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    none = F.array().cast("array<string>")
    errors = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        checks = []
        for field, (kind, required) in fields.items():
            own = F.try_variant_get(value, f"$.{field}", "variant")
            absent = own.isNull() | F.is_variant_null(own)
            fits = F.regexp_like(F.schema_of_variant(own), F.lit(f"^(?:{TYPES[kind]})$"))
            checks.append(F.when(absent, F.lit(f"{field}: missing") if required else F.lit(None))
                          .when(~fits, F.lit(f"{field}: no {kind}")))
        extra = F.transform(F.array_except(keys, F.array(*map(F.lit, fields)) if fields else none),
                            lambda k: F.concat(k, F.lit(": unknown")))
        found = F.when(keys.isNull(), F.array(F.lit("no JSON object"))).otherwise(
            F.sort_array(F.concat(F.array_compact(F.array(*checks) if checks else none), extra)))
        errors = F.when(name == tool, found).otherwise(errors)
    return errors


def canonical(**fields: Column) -> Column:
    """A JSON object with sorted keys and nulls written out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]),
                     {"ignoreNullFields": "false"})


# --- linking ------------------------------------------------------------------
def link_tool_calls(messages: DataFrame, schemas: Schemas) -> DataFrame:
    """A row per tool call of ``messages`` (``conv_id``, ``turn``, ``role``, ``text``).

    ``level`` orders calls by what they need; ``n_results`` counts the results with the
    call's identifier and ``result_turn`` is the first one's; ``errors`` names what is
    wrong; ``valid`` says that nothing is; ``message`` is canonical JSON.

    Messages that are null, no JSON or of other roles have no calls. A call without
    identifier has no results. Repeated calls are rows of their own and share results.
    Null conversations are one conversation. Other columns are ignored.
    """
    source = messages.select("conv_id", "turn", "role", "text")
    calls = with_levels(stored(calls_of(source), "calls"))
    summed = results_of(source).groupBy("conv_id", "call_id").agg(
        F.count("*").alias("n_results"),
        F.min(F.struct("turn", "content")).alias("first"),
    ).withColumnsRenamed({"conv_id": "r_conv", "call_id": "r_id"})
    linked = calls.join(summed, calls["conv_id"].eqNullSafe(F.col("r_conv"))
                        & (calls["call_id"] == F.col("r_id")), "left")
    checks = [
        argument_errors(F.col("name"), F.col("arguments"), schemas),
        F.array_compact(F.array(
            F.when(F.col("call_id").isNull(), F.lit("no identifier")),
            F.when(F.col("level").isNull(), F.lit("needs itself")),
            F.when(F.col("unknown") > 0, F.lit("needs an unknown call")),
            F.when(F.col("n_results") > 1, F.lit("several results")),
            F.when(F.col("first.turn") <= F.col("turn"), F.lit("result before call")))),
    ]
    errors = F.coalesce(reduce(F.concat, checks), F.array(F.lit("no name")))
    staged = linked.withColumn("errors", errors)
    value = F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.lit("null")))
    return staged.select(
        "conv_id", "turn", F.col("index").cast("long").alias("index"), "call_id", "name",
        F.col("level").cast("long").alias("level"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.col("first.turn").alias("result_turn"),
        F.array_join("errors", "; ").alias("errors"), (F.size("errors") == 0).alias("valid"),
        canonical(arguments=value, id=F.col("call_id"), name=F.col("name"),
                  result=F.col("first.content")).alias("message"))


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as messages with tool calls.

    What a system turn says configures the assistant and what a user says asks it: both
    become calls, named after their turn, and a question needs the call of turn 0. The
    next assistant turn is the result of a question.
    """
    name = F.concat(F.lit("call-"), F.coalesce(F.col("turn").cast("string"), F.lit("none")))
    none = F.array().cast("array<string>")

    def call(tool: str, arguments: Column, after: Column) -> Column:
        one = F.struct(name.alias("id"), F.lit(tool).alias("name"),
                       arguments.alias("arguments"), after.alias("after"))
        return F.to_json(F.struct(F.array(one).alias("tool_calls")))

    configure = call("configure", F.struct(F.col("text").alias("instructions")), none)
    answer = call(
        "answer", F.struct(F.col("text").alias("question"), F.col("turn").alias("turn")),
        F.when(F.col("turn") > 0, F.array(F.lit("call-0"))).otherwise(none))
    before = F.concat(F.lit("call-"), F.coalesce(
        (F.col("turn") - 1).cast("string"), F.lit("none")))
    result = F.to_json(F.struct(before.alias("tool_call_id"), F.col("text").alias("content")))
    role = F.col("role")
    return conversations.filter(role.isin("system", "user", "assistant")).select(
        "conv_id", "turn",
        F.when(role == "assistant", F.lit("tool")).otherwise(F.lit("assistant")).alias("role"),
        F.when(role == "assistant", result).when(role == "system", configure)
        .otherwise(answer).alias("text"))


def op7_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(as_tool_messages(table(spark, sf_dir, "conversations")), CHAT_TOOLS)
