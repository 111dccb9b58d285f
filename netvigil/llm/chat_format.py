"""Operator 4, chat formatting with tool-call linking (DataFrame functions only).

Tool results are hash-joined to calls by conversation and call id.  The topological order puts
every result right after its call, whatever the turns say; everything else keeps its turn.  A
call's arguments are parsed as JSON and checked against the tool's schema, and every message
becomes a line of canonical JSON (sorted keys, no spaces, no nulls).

Conversations of any length are handled: lines are gathered in blocks of at most ``PART_LINES``
lines, never a whole conversation in one group.

Defined cases: NULL conversation ids form a conversation of their own; NULL turns come first and
link nothing; NULL texts and roles are left out of the line; repeated rows are repeated lines; a
call id used twice belongs to its first call, later ones are marked; results without a call are
orphans in their own turn's place; arguments that are no JSON object are kept as text and invalid;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netvigil.llm.common import table

BLOCK_TURNS = 64
PART_LINES = 512
TYPES = {  # JSON schema type: how the parsed value's type may begin
    "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE"], "string": ["STRING"],
    "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"],
}
SCHEMAS = [  # the tools of the registered query: name, parameter, type, required
    ("search", "query", "string", True), ("search", "limit", "integer", True),
    ("lookup", "query", "string", True), ("lookup", "limit", "integer", False),
    ("count", "limit", "integer", True),
]


def line(**fields):
    """Canonical JSON of the given fields."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``calls`` with the parsed ``args`` and an array of ``errors`` (``schemas``: name, parameter,
    type, required).  Calls meet a tool's whole parameter list, so each stays one row."""
    tools = schemas.groupBy("name").agg(F.collect_set(F.struct("parameter", "type", "required")).alias("params"))
    out = calls.join(tools.withColumnRenamed("name", "_tool"), F.col("name") == F.col("_tool"), "left")
    out = out.withColumn("args", F.expr("try_parse_json(arguments)"))
    is_object = F.coalesce(F.startswith(F.schema_of_variant("args"), F.lit("OBJECT")), F.lit(False))
    allowed = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    out = out.withColumn("kinds", F.expr(
        "transform(params, p -> named_struct('p', p, 'kind', schema_of_variant("
        "try_variant_get(args, concat('$[\"', p.parameter, '\"]'), 'variant'))))"))
    missing = F.transform(F.filter("kinds", lambda x: x["p"]["required"] & x["kind"].isNull()),
                          lambda x: F.concat(F.lit("missing "), x["p"]["parameter"]))
    wrong = F.transform(
        F.filter("kinds", lambda x: x["kind"].isNotNull() & ~F.exists(
            allowed[x["p"]["type"]], lambda a: F.startswith(x["kind"], a))),
        lambda x: F.concat(F.lit("type "), x["p"]["parameter"]))
    known = F.transform("params", lambda p: p["parameter"])
    extra = F.transform(F.array_except(F.json_object_keys("arguments"), known),
                        lambda k: F.concat(F.lit("unknown "), k))
    errors = (F.when(F.col("_tool").isNull(), F.array(F.lit("tool")))
              .when(~is_object, F.array(F.lit("arguments")))
              .otherwise(F.array_sort(F.concat(missing, wrong, extra))))
    return (out.withColumn("errors", errors).withColumn("args", F.when(is_object, F.col("args")))
            .drop("_tool", "params", "kinds"))


def format_lines(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per message, call and result: ``conv_id``, its place, ``kind``, ``line``, ``ok``.

    ``messages``: conv_id, turn, role, text; ``calls``: conv_id, turn, idx, call_id, name,
    arguments (JSON text); ``results``: conv_id, turn, call_id, text.
    """
    owner = (calls.where("turn is not null and call_id is not null").groupBy("conv_id", "call_id")
             .agg(F.min(F.struct("turn", "idx")).alias("first")))
    owner = owner.withColumnsRenamed({"conv_id": "_conv", "call_id": "_call"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call"))
    long = lambda c: F.col(c).cast("long")
    zero = F.lit(0).cast("long")

    text = messages.select("conv_id", long("turn").alias("at"), zero.alias("step"), zero.alias("idx"),
                           zero.alias("sub"), F.lit("message").alias("kind"),
                           line(role=F.col("role"), content=F.col("text")).alias("line"), F.lit(True).alias("ok"))

    checked = argument_errors(calls, schemas).join(owner, same, "left")
    later = (F.col("first.turn") != F.col("turn")) | (F.col("first.idx") != F.col("idx"))
    errors = F.when(F.coalesce(later, F.lit(False)), F.concat("errors", F.array(F.lit("repeated id")))).otherwise(
        F.col("errors"))
    function = F.struct(F.col("args").alias("arguments"), F.col("name"),
                        F.when(F.col("args").isNull(), F.col("arguments")).alias("raw_arguments"))
    made = checked.withColumn("errors", errors).select(
        "conv_id", long("turn").alias("at"), F.lit(1).cast("long").alias("step"), long("idx").alias("idx"),
        zero.alias("sub"), F.lit("call").alias("kind"),
        line(role=F.lit("assistant"), tool_call=F.struct(
            F.when(F.size("errors") > 0, F.col("errors")).alias("errors"), function.alias("function"),
            F.col("call_id").alias("id"))).alias("line"), (F.size("errors") == 0).alias("ok"))

    linked = results.join(owner, same, "left")
    has = F.col("first").isNotNull()
    answered = linked.select(
        "conv_id", F.when(has, F.col("first.turn")).otherwise(F.col("turn")).cast("long").alias("at"),
        F.when(has, 1).otherwise(2).cast("long").alias("step"),
        F.when(has, F.col("first.idx")).otherwise(0).cast("long").alias("idx"),
        (F.coalesce("turn", F.lit(-1)) + 2).cast("long").alias("sub"),
        F.when(has, "result").otherwise("orphan").alias("kind"),
        line(role=F.lit("tool"), tool_call_id=F.col("call_id"), content=F.col("text")).alias("line"), has.alias("ok"))
    return text.unionByName(made).unionByName(answered)


def assemble(lines: DataFrame, block_turns: int = BLOCK_TURNS, part_lines: int = PART_LINES) -> DataFrame:
    """Lines in order as JSON arrays of at most ``part_lines``: one row per conversation, block of
    turns and part."""
    block = F.floor(F.coalesce(F.col("at"), F.lit(-1)) / block_turns).cast("long")
    order = ["at", "step", "idx", "sub", "line"]
    w = W.partitionBy("conv_id", "block").orderBy(*order)
    numbered = lines.withColumn("block", block).withColumn("n", F.row_number().over(w))
    part = F.floor((F.col("n") - 1) / part_lines).cast("long")
    kinds = {k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}s") for k in ("message", "call", "result", "orphan")}
    return numbered.groupBy("conv_id", "block", part.alias("part")).agg(
        *kinds.values(), F.count(F.when((F.col("kind") == "call") & ~F.col("ok"), 1)).alias("n_invalid"),
        F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines")
    ).withColumn("json", F.concat(F.lit("["), F.array_join(F.transform("lines", lambda x: x["line"]), ","),
                                  F.lit("]"))).drop("lines")


def tool_rows(conversations: DataFrame):
    """Messages, calls and results derived from plain turns.

    Every assistant turn is also a call (tool by its length, its first words and its number of
    words as arguments, sometimes of a wrong type or missing), and every user turn after the first
    answers the call of the turn before.
    """
    size = F.length("text")
    tool = F.element_at(F.array(*[F.lit(n) for n in ("search", "lookup", "count", "trace")]), (size % 4 + 1).cast("int"))
    words = F.size(F.split("text", " ", -1))
    limit = (F.when(size % 13 == 0, F.lit(None)).when(size % 11 == 0, F.concat(F.lit('"'), words, F.lit('"')))
             .otherwise(words.cast("string")))
    query = F.to_json(F.struct(F.array(F.substring_index("text", " ", 3)).alias("q")))
    query = F.substring(query, 7, F.length(query) - 8)  # the JSON string out of '{"q":["..."]}'
    arguments = F.concat(F.lit('{"query":'), query, F.coalesce(F.concat(F.lit(',"limit":'), limit), F.lit("")),
                         F.lit("}"))
    messages = conversations.select("conv_id", "turn", "role", "text").where(
        ~F.coalesce((F.col("role") == "user") & (F.col("turn") > 0), F.lit(False)))
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", "turn", F.lit(0).alias("idx"), F.concat(F.lit("call-"), "turn").alias("call_id"),
        tool.alias("name"), arguments.alias("arguments"))
    results = conversations.where("role = 'user' and turn > 0").select(
        "conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), "text")
    return messages, calls, results


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations as canonical JSON lines with linked and checked tool calls."""
    messages, calls, results = tool_rows(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(SCHEMAS, "name string, parameter string, type string, required boolean")
    return assemble(format_lines(messages, calls, results, schemas))


ORACLE = """
WITH c AS (SELECT conv_id, turn, role, text, length(text) AS n, len(string_split(text, ' ')) AS words FROM conversations),
message AS (SELECT conv_id, turn AS place, 0 AS step, 0 AS sub, 'message' AS kind, true AS ok,
    '{' || concat_ws(',', '"content":' || to_json(text), '"role":' || to_json(role)) || '}' AS line
    FROM c WHERE NOT coalesce(role = 'user' AND turn > 0, false)),
call AS (SELECT conv_id, turn, 'call-' || turn AS id, n, words,
    CASE n % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'count' ELSE 'trace' END AS name,
    to_json(array_to_string(string_split(text, ' ')[1:3], ' '))::VARCHAR AS query,
    CASE WHEN n % 13 = 0 THEN NULL WHEN n % 11 = 0 THEN '"' || words || '"' ELSE words::VARCHAR END AS lim
    FROM c WHERE role = 'assistant'),
checked AS (SELECT *, CASE WHEN name = 'trace' THEN ['tool'] ELSE list_filter([
    CASE WHEN n % 13 = 0 AND name IN ('search', 'count') THEN 'missing limit' END,
    CASE WHEN n % 13 <> 0 AND n % 11 = 0 THEN 'type limit' END,
    CASE WHEN name = 'count' THEN 'unknown query' END], lambda x: x IS NOT NULL) END AS errors FROM call),
made AS (SELECT conv_id, turn AS place, 1 AS step, 0 AS sub, 'call' AS kind, len(errors) = 0 AS ok,
    '{"role":"assistant","tool_call":{' ||
    CASE WHEN len(errors) > 0 THEN '"errors":' || to_json(errors) || ',' ELSE '' END ||
    '"function":{"arguments":{' || coalesce('"limit":' || lim || ',', '') || '"query":' || query || '},"name":"' || name ||
    '"},"id":"' || id || '"}}' AS line FROM checked),
result AS (SELECT r.conv_id, coalesce(k.turn, r.turn) AS place, CASE WHEN k.turn IS NULL THEN 2 ELSE 1 END AS step,
    r.turn + 2 AS sub, CASE WHEN k.turn IS NULL THEN 'orphan' ELSE 'result' END AS kind, k.turn IS NOT NULL AS ok,
    '{' || concat_ws(',', '"content":' || to_json(r.text), '"role":"tool"', '"tool_call_id":"call-' || (r.turn - 1) || '"') || '}' AS line
    FROM c r LEFT JOIN (SELECT DISTINCT conv_id, turn FROM call) k ON k.conv_id = r.conv_id AND k.turn = r.turn - 1
    WHERE r.role = 'user' AND r.turn > 0),
lines AS (SELECT * FROM message UNION ALL SELECT * FROM made UNION ALL SELECT * FROM result),
numbered AS (SELECT *, floor(place / 64)::BIGINT AS block,
    row_number() OVER (PARTITION BY conv_id, floor(place / 64) ORDER BY place, step, sub, line) AS rn FROM lines)
SELECT conv_id, block, floor((rn - 1) / 512)::BIGINT AS part, count(*) FILTER (kind = 'message') AS n_messages,
    count(*) FILTER (kind = 'call') AS n_calls, count(*) FILTER (kind = 'result') AS n_results,
    count(*) FILTER (kind = 'orphan') AS n_orphans, count(*) FILTER (kind = 'call' AND NOT ok) AS n_invalid,
    '[' || string_agg(line, ',' ORDER BY rn) || ']' AS json
FROM numbered GROUP BY ALL
"""
