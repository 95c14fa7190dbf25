"""Chat formatting, native: tool calls linked to their results, ordered, validated and serialised.

Calls and results meet in a hash join on conversation and identifier. Items are put into a topological order: a result
stands after its call, a call after the results that it needs, whatever the log's order and over any number of levels;
everything else keeps the order of turns. Arguments are checked against the JSON schema of their tool and written as
canonical JSON (keys in order, no blanks).

Positions come from one range sort of all items, whose partitions are numbered, so that neither a very long conversation
nor a third of all rows with a null turn is one task's work.

Defined results: null texts are empty strings; rows with a null conversation or turn keep them (null sorts first), a null
conversation is one conversation whose calls and results are not linked; repeated identifiers link to the first call;
results without call are kept and not linked; where needs run in a circle, those of the conversation do not count; invalid JSON
is kept as text and marked invalid, as are arguments for tools without schema; an empty table gives no rows; columns of
other names are ignored. Very long texts are escaped and copied whole, row by row.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.llm.common import let, materialize

#: Bits of a row's number within its partition in ``monotonically_increasing_id``.
ROW_BITS = 33


def has_type(value: Column, name: str) -> Column:
    """Whether a variant is of a JSON schema type; whole numbers such as ``1.0`` are integers."""
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if name == "integer":
        whole = F.try_variant_get(value, "$", "double")
        return number & ((kind == "BIGINT") | (F.floor(whole) == whole))
    plain = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
    if name in plain:
        return kind == plain[name]
    return {"number": number, "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT")}[name]


def fits(value: Column, schema: dict) -> Column:
    """Whether a variant (null: absent) fits a JSON schema.

    ``type`` (one or several), ``enum``, ``const``, ``required``, ``properties``, ``additionalProperties`` (true or
    false), ``items``, ``minItems``, ``maxItems``, ``minimum``, ``maximum``, ``minLength`` and ``maxLength``, nested at
    will; other keywords raise. As in JSON schema, a rule for another type than the value's says nothing.
    """
    rules = [value.isNotNull()]
    known = {
        "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minimum", "maximum",
        "minLength", "maxLength", "title", "description", "default",
    }
    if schema.keys() - known:
        raise ValueError(f"schema keywords not supported: {sorted(schema.keys() - known)}")
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        one = has_type(value, names[0])
        for name in names[1:]:
            one = one | has_type(value, name)
        rules.append(one)
    allowed = schema.get("enum", []) + ([schema["const"]] if "const" in schema else [])
    if "enum" in schema or "const" in schema:
        texts = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in allowed]
        rules.append(F.to_json(value).isin(texts) if texts else F.lit(False))

    def when(name: str, rule: Column) -> None:
        rules.append(~has_type(value, name) | F.coalesce(rule, F.lit(False)))

    fields = F.try_variant_get(value, "$", "map<string,variant>")
    properties = schema.get("properties", {})
    for name in schema.get("required", []):
        when("object", F.map_contains_key(fields, F.lit(name)))
    for name, inner in properties.items():
        at = F.try_element_at(fields, F.lit(name))
        when("object", ~F.map_contains_key(fields, F.lit(name)) | fits(at, inner))
    if schema.get("additionalProperties") is False:
        names = F.array(*map(F.lit, properties)).cast("array<string>")
        when("object", F.size(F.array_except(F.map_keys(fields), names)) == 0)
    items = F.try_variant_get(value, "$", "array<variant>")
    if "items" in schema:
        when("array", F.forall(items, lambda x: fits(x, schema["items"])))
    for key, name, size in (
        ("Items", "array", F.size(items)), ("Length", "string", F.length(F.try_variant_get(value, "$", "string"))),
    ):
        if f"min{key}" in schema:
            when(name, size >= schema[f"min{key}"])
        if f"max{key}" in schema:
            when(name, size <= schema[f"max{key}"])
    number = F.try_variant_get(value, "$", "double")
    if "minimum" in schema:
        when("number", number >= schema["minimum"])
    if "maximum" in schema:
        when("number", number <= schema["maximum"])
    out = rules[0]
    for rule in rules[1:]:
        out = out & F.coalesce(rule, F.lit(False))
    return out


def arguments_valid(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """Whether JSON ``arguments`` fit the JSON schema of their tool; false for tools without one."""

    def checked(value: Column) -> Column:
        out = F.lit(False)
        for tool, schema in schemas.items():
            out = F.when(name == tool, fits(value, schema)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    return let(F.try_parse_json(arguments), checked)


def canonical_json(text: Column) -> Column:
    """JSON with its keys in order and no blanks; other text as a JSON string."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.to_json(F.to_variant_object(F.array(text))))


def _after(place: Column) -> Column:
    """The place right behind ``place`` (``at``, ``level``)."""
    return F.struct(place["at"].alias("at"), (place["level"] + 1).alias("level"))


def call_places(items: DataFrame, needs: str | None = None) -> DataFrame:
    """``conv_id, call_id, answered, call_at, result_at`` of all calls: places (turn and level) in topological order.

    Without ``needs`` (a column of identifiers whose results a call waits for) a result only waits for its call. With it,
    places are passed on along the needs until none moves, one hash join a round on a written table of calls; in a log
    that is in order none moves. Calls of a circle would move for ever: a level beyond twice the number of a
    conversation's calls can only come from one, and the needs of such a conversation no longer count.
    """
    key = ["conv_id", "call_id"]
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    known = items.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & (is_call | is_result))
    wants = F.min_by(F.when(is_call, F.col(needs)), F.when(is_call, F.col("turn"))) if needs else F.lit(None).cast("array<string>")
    calls = known.groupBy(*key).agg(
        F.min(F.when(is_call, F.col("turn"))).alias("turn"), F.count_if(is_call).alias("calls"), F.min(F.when(is_result, F.col("turn"))).alias("back"),
        F.count_if(is_result).alias("results"), wants.alias("needs"),
    ).where("calls > 0")
    place = lambda turn, level: F.struct(turn.cast("long").alias("at"), F.lit(level).alias("level"))
    own = place(F.col("turn"), 0)
    back = lambda call: F.when(F.col("results") > 0, F.greatest(place(F.col("back"), 0), _after(call)))
    calls = calls.withColumn("call_at", own).withColumn("result_at", back(F.col("call_at")))
    calls = materialize(calls, "chat-calls")
    if needs and not calls.where(F.size("needs") > 0).isEmpty():
        most = calls.groupBy(F.col("conv_id").alias("conv")).agg(F.max("turn").alias("_"), (2 * F.count("*")).cast("int").alias("most")).drop("_")
        calls = materialize(calls.join(most.hint("shuffle_hash"), F.col("conv_id") == F.col("conv")).drop("conv").withColumn("circle", F.lit(False)), "chat-calls")
        while True:
            asks = calls.where("NOT circle").select(*key, F.explode("needs").alias("need"))
            ready = calls.where("NOT circle").select("conv_id", F.col("call_id").alias("need"), "result_at")
            waits = asks.join(ready.hint("shuffle_hash"), ["conv_id", "need"]).where("result_at IS NOT NULL")
            waits = waits.groupBy(*key).agg(F.max(_after(F.col("result_at"))).alias("wait"))
            moved = calls.join(waits.hint("shuffle_hash"), key, "left").withColumn("before", F.col("call_at"))
            moved = moved.withColumn("call_at", F.greatest("call_at", "wait")).withColumn("result_at", back(F.col("call_at")))
            moved = materialize(moved.drop("wait"), "chat-calls")
            round_ = moved.where("call_at.level > most").select(F.col("conv_id").alias("conv"), F.lit(True).alias("found")).distinct()
            if not round_.isEmpty():
                found = F.coalesce("found", F.lit(False))
                moved = moved.join(round_.hint("shuffle_hash"), F.col("conv_id") == F.col("conv"), "left").withColumn("circle", F.col("circle") | found)
                moved = moved.withColumn("call_at", F.when(F.col("circle"), own).otherwise(F.col("call_at"))).withColumn("result_at", back(F.col("call_at")))
                moved = materialize(moved.drop("conv", "found"), "chat-calls")
            calls = moved.drop("before")
            if moved.where("NOT circle AND call_at <> before").isEmpty():
                break
    return calls.select(*key, (F.col("results") > 0).alias("answered"), "call_at", "result_at")


def link_calls(items: DataFrame, schemas: dict[str, dict], needs: str | None = None) -> DataFrame:
    """``conv_id, turn, kind, call_id, linked, valid, position, message`` for ``items``.

    ``items``: ``conv_id, turn, kind`` (``message``, ``call`` or ``result``), ``role, content, call_id, name, arguments``,
    and the column ``needs``, where one is named. ``schemas``: the JSON schema of each tool's arguments.
    """
    items = items.select("conv_id", "turn", "kind", "role", "content", "call_id", "name", "arguments", *([needs] if needs else []))
    calls = call_places(items, needs)
    joined = items.join(calls.hint("shuffle_hash"), ["conv_id", "call_id"], "left")

    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    linked = F.when(is_call, F.coalesce("answered", F.lit(False))).when(is_result, F.col("call_at").isNotNull()).otherwise(False)
    own = F.struct(F.col("turn").cast("long").alias("at"), F.lit(0).alias("level"))
    first = F.when(is_call, F.greatest(own, F.col("call_at"))).when(is_result, F.greatest(own, _after(F.col("call_at"))))
    place = F.when(F.col("call_at").isNotNull() & F.col("turn").isNotNull() & (is_call | is_result), first).otherwise(own)
    valid = F.when(is_call, arguments_valid(F.col("name"), F.col("arguments"), schemas)).otherwise(F.lit(True))
    message = F.concat(
        F.lit("{"),
        F.when(is_call, F.concat(F.lit('"arguments":'), F.coalesce(canonical_json(F.col("arguments")), F.lit("null")), F.lit(","))).otherwise(""),
        F.when(is_call | is_result, F.concat(F.lit('"call_id":'), _text(F.col("call_id")), F.lit(","))).otherwise(""),
        F.lit('"content":'), _text(F.col("content")),
        F.when(is_call, F.concat(F.lit(',"name":'), _text(F.col("name")))).otherwise(""),
        F.lit(',"role":'), _text(F.col("role")), F.lit("}"),
    )
    out = joined.select(
        "conv_id", "turn", "kind", "call_id", linked.alias("linked"), valid.alias("valid"), place.alias("place"), message.alias("message"),
    )
    return with_positions(out, "conv_id", ["place.at", "place.level", "turn", "call_id", "message"]).drop("place").select(
        "conv_id", "turn", "kind", "call_id", "linked", "valid", "position", "message"
    )


def with_positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``position`` (from 0) within ``group`` in ``order`` (nulls first).

    All rows go through one range sort and are written with the numbers of their partitions and of the rows therein; a
    group may lie over many partitions. The row's own number breaks ties, also between partitions.
    """
    by = [F.col(group), *map(F.col, order), F.col("__row")]
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    numbered = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("__row").withColumn("__at", F.monotonically_increasing_id())
    numbered = materialize(numbered, "chat-sorted")
    part = F.shiftright("__at", ROW_BITS).alias("__part")
    sizes = numbered.groupBy(part).agg(F.count("*").alias("n"))  # one row for each partition
    before = F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sizes = F.broadcast(sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before")))
    place = F.col("__at").bitwiseAND((1 << ROW_BITS) - 1) + F.col("__before")
    first = numbered.groupBy(F.col(group).alias("__group")).agg(F.min("__at").alias("__at"))
    first = first.withColumn("__part", F.shiftright("__at", ROW_BITS)).join(sizes, "__part").select("__group", place.alias("__first"))
    # Written, so that the join is dealt by an exchange of its own, which AQE may split at a long group.
    first = materialize(first, "chat-firsts")
    out = numbered.withColumn("__part", F.shiftright("__at", ROW_BITS)).join(sizes, "__part")
    out = out.join(first.hint("shuffle_hash"), F.col(group).eqNullSafe(F.col("__group")))
    return out.withColumn("position", (place - F.col("__first")).cast("long")).drop("__at", "__part", "__before", "__group", "__first")


def _text(x: Column) -> Column:
    """A JSON string with the JSON escapes of quote, backslash and control characters."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def conversation_items(conversations: DataFrame) -> DataFrame:
    """Items of plain conversations: a user turn calls ``reply``, the assistant turn after it brings the result."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    kind = F.when(role == "user", "call").when(role == "assistant", "result").otherwise("message")
    asked = F.when(role == "user", F.col("turn")).when(role == "assistant", F.col("turn") - 1)
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    arguments = F.when(role == "user", F.to_json(F.struct(words.alias("words"), F.length(text).alias("chars"))))
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    call = F.concat(F.lit("call-"), conv.cast("string"), F.lit("-"), asked.cast("long").cast("string"))  # null with a null part
    return conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), kind.alias("kind"), role.alias("role"), text.alias("content"), call.alias("call_id"),
        F.when(kind == "call", "reply").alias("name"), arguments.alias("arguments"),
    )


#: The JSON schema of the implied tool of ``conversation_items``.
REPLY_SCHEMA = {"reply": {
    "type": "object", "required": ["chars", "words"], "additionalProperties": False,
    "properties": {"chars": {"type": "integer", "minimum": 0}, "words": {"type": "integer", "minimum": 0}},
}}
