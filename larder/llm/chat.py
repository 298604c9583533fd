"""Chat formatting: link tool calls with their results, order them, check arguments, write canonical JSON.

Calls and results meet in a hash join on conversation and call id. A call comes after the calls its ``needs`` name. Where
all needs stand in earlier turns, the turns are a topological order; other conversations get levels, in rounds of joins,
one per step of their longest chain, and within a level the turn decides. Arguments are checked against the tool's
parameter schema. Each linked message is written as JSON with sorted keys and no spaces.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larder.llm.common import in_order, materialise, prepare, with_rank

#: Most levels of nesting in arguments.
DEPTH = 100
SURROGATE = re.compile("[\ud800-\udfff]")
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}
EVENT_SCHEMA = "conv_id long, turn long, kind string, role string, text string, call_id string, name string, arguments string, needs array<string>"
LINKED_SCHEMA = "conv_id long, turn long, level int, kind string, call_id string, status string, valid boolean, canonical string"


#: Keywords of parameter schemas that are checked, and those that say nothing on validity.
CHECKED = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "minimum", "maximum"}
SILENT = {"title", "description", "default", "examples", "$schema", "$id"}


def canonical(value) -> str:
    """Sorted keys, no spaces; letters stand for themselves, but for halves of surrogate pairs, which have no UTF-8."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return text if text.isascii() or not SURROGATE.search(text) else SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def parse(text: str | None):
    """The value of a JSON text. ValueError for all else: NaN and infinities, also as numbers out of range, and values
    nested in more than ``DEPTH`` others."""

    def number(t: str) -> float:
        if math.isinf(x := float(t)):
            raise ValueError("out of range")
        return x

    def constant(t: str):
        raise ValueError(f"{t} is not JSON")

    try:
        value = json.loads(text or "", parse_constant=constant, parse_float=number)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level, depth = [value], 0
    while level := [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]:
        depth += 1
        if depth > DEPTH:
            raise ValueError("nested too deep")
    return value


def check_schema(schema: dict) -> None:
    """ValueError where a schema holds a keyword or type that would not be checked."""
    unknown = set(schema) - CHECKED - SILENT
    kinds = schema.get("type", [])
    unknown |= set([kinds] if isinstance(kinds, str) else kinds) - set(TYPES)
    if unknown:
        raise ValueError(f"not supported in a schema: {sorted(unknown)}")
    for inner in [*schema.get("properties", {}).values(), schema.get("items"), schema.get("additionalProperties")]:
        if isinstance(inner, dict):
            check_schema(inner)


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, TYPES[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """What in a JSON value breaks a schema of the keywords in ``CHECKED``; ``type`` may be a list of types."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = [f"{at}: not in enum"] if "enum" in schema and not any(_same(value, e) for e in schema["enum"]) else []
    if "const" in schema and not _same(value, schema["const"]):
        found.append(f"{at}: not the constant")
    size = len(value) if isinstance(value, (str, list)) else None
    least, most = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        size, least, most = value, "minimum", "maximum"
    if size is not None and size < schema.get(least, size):
        found.append(f"{at}: below {least}")
    if size is not None and size > schema.get(most, size):
        found.append(f"{at}: above {most}")
    if isinstance(value, dict):
        props, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        found += [f"{at}.{k}: unknown" for k in value if k not in props and more is False]
        for k, v in value.items():
            inner = props.get(k, more)
            if isinstance(inner, dict):
                found += schema_errors(v, inner, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += schema_errors(v, schema["items"], f"{at}[{i}]")
    return found


def _same(a, b) -> bool:
    """Equality of JSON values: true is not 1."""
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def arguments_valid(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> bool:
    """False for an unknown tool, text that is not JSON, or arguments that break the tool's schema."""
    if name not in schemas:
        return False
    try:
        return not schema_errors(parse(arguments), schemas[name])
    except ValueError:
        return False


def _write(schemas: dict[str, dict]):
    names = [x.split()[0] for x in LINKED_SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                message, valid = {"role": r["role"], "content": r["text"]}, None
                if r["kind"] == "call":
                    valid = arguments_valid(r["name"], r["arguments"], schemas)
                    try:
                        arguments = parse(r["arguments"])
                    except ValueError:  # stays the text it is
                        arguments = r["arguments"]
                    message |= {"tool_calls": [{"id": r["call_id"], "type": "function", "function": {"name": r["name"], "arguments": arguments}}]}
                elif r["kind"] == "result":
                    message |= {"tool_call_id": r["call_id"]}
                rows.append({**{n: r[n] for n in names if n in r}, "valid": valid, "canonical": canonical(message)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("level", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("status", pa.string()), ("valid", pa.bool_()), ("canonical", pa.string())]))

    return run


def call_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): one more than the highest level among needed calls, 0 without any.

    Needs that name no call are left out; calls on a cycle, and all that need them, get a null level.
    """
    nodes = calls.select("conv_id", "call_id").distinct()
    needs = calls.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    known = nodes.select("conv_id", F.col("call_id").alias("need"))
    edges = materialise(needs.join(known, ["conv_id", "need"], "left_semi"), "call-needs")
    waiting = edges.select("conv_id", "call_id").distinct()
    done = materialise(nodes.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)), "call-levels")
    parts, level = [done], 0
    while not edges.isEmpty():
        level += 1
        edges = materialise(edges.join(parts[-1].select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"), "call-needs")
        left = edges.select("conv_id", "call_id").distinct()
        ready = materialise(waiting.join(left, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)), "call-levels")
        if ready.isEmpty():
            break
        parts.append(ready)
        waiting = materialise(left, "call-waiting")
    else:
        waiting = None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if waiting is None else out.unionByName(waiting.withColumn("level", F.lit(None).cast("int")))


def link_tools(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per event of (conv_id, turn, kind, role, text, call_id, name, arguments, needs), in order.

    kind is call, result or message. Returns conv_id, turn, position (gapless from 0 in a conversation), level, kind,
    call_id, status, valid, canonical. Status of a call: linked, or unanswered; of a result: linked, orphan (no such
    call) or early (its turn comes before the call's); calls on a cycle are cyclic; a message has status message. Of calls
    with one id the first by turn is linked, others are duplicate; a result beyond the first is duplicate. A result
    stands right after its call, at its level. valid tells whether a call's arguments meet the tool's schema, null for
    other kinds. Null conversation ids form one conversation; a call or result without an id links with nothing; an
    empty table gives an empty result.
    """
    prepare(events.sparkSession)
    for schema in schemas.values():
        check_schema(schema)
    conv = F.coalesce(F.concat(F.lit("#"), F.col("conv_id").cast("string")), F.lit(""))  # a null id is none that a row can have
    e = events.select([x.split()[0] for x in EVENT_SCHEMA.split(", ")]).withColumns({"conv": conv, "id": F.coalesce("call_id", F.lit(""))})
    e = materialise(e.withColumn("uid", F.monotonically_increasing_id()), "chat-events")
    tools = e.filter("kind <> 'message' and id <> ''")
    first = tools.groupBy("conv", "id").agg(
        F.min(F.when(F.col("kind") == "call", F.struct("turn", "uid"))).alias("call"), F.min(F.when(F.col("kind") == "result", F.struct("turn", "uid"))).alias("result")
    )
    late = materialise(late_conversations(tools), "chat-late")
    calls = tools.filter("kind = 'call'").join(late, "conv", "left_semi").select(F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), "needs")
    levels = call_levels(calls).select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), "level", F.lit(True).alias("is_late"))
    # One row for each call id, built into a hash table; rows of one id in thousands stay on the probing side.
    linked = tools.join(materialise(first, "chat-first").hint("shuffle_hash"), ["conv", "id"], "left").join(levels, ["conv", "id"], "left")
    call, result, mine = F.col("call"), F.col("result"), F.col("uid")
    status = (
        F.when((F.col("kind") == "call") & F.col("is_late") & F.col("level").isNull(), "cyclic")
        .when((F.col("kind") == "call") & (call["uid"] != mine), "duplicate")
        .when((F.col("kind") == "call") & result.isNotNull(), "linked")
        .when(F.col("kind") == "call", "unanswered")
        .when(call.isNull(), "orphan")
        .when(result["uid"] != mine, "duplicate")
        .when(F.col("turn") < call["turn"], "early")
        .otherwise("linked")
    )
    at = F.when(status == "linked", call["turn"]).otherwise(F.col("turn"))
    with_call = linked.select(*e.columns, status.alias("status"), at.alias("at"), F.coalesce("level", F.lit(0)).alias("lv"), "level")
    alone = F.when(F.col("kind") == "call", "unanswered").when(F.col("kind") == "result", "orphan").otherwise("message")
    others = e.filter("kind = 'message' or id = ''").select(*e.columns, alone.alias("status"), F.col("turn").alias("at"), F.lit(0).alias("lv"), F.lit(None).cast("int").alias("level"))
    rows = with_call.unionByName(others).withColumn("after", F.when(F.col("kind") == "result", 1).otherwise(0))
    placed, _ = with_rank(in_order(rows, ["conv", "lv", "at", "after", "turn", "uid"], "chat-order"))
    start = materialise(placed.groupBy("conv").agg(F.min("rank").alias("start")), "chat-starts")
    out = placed.join(start, "conv").select("conv_id", "turn", (F.col("rank") - F.col("start")).alias("position"), "level", "kind", "role", "text", "call_id", "name", "arguments", "status")
    columns = [c for c in out.columns if c != "position"]
    written = out.select("position", *columns)

    def with_position(batches):
        for b in batches:
            got = next(_write(schemas)(iter([b])))
            yield pa.RecordBatch.from_arrays([b.column("position"), *got.columns], names=["position", *got.schema.names])

    return written.mapInArrow(with_position, "position long, " + LINKED_SCHEMA).select("conv_id", "turn", "position", "level", "kind", "call_id", "status", "valid", "canonical")


def late_conversations(tools: DataFrame) -> DataFrame:
    """(conv): conversations in which some call stands at or before one it needs, so that the turns' order is not enough."""
    calls = tools.filter("kind = 'call'")
    needs = calls.select("conv", "turn", F.explode("needs").alias("need"))
    at = calls.groupBy("conv", F.col("id").alias("need")).agg(F.min("turn").alias("need_turn"))
    return needs.join(at, ["conv", "need"]).filter("need_turn >= turn").select("conv").distinct()


#: Tools that ``events_of_turns`` reads into a conversation.
TURN_SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["text", "turn"],
        "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as events: an assistant's turn is a call of ``reply`` that needs the call two turns
    before it, the user's turn after it is the call's result; every other turn is a message."""
    conv, turn = F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.col("turn")
    name = lambda back: F.concat_ws("-", F.lit("call"), conv, (turn - back).cast("string"))
    call, result = F.col("role") == "assistant", (F.col("role") == "user") & (turn > 1)
    return conversations.select(
        F.col("conv_id").cast("long"), turn.cast("long").alias("turn"),
        F.when(call, "call").when(result, "result").otherwise("message").alias("kind"), "role", "text",
        F.when(call, name(0)).when(result, name(1)).alias("call_id"), F.when(call, "reply").alias("name"),
        F.when(call, F.to_json(F.struct("text", "turn"))).alias("arguments"),
        F.when(call & (turn > 1), F.array(name(2))).alias("needs"),
    )
