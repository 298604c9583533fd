import json
from collections import defaultdict

import pytest

from larder.llm.chat import EVENT_SCHEMA, TURN_SCHEMAS, arguments_valid, canonical, events_of_turns, link_tools, schema_errors
from larder.llm.queries import op10_tool_calls
from tests.llm.helpers import DATA

SCHEMAS = {"look": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}}}}


def link(spark, rows, schemas=SCHEMAS):
    return sorted(link_tools(spark.createDataFrame(rows, EVENT_SCHEMA), schemas).collect(), key=lambda r: (str(r.conv_id), r.position))


def call(conv, turn, i, needs=None, arguments='{"q":"x"}', name="look"):
    return (conv, turn, "call", "assistant", None, i, name, arguments, needs)


def result(conv, turn, i, text="r"):
    return (conv, turn, "result", "tool", text, i, None, None, None)


def message(conv, turn, text="hi"):
    return (conv, turn, "message", "user", text, None, None, None, None)


def test_linking_and_order(spark):
    got = link(spark, [message(1, 0), call(1, 1, "a"), call(1, 2, "b", ["a"]), result(1, 4, "a"), result(1, 3, "b"), message(1, 5), call(2, 0, "a"), result(2, 1, "a")])
    assert [(r.conv_id, r.turn, r.status) for r in got] == [(1, 0, "message"), (1, 1, "linked"), (1, 4, "linked"), (1, 2, "linked"), (1, 3, "linked"), (1, 5, "message"), (2, 0, "linked"), (2, 1, "linked")]
    assert [r.position for r in got] == [0, 1, 2, 3, 4, 5, 0, 1]


def test_a_call_comes_after_what_it_needs_even_if_its_turn_is_earlier(spark):
    got = link(spark, [call(1, 0, "c", ["b"]), call(1, 1, "b", ["a", "no such"]), call(1, 2, "a")])
    assert [r.call_id for r in got] == ["a", "b", "c"]


def test_statuses(spark):
    rows = [call(1, 3, "x"), call(1, 1, "x"), result(1, 0, "e"), call(1, 2, "e"), result(1, 5, "none"), result(1, 6, "x"), result(1, 7, "x"), call(1, 8, "p", ["q"]), call(1, 9, "q", ["p"]), call(1, 10, None), call(None, 0, "n"), result(None, 1, "n")]
    got = {(r.conv_id, r.turn): r.status for r in link(spark, rows)}
    assert got == {(1, 3): "duplicate", (1, 1): "linked", (1, 0): "early", (1, 2): "linked", (1, 5): "orphan", (1, 6): "linked", (1, 7): "duplicate", (1, 8): "cyclic", (1, 9): "cyclic", (1, 10): "unanswered", (None, 0): "linked", (None, 1): "linked"}


def test_canonical_json_and_validity(spark):
    got = link(spark, [call(1, 0, "a", arguments='{"z": 1, "q": "é"}'), call(1, 1, "b", arguments="not json"), call(1, 2, "c", arguments="{}"), call(1, 3, "d", name="other")])
    assert [r.valid for r in got] == [True, False, False, False]
    assert got[0].canonical == '{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":{"q":"é","z":1},"name":"look"},"id":"a","type":"function"}]}'
    assert all(canonical(json.loads(r.canonical)) == r.canonical for r in got)


@pytest.mark.parametrize(
    ("value", "schema", "bad"),
    [(1, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), (1.5, {"type": "integer"}, 1), ("", {"type": "string", "minLength": 1}, 1), ([1, "a"], {"type": "array", "items": {"type": "integer"}}, 1),
     ({"a": 1}, {"type": "object", "additionalProperties": False, "properties": {}}, 1), ("a", {"type": ["integer", "null"]}, 1), (None, {"type": ["integer", "null"]}, 0), (2.0, {"type": "integer"}, 0), (True, {"enum": [1]}, 1),
     ([1, 2], {"minItems": 3}, 1), ("abc", {"maxLength": 2}, 1), (5, {"maximum": 4}, 1), (1, {"const": 2}, 1), ({"a": 1, "b": "x"}, {"additionalProperties": {"type": "string"}}, 1), ({}, {"required": ["x", "y"]}, 2), (-1, {"minimum": 0}, 1), ("x", {"enum": ["y"]}, 1), (None, {"type": "null"}, 0)],
)
def test_schema_errors(value, schema, bad):
    assert len(schema_errors(value, schema)) == bad
    assert not arguments_valid("t", None, {"t": {}})


@pytest.mark.parametrize("arguments", ["[" * 100_000, '{"q":' * 5000 + "1" + "}" * 5000, "NaN", '{"q": Infinity}', '{"q": 1e999}', "9" * 10_000, '{"q": "\\ud800"}', "", None])
def test_odd_arguments_do_not_crash_and_stay_json(spark, arguments):
    (r,) = link(spark, [call(1, 0, "a", arguments=arguments)])
    ok = arguments is not None and "ud800" in arguments
    assert r.valid == ok
    written = json.loads(r.canonical, parse_constant=pytest.fail)["tool_calls"][0]["function"]["arguments"]
    assert written == (json.loads(arguments) if ok else arguments)


def test_null_conversations_are_not_those_of_minus_one(spark):
    got = link(spark, [message(None, 0), message(-1, 1), call(-1, 2, "a"), result(None, 3, "a")])
    assert {(r.conv_id, r.position, r.status) for r in got} == {(None, 0, "message"), (None, 1, "orphan"), (-1, 0, "message"), (-1, 1, "unanswered")}


def test_levels_only_where_turns_are_not_enough(spark):
    got = link(spark, [call(1, 0, "b", ["a"]), call(1, 1, "a"), result(1, 2, "b"), message(1, 3), call(2, 0, "a"), call(2, 1, "b", ["a"])])
    assert {(r.conv_id, r.turn): r.level for r in got} == {(1, 0): 1, (1, 1): 0, (1, 2): 1, (1, 3): None, (2, 0): None, (2, 1): None}


def test_calls_and_results_meet_in_a_hash_join(spark):
    plan = link_plan(spark)
    assert "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan


def link_plan(spark):
    from larder.llm import chat

    seen = []
    keep = chat.in_order
    chat.in_order = lambda df, *a: (seen.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, *a))[1]
    try:
        link(spark, [call(1, 0, "a"), result(1, 1, "a")])
    finally:
        chat.in_order = keep
    return seen[0]


def test_schemas_that_would_not_be_checked_are_refused(spark):
    for schema in ({"pattern": "x"}, {"type": "text"}, {"properties": {"a": {"oneOf": []}}}, {"items": {"format": "date"}}):
        with pytest.raises(ValueError):
            link_tools(spark.createDataFrame([], EVENT_SCHEMA), {"look": schema})


def test_conversations_against_plain_loops(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    have = defaultdict(dict)
    for c, t, role, text in turns:
        have[c][t] = (role, text)
    want = []
    for c, by in have.items():
        for p, t in enumerate(sorted(by)):
            role, text = by[t]
            if role == "assistant":
                status = "linked" if t + 1 in by and by[t + 1][0] == "user" else "unanswered"
                body = {"role": role, "content": text, "tool_calls": [{"id": f"call-{c}-{t}", "type": "function", "function": {"name": "reply", "arguments": {"text": text, "turn": t}}}]}
                want.append((c, t, p, status, bool(text), canonical(body)))
            elif role == "user" and t > 1:
                ok = t - 1 in by and by[t - 1][0] == "assistant"
                want.append((c, t, p, "linked" if ok else "orphan", None, canonical({"role": role, "content": text, "tool_call_id": f"call-{c}-{t - 1}"})))
            else:
                want.append((c, t, p, "message", None, canonical({"role": role, "content": text})))
    got = [(r.conv_id, r.turn, r.position, r.status, r.valid, r.canonical) for r in op10_tool_calls(spark, DATA).collect()]
    assert sorted(got) == sorted(want)


def test_awkward_turns(spark):
    rows = [(1, 0, "assistant", None), (1, 0, "assistant", None), (None, None, None, None), (1, 1, "assistant", ""), (1, 2, "user", "x" * 100_000), (2, 2, "user", "orphan")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, status string")
    got = link_tools(events_of_turns(table), TURN_SCHEMAS).collect()
    assert sorted(r.status for r in got) == ["duplicate", "linked", "linked", "message", "orphan", "unanswered"]
    assert link_tools(events_of_turns(table.limit(0)), TURN_SCHEMAS).collect() == []
