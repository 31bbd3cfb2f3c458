import json

from evispark.llm import tool_calls

SCHEMAS = {"sum": {"a": ("number", True), "b": ("number", True), "note": ("string", False)}, "echo": {"x": ("string", True)}}


def call(i, name, **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string")


def test_links_orders_validates_and_serialises(spark):
    rows = [
        (1, 0, "user", 'say "é"\n', "x"),
        (1, 1, "assistant", json.dumps({"tool_calls": [call("c", "echo", x="$ref:b"), call("b", "sum", b=2, a=1.50), call("b", "sum", a=1, b=1)]}), "x"),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [1, 2]}}), "x"),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": 2}), "x"),
        (1, 4, "tool", json.dumps({"tool_call_id": "nobody", "content": None}), "x"),
        (1, 5, "tool", json.dumps({"tool_call_id": "c", "content": "ok"}), "x"),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("p", "echo", x="$ref:q"), call("q", "echo", x="$ref:p"), call("r", "sum", a="one", c=1), call("s", "what")]}), "x"),
        (2, 1, "assistant", "{not json", "x"),
        (2, 2, "assistant", None, "x"),
        (2, 3, "tool", "{}", "x"),
    ]
    got = [r.asDict() for r in tool_calls.link(table(spark, rows), SCHEMAS).collect()]
    calls = {(r["conv_id"], r["call_id"], r["pos"]): r for r in got if r["kind"] == "call"}
    assert calls[1, "b", 1]["status"] == "linked" and calls[1, "b", 1]["level"] == 0
    assert calls[1, "c", 0]["status"] == "linked" and calls[1, "c", 0]["level"] == 1
    assert calls[1, "b", 2]["status"] == "duplicate_call"
    assert calls[1, "b", 1]["json"] == '{"arguments":{"a":1.5,"b":2},"id":"b","name":"sum","type":"call"}'
    assert {calls[2, i, k]["status"] for i, k in (("p", 0), ("q", 1))} == {"cyclic"}
    assert calls[2, "r", 2]["status"] == "invalid_arguments" and calls[2, "r", 2]["errors"] == ["a", "b", "c"]
    assert calls[2, "s", 3]["errors"] == ["*"]
    results = {(r["call_id"], r["turn"]): r for r in got if r["kind"] == "result"}
    assert results["b", 2]["status"] == "linked" and results["b", 2]["json"] == '{"content":{"a":[1,2],"z":1},"role":"tool","tool_call_id":"b"}'
    assert results["b", 3]["status"] == "duplicate_result" and results["nobody", 4]["status"] == "no_call"
    messages = {(r["conv_id"], r["turn"]): r["json"] for r in got if r["kind"] == "message"}
    assert json.loads(messages[1, 0]) == {"content": 'say "é"\n', "role": "user"}
    assert messages[2, 2] == '{"content":null,"role":"assistant"}' and set(messages) == {(1, 0), (2, 1), (2, 2), (2, 3)}


def test_empty_and_repeated(spark):
    assert tool_calls.link(table(spark, []), SCHEMAS).count() == 0
    assert tool_calls.link(table(spark, [(1, 0, "user", "", "x")] * 3)).count() == 3


def test_levels_of_chains_forks_and_circles(spark):
    """Long chains, calls with several references, circles and what hangs on them; keys that look like references."""
    chain = [(1, 0, "assistant", json.dumps({"tool_calls": [call("a0", "echo", x="x")] + [call(f"a{i}", "echo", x=f"$ref:a{i - 1}") for i in range(1, 41)]}), "x")]
    forks = [
        (2, 0, "assistant", json.dumps({"tool_calls": [call("r", "e"), call("s", "e", x="$ref:r"), call("t", "e", x="$ref:s"), call("u", "e", x=["$ref:t", {"k": "$ref:r"}])]}), "x"),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("v", "e", x="$ref:u"), call("w", "e", x="$ref:v", y="$ref:t"), call("k", "e", **{"$ref:w": 'say "$ref:v"', "z": "a:\"$ref:u\""})]}), "x"),
        (3, 0, "assistant", json.dumps({"tool_calls": [call("p", "e", x="$ref:q"), call("q", "e", x="$ref:p"), call("h", "e", x="$ref:p"), call("m", "e", x="$ref:h", y="$ref:o"), call("o", "e", x="$ref:gone"), call("z", "e", x="$ref:z")]}), "x"),
    ]
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in tool_calls.link(table(spark, chain + forks)).collect()}
    assert [got[1, f"a{i}"] for i in range(41)] == list(range(41))
    assert {k: got[2, k] for k in "rstuvwk"} == {"r": 0, "s": 1, "t": 2, "u": 3, "v": 4, "w": 5, "k": 0}
    assert {k: got[3, k] for k in "pqhmoz"} == {"p": None, "q": None, "h": None, "m": None, "o": 0, "z": None}


def test_hot_ids_are_joined_in_place(spark):
    rows = [(1, t, "assistant", json.dumps({"tool_calls": [call("same", "echo", x="y")]}), "x") for t in range(30)]
    rows += [(1, 40 + t, "tool", json.dumps({"tool_call_id": "same", "content": t}), "x") for t in range(5)] + [(2, 0, "assistant", json.dumps({"tool_calls": [call("one", "echo", x="y")]}), "x")]
    keys = ("conv_id", "turn", "pos", "kind", "status", "level", "json")
    few, many = (sorted(tuple(str(r[k]) for k in keys) for r in tool_calls.link(table(spark, rows), SCHEMAS, hot=h).collect()) for h in (3, 1000))
    assert few == many and len(few) == 36 and sum(r[4] == "linked" for r in few) == 2


def test_query_covers_every_case(spark):
    """On the smallest tables all of calls, results, levels, errors and duplicates occur."""
    from evispark.llm import queries

    got = queries.op8_tool_calls(spark, "/root/testdata/sf0.01").groupBy("kind", "status").count().collect()
    assert {(r["kind"], r["status"]) for r in got} >= {("message", "message"), ("call", "linked"), ("call", "invalid_arguments"), ("call", "no_result"), ("call", "duplicate_call"), ("result", "linked")}
