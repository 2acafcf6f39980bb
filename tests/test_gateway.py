import json

from pyspark.sql import functions as F

from tollgate.sources import gateway as G


def test_json_round_trip_keeps_numbers():
    body = '{"b": 12.50, "a": ["<x>&", 1e3, null, true], "é": "ü"}'
    assert G.write_json(G.read_json(body)) == '{"a":["<x>&",1e3,null,true],"b":12.50,"é":"ü"}'


def test_leaves():
    value = G.read_json('{"z": "1", "a": {"y": ["q", {"k": "w"}], "n": 4}, "id": "secret", "u": "data:x", "e": ""}')
    assert [t for _, t in G.leaves(value)] == ["q", "w", "", "secret", "data:x", "1"]
    assert [t for _, t in G.leaves(value, prose=True)] == ["q", "w", "1"]


def test_chat_split():
    body = json.dumps({"model": "m", "messages": [{"role": "system", "content": "s"}, {"role": "tool", "content": "t"}, {"role": "user", "content": [{"type": "text", "text": "u"}, {"type": "image", "text": "no"}]}, {"role": "assistant", "content": None}, 3]})
    got = G.model_request_hops(body, True)
    assert [(h["surface"], [f["part"]["text"] for f in h["fields"]]) for h in got] == [("input", ["s", "u"]), ("tool_result", ["t"])]
    assert got[1]["fields"][0]["part"]["trust"] == "untrusted" and got[0]["source"] == "m"
    assert G.model_request_hops("not json", True) == [] and G.model_request_hops('{"messages": []}', True) == []
    assert [f["part"]["text"] for f in G.model_response_hops('{"choices": [{"message": {"content": "hi"}}]}', True)[0]["fields"]] == ["hi"]
    assert G.model_request_hops('{"input": "x", "model": "m", "id": "skip"}', False)[0]["fields"][0]["part"] == {"role": "", "text": "x", "trust": "trusted"}


def test_tool_messages():
    assert G.tool_call_hops('{"name": "f", "arguments": {"b": "2", "a": "1"}}', [])[0]["fields"][0]["part"]["text"] == "1"
    assert G.tool_call_hops('{"name": "f"}', [])[0]["fields"] == []
    hops = G.tool_list_hops('{"tools": [{"name": "srv_f", "description": "d"}, 7, {"name": "g"}]}', ["other", "srv"])
    assert [(h["seq"], h["source"]) for h in hops] == [(0, "f"), (2, "g")]
    result = G.tool_result_hops('{"content": [{"text": "a"}, {"resource": {"text": "b"}}, {"data": "zz"}], "structuredContent": {"k": "c"}}', ["one"])
    assert [f["part"]["text"] for f in result[0]["fields"]] == ["a", "b", "c"] and result[0]["source"] == "one"
    assert G.tool_result_hops('{"content": [{"data": "zz"}]}', ["one"]) == []


def decided(hop, action, redactions=()):
    return {"seq": hop["seq"], "surface": hop["surface"], "action": action, "paths": [f["path"] for f in hop["fields"]], "parts": [f["part"] for f in hop["fields"]], "redactions": list(redactions)}


def test_write_back():
    body = '{"tools": [{"name": "f", "description": "é secret", "n": 1.50}, {"name": "g"}]}'
    f, g = G.tool_list_hops(body, [])
    assert G.write_back(body, [decided(f, "allow"), decided(g, "flag")]) == ("pass", body)
    assert G.write_back(body, [decided(f, "redact", [{"part": 0, "start": 3, "end": 9}]), decided(g, "block")]) == ("mutated", '{"tools":[{"description":"é [REDACTED]","n":1.50,"name":"f"}]}')
    assert G.write_back(body, [decided(f, "redact"), decided(g, "allow")]) == ("pass", body)
    call = '{"name": "f", "arguments": {"a": "x"}}'
    assert G.write_back(call, [decided(G.tool_call_hops(call, [])[0], "block")])[0] == "blocked"


def test_model_and_tool_hops(spark):
    rows = [
        (1, "s", "request", "/v1/chat/completions?x", "", "", '{"messages":[{"role":"user","content":"hi"}]}'),
        (2, "s", "response", "/v1/chat/completions", "200", "application/json; charset=utf-8", '{"choices":[{"message":{"content":"yo"}}]}'),
        (3, "s", "response", "/v1/chat/completions", "500", "application/json", '{"choices":[{"message":{"content":"yo"}}]}'),
        (4, "s", "response", "/v1/chat/completions", "200", "text/event-stream", "data: x"),
        (5, "s", "request", "/v1/embeddings", "", "", '{"input":"text"}'),
    ]
    frame = spark.createDataFrame(rows, "message_id long, session string, direction string, path string, status string, content_type string, body string")
    assert {(r.message_id, r.surface) for r in G.model_hops(frame).collect()} == {(1, "input"), (2, "output"), (5, "input")}
    tools = spark.createDataFrame(
        [(1, "s", "request", "tools/call", ["a"], '{"name":"f","arguments":{}}'), (2, "s", "response", "tools/list", ["a"], '{"tools":[{"name":"x"}]}'), (3, "s", "response", "resources/read", ["a"], '{"contents":[{"text":"t"}]}'), (4, "s", "request", "ping", ["a"], "{}"), (5, "s", "request", "tools/call", ["a"], "{bad"), (6, "s", "response", "tools/call", ["a"], '{"content":[]}')],
        "message_id long, session string, direction string, method string, services array<string>, body string",
    )
    assert {(r.message_id, r.surface) for r in G.tool_hops(tools).collect()} == {(1, "tool_call"), (2, "tool_definition"), (3, "tool_result")}
    assert [r.message_id for r in G.errors(tools).collect()] == [5]
    hops = G.tool_hops(tools).withColumn("action", F.lit("block")).withColumn("redactions", F.array().cast("array<struct<part:int,start:int,end:int>>"))
    out = {r.message_id: r.outcome for r in G.outcomes(tools, hops).collect()}
    assert out == {1: "blocked", 2: "mutated", 3: "blocked", 4: "pass", 5: "pass", 6: "pass"}


def test_outcomes_are_not_broadcast(spark):
    body = F.expr("""concat('{"tools":[{"name":"a","description":"d', id, '"}]}')""")
    messages = spark.range(50).select(F.col("id").alias("message_id"), F.lit("s").alias("session"), F.lit("response").alias("direction"), F.lit("tools/list").alias("method"), F.array(F.lit("one")).alias("services"), body.alias("body"))
    hops = G.tool_hops(messages).withColumn("action", F.expr("CASE WHEN message_id % 2 = 0 THEN 'block' ELSE 'allow' END")).withColumn("redactions", F.array().cast("array<struct<part:int,start:int,end:int>>"))
    sent = G.outcomes(messages.unionByName(messages.withColumn("message_id", F.col("message_id") + 50)), hops)
    assert {r.message_id: r.outcome for r in sent.collect()} == {i: "mutated" if i < 50 and i % 2 == 0 else "pass" for i in range(100)}
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_bodies_hooks_and_verdict_json(spark):
    chunks = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 0, "x")], "stream int, seq int, chunk string")
    assert {r.stream: r.body for r in G.bodies(chunks).collect()} == {1: "abc", 2: "x"}
    assert [r.surface for r in G.hook_hops(spark.createDataFrame([("pre_call",), ("post_call",)], "hook string")).collect()] == ["input", "output"]
    v = spark.createDataFrame([("allow", [], [], False, "v1"), ("redact", [("pii", "card", 0, 0, 5, 1.0)], [(0, 0, 5)], True, "v1")], "action string, findings array<struct<detector:string,type:string,part:int,start:int,end:int,score:double>>, redactions array<struct<part:int,start:int,end:int>>, taint_session boolean, policy_version string")
    assert [json.loads(r[0]) for r in v.select(G.verdict_json(v)).collect()] == [{"action": "allow", "policy_version": "v1"}, {"action": "redact", "findings": [{"detector": "pii", "type": "card", "span": {"end": 5}, "score": 1.0}], "redactions": [{"end": 5}], "taint_session": True, "policy_version": "v1"}]


def test_captures(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"svc":"a","stream":1,"dir":"in","type":"t","msg":"{}"}\n{"svc":"a","stream":1,"dir":"out","type":"t","msg":"{}"}\n')
    assert G.read_captures(spark, str(tmp_path)).count() == 1
