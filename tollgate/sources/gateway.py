"""Gateway payloads as hops: chat and other model bodies, tool protocol messages,
plain inspection requests, and recorded captures.

JSON is read with numbers as text, so that a body that is changed and written
again keeps them; bodies that are not changed are returned byte for byte.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.spans import MARK
from tollgate.schema import SURFACES

# Keys whose values are no prose (ids, enums, media, signed blobs).
OPAQUE = frozenset(
    "id object type role model status finish_reason stop_reason finishReason system_fingerprint service_tier encoding_format tool_call_id tool_use_id call_id file_id response_id previous_response_id data b64_json media_type mime_type mimeType signature thoughtSignature encrypted_content".split()
)
METHODS = {"call": "tools/call", "list": "tools/list", "read": "resources/read"}
BLOCKED_BODY = '{"error":{"message":"blocked by content policy","type":"policy_block","code":"content_blocked"}}'
BLOCKED_REASON = "blocked by content policy"
#: Surface of each proxy hook.
HOOKS = {"pre_call": "input", "during_call": "input", "post_call": "output"}

_PART = "struct<role:string,text:string,trust:string>"
_FIELD = f"struct<path:string,part:{_PART}>"
HOPS = f"array<struct<seq:int,surface:string,source:string,fields:array<{_FIELD}>>>"


class Number(str):
    """A JSON number as it was written."""


def read_json(body: str):
    def refuse(name: str):
        raise ValueError(name)

    return json.loads(body, parse_float=Number, parse_int=Number, parse_constant=refuse)


def write_json(value) -> str:
    """Compact, keys sorted, numbers as they were, no HTML escapes."""
    if isinstance(value, Number):
        return str.__str__(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{write_json(value[k])}" for k in sorted(value, key=str.encode)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(write_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _is_text(value) -> bool:
    return isinstance(value, str) and not isinstance(value, Number)


def leaves(value, path: tuple = (), prose: bool = False) -> Iterator[tuple[tuple, str]]:
    """(path, string) of all string values, object keys in order; ``prose`` leaves
    out opaque keys' subtrees, empty strings and data addresses."""
    if _is_text(value):
        if path and (not prose or value and not value.startswith("data:")):
            yield path, value
    elif isinstance(value, dict):
        for k in sorted(value, key=str.encode):
            if not (prose and k in OPAQUE):
                yield from leaves(value[k], (*path, k), prose)
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from leaves(x, (*path, i), prose)


def _message_texts(message: dict, path: tuple) -> Iterator[tuple[tuple, str]]:
    content = message.get("content")
    if _is_text(content):
        yield (*path, "content"), content
    elif isinstance(content, list):
        for i, item in enumerate(content):
            if isinstance(item, dict) and item.get("type") == "text" and _is_text(item.get("text")):
                yield (*path, "content", i, "text"), item["text"]


def _hop(seq: int, surface: str, source, fields: list[tuple[tuple, str, str]], trust: str) -> dict:
    return {"seq": seq, "surface": surface, "source": source if _is_text(source) else "", "fields": [{"path": json.dumps(p), "part": {"role": r, "text": t, "trust": trust}} for p, t, r in fields]}


def _object(value) -> dict:
    return value if isinstance(value, dict) else {}


def _list(value) -> list:
    return value if isinstance(value, list) else []


def model_request_hops(body: str, chat: bool) -> list[dict]:
    """A chat body's messages: input first, then tool results; another JSON body's
    prose as input. A body that is no JSON, or has no text, gives no hop."""
    try:
        value = read_json(body)
    except (ValueError, RecursionError, TypeError):
        return []
    if not chat:
        return _any_hops(value, "input")
    top = _object(value)
    said, returned = [], []
    for i, m in enumerate(_list(top.get("messages"))):
        if isinstance(m, dict):
            role = m.get("role") if _is_text(m.get("role")) else ""
            for path, text in _message_texts(m, ("messages", i)):
                (returned if role == "tool" else said).append((path, text, role))
    hops = [("input", said, "trusted"), ("tool_result", returned, "untrusted")]
    return [_hop(k, surface, top.get("model"), own, trust) for k, (surface, own, trust) in enumerate(hops) if own]


def model_response_hops(body: str, chat: bool) -> list[dict]:
    try:
        value = read_json(body)
    except (ValueError, RecursionError, TypeError):
        return []
    if not chat:
        return _any_hops(value, "output")
    top, own = _object(value), []
    for i, c in enumerate(_list(top.get("choices"))):
        message = _object(c).get("message")
        if isinstance(message, dict):
            own += [(p, t, "assistant") for p, t in _message_texts(message, ("choices", i, "message"))]
    return [_hop(0, "output", top.get("model"), own, "trusted")] if own else []


def _any_hops(value, surface: str) -> list[dict]:
    own = [(p, t, "") for p, t in leaves(value, prose=True)]
    return [_hop(0, surface, _object(value).get("model"), own, "trusted")] if own else []


def tool_call_hops(body: str, services: list[str]) -> list[dict]:
    """A call's argument strings; inspected without any, so that state rules hold."""
    top = _object(read_json(body))
    return [_hop(0, "tool_call", top.get("name"), [(("arguments", *p), t, "tool") for p, t in _strings(top.get("arguments"))], "trusted")]


def _strings(value) -> Iterator[tuple[tuple, str]]:
    # A bare string is no leaf of an object or list.
    return iter(()) if _is_text(value) else leaves(value)


def bare_name(name: str, services: list[str]) -> str:
    """A tool's own name where several services share a route: without its service's prefix."""
    if len(services) >= 2:
        for s in services:
            if name.startswith(f"{s}_"):
                return name[len(s) + 1 :]
    return name


def tool_list_hops(body: str, services: list[str]) -> list[dict]:
    """One definition per tool, each with all its strings."""
    out = []
    for i, tool in enumerate(_list(_object(read_json(body)).get("tools"))):
        if isinstance(tool, dict):
            name = tool.get("name") if _is_text(tool.get("name")) else ""
            out.append(_hop(i, "tool_definition", bare_name(name, services), [(("tools", i, *p), t, "tool") for p, t in leaves(tool)], "untrusted"))
    return out


def tool_result_hops(body: str, services: list[str]) -> list[dict]:
    """Text of a result's contents and resources, and all strings of its structured content."""
    top, own = _object(read_json(body)), []
    for key in ("content", "contents"):
        for i, item in enumerate(_list(top.get(key))):
            if isinstance(item, dict):
                if _is_text(item.get("text")):
                    own.append(((key, i, "text"), item["text"], "tool"))
                resource = item.get("resource")
                if isinstance(resource, dict) and _is_text(resource.get("text")):
                    own.append(((key, i, "resource", "text"), resource["text"], "tool"))
    own += [(("structuredContent", *p), t, "tool") for p, t in _strings(top.get("structuredContent"))]
    return [_hop(0, "tool_result", services[0] if len(services) == 1 else "", own, "untrusted")] if own else []


def is_chat(path: Column) -> Column:
    return F.coalesce(F.endswith(F.substring_index(path, "?", 1), F.lit("/chat/completions")), F.lit(False))


def is_json(content_type: Column) -> Column:
    """Whether a media type is JSON; parameters don't matter."""
    return F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))) == "application/json", F.lit(False))


def succeeded(status: Column) -> Column:
    return F.coalesce(status.try_cast("int").between(200, 299), F.lit(False))


def bodies(chunks: DataFrame) -> DataFrame:
    """Bodies put together from chunks (stream, seq, chunk), in the order of seq."""
    return chunks.groupBy("stream").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda c: c["chunk"]), "").alias("body"))


def _hops_udf(make: Callable[[str, object], list[dict]]):
    @F.pandas_udf(f"struct<hops:{HOPS},error:string>")
    def run(body: pd.Series, extra: pd.Series) -> pd.DataFrame:
        out = []
        for b, e in zip(body, extra, strict=True):
            try:
                out.append((make(b or "", e), None))
            except (ValueError, RecursionError) as x:
                out.append(([], f"invalid JSON: {type(x).__name__}"))
        return pd.DataFrame(out, columns=["hops", "error"])

    return run


def _services(e) -> list[str]:
    return [] if e is None else list(e)


def request_session(metadata: Column, headers: Column) -> Column:
    """Session of a request: metadata, x-session-id, mcp-session-id, trace id of a
    traceparent. Empty values fall through; header names ignore case."""
    lower = F.transform(headers, lambda h: F.struct(F.lower(h["key"]).alias("key"), h["value"].alias("value")))

    def header(name: str) -> Column:
        return F.element_at(F.filter(lower, lambda h: h["key"] == name), 1)["value"]

    pieces = F.split(header("traceparent"), "-")
    trace = F.when((F.size(pieces) == 4) & (F.length(pieces[1]) == 32), pieces[1])
    return F.coalesce(F.nullif(metadata["session"], F.lit("")), F.nullif(header("x-session-id"), F.lit("")), F.nullif(header("mcp-session-id"), F.lit("")), trace, F.lit(""))


def response_session(metadata: Column) -> Column:
    return F.coalesce(F.nullif(metadata["session"], F.lit("")), F.nullif(metadata["mcp_session"], F.lit("")), F.lit(""))


def native_tool_name(name: Column, services: Column) -> Column:
    """:func:`bare_name` as an expression."""
    hit = F.element_at(F.filter(services, lambda s: F.startswith(name, F.concat(s, F.lit("_")))), 1)
    return F.when((F.size(services) >= 2) & hit.isNotNull(), F.substring(name, F.length(hit) + 2, F.length(name))).otherwise(name)


def model_hops(messages: DataFrame) -> DataFrame:
    """Hops of model traffic: rows (message_id, session, direction, path, status,
    content_type, body). Requests, and whole successful JSON responses; all else passes."""
    seen = messages.where((F.col("direction") == "request") | (succeeded(F.col("status")) & is_json(F.col("content_type"))))
    make = _hops_udf(lambda b, e: model_request_hops(b, e.endswith("chat")) if e.startswith("request") else model_response_hops(b, e.endswith("chat")))
    kind = F.concat(F.col("direction"), F.when(is_chat(F.col("path")), F.lit("-chat")).otherwise(F.lit("")))
    return _exploded(seen.withColumn("made", make("body", kind)))


def tool_hops(messages: DataFrame) -> DataFrame:
    """Hops of tool traffic: rows (message_id, session, direction, method, services,
    body). Other methods pass; a body that is no JSON has an error and no hop."""
    own = ((F.col("direction") == "request") & (F.col("method") == METHODS["call"]) & (F.length("body") > 0)) | ((F.col("direction") == "response") & F.col("method").isin(*METHODS.values()))
    seen = messages.where(own)
    branches = [
        seen.where(F.col("direction") == "request").withColumn("made", _hops_udf(lambda b, e: tool_call_hops(b, _services(e)))("body", "services")),
        seen.where((F.col("direction") == "response") & (F.col("method") == METHODS["list"])).withColumn("made", _hops_udf(lambda b, e: tool_list_hops(b, _services(e)))("body", "services")),
        seen.where((F.col("direction") == "response") & F.col("method").isin(METHODS["call"], METHODS["read"])).withColumn("made", _hops_udf(lambda b, e: tool_result_hops(b, _services(e)))("body", "services")),
    ]
    return _exploded(branches[0].unionByName(branches[1]).unionByName(branches[2]))


def _exploded(made: DataFrame) -> DataFrame:
    hop = made.select("message_id", "session", F.explode("made.hops").alias("h"))
    fields = F.col("h.fields")
    return hop.select(
        F.concat_ws("/", F.col("message_id").cast("string"), F.col("h.seq").cast("string")).alias("hop_key"),
        "message_id",
        "session",
        F.col("h.seq").alias("seq"),
        F.col("h.surface").alias("surface"),
        F.col("h.source").alias("source"),
        F.transform(fields, lambda f: f["part"]).alias("parts"),
        F.transform(fields, lambda f: f["path"]).alias("paths"),
    )


#: Most bytes of a message, as a receiver bounds it.
LARGEST = 32 << 20


def within_size(messages: DataFrame, limit: int = LARGEST) -> DataFrame:
    """Messages with ``error``: those over the limit are refused whole, never cut."""
    over = F.octet_length("body") > limit
    return messages.withColumns({"error": F.when(over, "message too large"), "body": F.when(over, F.lit(None).cast("string")).otherwise(F.col("body"))})


def errors(messages: DataFrame) -> DataFrame:
    """Tool messages whose body is no JSON: message_id, error (invalid argument)."""
    bad = F.col("body").isNull() | F.call_function("try_parse_json", F.col("body")).isNull()
    own = ((F.col("direction") == "request") & (F.col("method") == METHODS["call"]) & (F.length("body") > 0)) | ((F.col("direction") == "response") & F.col("method").isin(*METHODS.values()))
    return messages.where(own & bad).select("message_id", F.lit("invalid argument").alias("error"))


def _redact(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    for a, b in sorted(spans, reverse=True):
        a, b = min(max(a, 0), len(raw)), min(max(b, 0), len(raw))
        if b > a:
            raw = raw[:a] + MARK.encode() + raw[b:]
    return raw.decode(errors="replace")


def _set(value, path: list, text: str) -> None:
    for k in path[:-1]:
        value = value[k]
    value[path[-1]] = text


def write_back(body: str, decided: list[dict]) -> tuple[str, str]:
    """(outcome, body) of a message after its hops (seq, surface, action, paths,
    parts, redactions): pass, mutated or blocked.

    A blocked definition leaves its tool out of the list; any other block blocks
    the message. Without a change the body is returned as it was.
    """
    decided = sorted(decided, key=lambda d: d["seq"])
    for d in decided:
        if d["action"] == "block" and d["surface"] != "tool_definition":
            return "blocked", BLOCKED_BODY
    try:
        value = read_json(body)
    except (ValueError, RecursionError, TypeError):
        return "pass", body
    gone, changed = set(), False
    for d in decided:
        if d["action"] == "block":
            gone.add(d["seq"])
            changed = True
        elif d["action"] == "redact":
            by_part: dict[int, list[tuple[int, int]]] = {}
            for s in d["redactions"]:
                if 0 <= s["part"] < len(d["paths"]):
                    by_part.setdefault(s["part"], []).append((s["start"], s["end"]))
            for part, spans in by_part.items():
                _set(value, json.loads(d["paths"][part]), _redact(d["parts"][part]["text"], spans))
                changed = True
    if gone:
        value["tools"] = [t for i, t in enumerate(value["tools"]) if i not in gone]
    return ("mutated", write_json(value)) if changed else ("pass", body)


def outcomes(messages: DataFrame, decided: DataFrame) -> DataFrame:
    """What the gateway sends on: message_id, outcome, body. ``decided``: hops with
    message_id, seq, surface, action, paths, parts, redactions.

    The join is by sort and merge: Spark's estimate of the collected hops is far
    below their size, and it would send all of them to the driver to broadcast.
    """
    hops = decided.groupBy("message_id").agg(F.collect_list(F.struct("seq", "surface", "action", "paths", "parts", "redactions")).alias("hops"))

    @F.pandas_udf("struct<outcome:string,body:string>")
    def run(body: pd.Series, found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([write_back(b, [dict(h) for h in hs]) if hs is not None else ("pass", b) for b, hs in zip(body, found, strict=True)], columns=["outcome", "body"])

    return messages.join(hops.hint("merge"), "message_id", "left").withColumn("o", run("body", "hops")).select("message_id", "o.outcome", "o.body")


# Plain inspection requests.

_REQUEST = "surface string, session string, caller string, source string, parts array<struct<role:string,text:string,trust:string>>"


def inspect_requests(lines: DataFrame) -> DataFrame:
    """Requests (request_id, http_method, body) as hops with an HTTP status: 200, 405
    for another method than POST, 400 for malformed JSON or an unknown surface."""
    body = F.from_json("body", _REQUEST, {"mode": "PERMISSIVE"})
    read = lines.withColumn("r", F.when(F.call_function("try_parse_json", F.col("body")).isNotNull(), body))
    status = F.when(F.coalesce("http_method", F.lit("")) != "POST", 405).when(F.col("r").isNull() | ~F.coalesce(F.col("r.surface").isin(*SURFACES), F.lit(False)), 400).otherwise(200)
    parts = F.transform(F.col("r.parts"), lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"), F.coalesce(F.nullif(p["trust"], F.lit("")), F.lit("trusted")).alias("trust")))
    return read.select("request_id", status.alias("status"), "r.surface", "r.session", "r.caller", "r.source", parts.alias("parts"))


def verdict_json(verdicts: DataFrame) -> Column:
    """A verdict as JSON; empty and zero fields are left out."""

    def some(c: Column, kind: str) -> Column:
        return F.when(c != F.lit(0).cast(kind), c)

    def span(s: Column) -> Column:
        return F.struct(some(s["part"], "int").alias("part"), some(s["start"], "int").alias("start"), some(s["end"], "int").alias("end"))

    found = F.transform("findings", lambda f: F.struct(f["detector"].alias("detector"), f["type"].alias("type"), span(f).alias("span"), some(f["score"], "double").alias("score")))
    return F.to_json(F.struct(F.col("action"), F.when(F.size(found) > 0, found).alias("findings"), F.when(F.size("redactions") > 0, F.transform("redactions", span)).alias("redactions"), F.when(F.col("taint_session"), F.lit(True)).alias("taint_session"), F.nullif(F.col("policy_version"), F.lit("")).alias("policy_version")))


def hook_hops(hops: DataFrame) -> DataFrame:
    """Hops of a proxy's hooks (column hook): the hook sets the surface."""
    table = F.create_map(*[x for k, v in HOOKS.items() for x in (F.lit(k), F.lit(v))])
    return hops.withColumn("surface", F.element_at(table, F.col("hook")))


def read_captures(spark: SparkSession, path: str, direction: str = "in") -> DataFrame:
    """Recorded messages (JSON lines: svc, stream, dir, type, msg); only one direction is replayed."""
    return spark.read.schema("svc string, stream int, dir string, type string, msg string").json(path).where(F.col("dir") == direction)
