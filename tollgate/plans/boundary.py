"""Queries over sources, sinks and failures: model bodies, sessions of responses,
proxy hooks, captures, audit lines, bodies in chunks, errors, policies, the gate.

Bodies and captures are made from events and documents in a known way, so that
SQL can state what must be read from them.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators import detectors as D
from tollgate.operators.policy import parse_policy, rules_table
from tollgate.plans import evals
from tollgate.plans.queries import _BEFORE, _EVENTS, _LABELS, _OF_TOOL, _quality, POLICY_OF, SEEDS, documents, event_hops, query, sql_spans, table
from tollgate.plans.shipped import SQL_STATE, _inspected, _texts
from tollgate.sources import audit, gateway
from tollgate.streaming import session as S


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``; a session without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return os.path.join(where, f"{name}-{uuid.uuid4().hex}")


# Sources.


def _model_messages(spark: SparkSession, sf: str, direction: str, path: str, body: str, status: str = "'200'", content_type: str = "'application/json'") -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("message_id"), F.col("user_id").cast("string").alias("session"), F.lit(direction).alias("direction"), F.lit(path).alias("path"), F.expr(status).alias("status"), F.expr(content_type).alias("content_type"), F.expr(body).alias("body"))


_ANY = """CASE WHEN event_id % 4 = 3 THEN concat('plain ', event_type) ELSE concat('{"model":"m","id":"x', event_id, '","input":[{"type":"text","text":"', event_type, '"},{"data":"AAAA"},{"url":"data:image/png;base64,AAAA"},7,true,null],"note":"of ', user_id, '","none":"","a":{"role":"r","b":["first"]}}') END"""


@query("SELECT event_id, 'input' AS surface, 'm' AS source, concat('first|', event_type, '|of ', user_id) AS texts FROM events WHERE event_id % 4 <> 3")
def model_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The prose of any JSON body in the order of its keys; ids, media and bodies that are no JSON pass."""
    return _texts(gateway.model_hops(_model_messages(spark, sf, "request", "/v1/responses", _ANY)))


_STATUS = "CASE event_id % 6 WHEN 1 THEN '500' WHEN 3 THEN '204' WHEN 4 THEN CAST(NULL AS STRING) ELSE '200' END"
_TYPE = "CASE event_id % 6 WHEN 2 THEN 'text/event-stream' WHEN 3 THEN 'Application/JSON ; charset=utf-8' WHEN 5 THEN CAST(NULL AS STRING) ELSE 'application/json' END"


@query("SELECT event_id, 'output' AS surface, 'm' AS source, event_type AS texts FROM events WHERE event_id % 6 IN (0, 3)")
def model_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Only whole, successful JSON responses are read."""
    return _texts(gateway.model_hops(_model_messages(spark, sf, "response", "/v1/responses", """concat('{"model":"m","status":"done","output":[{"text":"', event_type, '"}]}')""", _STATUS, _TYPE)))


_CHAT = """concat('{"model":"m","messages":[{"role":"system","content":"be kind"},{"role":"user","content":[{"type":"text","text":"', event_type, '"},{"type":"image_url","text":"no"}]},{"role":"tool","content":"row ', event_id, '"},{"role":"assistant","content":null}]}')"""


@query("SELECT event_id, 'input' AS surface, 'm' AS source, concat('be kind|', event_type) AS texts FROM events UNION ALL SELECT event_id, 'tool_result', 'm', concat('row ', event_id) FROM events")
def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(gateway.model_hops(_model_messages(spark, sf, "request", "/v1/chat/completions?beta=1", _CHAT)))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('s', user_id) WHEN 1 THEN concat('m', user_id) ELSE '' END AS session FROM events")
def response_sessions(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.expr("CASE event_id % 4 WHEN 0 THEN map('session', concat('s', user_id), 'mcp_session', 'other') WHEN 1 THEN map('session', '', 'mcp_session', concat('m', user_id)) WHEN 2 THEN map('other', 'x') END")
    return table(spark, sf, "events").select("event_id", gateway.response_session(kept).alias("session"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'output' ELSE 'input' END AS surface FROM events")
def hook_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    hops = table(spark, sf, "events").select("event_id", F.lit("").alias("surface"), F.expr("CASE event_id % 3 WHEN 0 THEN 'pre_call' WHEN 1 THEN 'during_call' ELSE 'post_call' END").alias("hook"))
    return gateway.hook_hops(hops).select("event_id", "surface")


@query("SELECT concat('svc_', event_id % 3) AS svc, CAST(event_id AS INTEGER) AS stream, event_type AS type, coalesce(props, '') AS msg FROM events WHERE event_id % 2 = 0")
def captured_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Captures written as JSON lines and replayed in one direction."""
    path = shared_folder(spark, "captures")
    e = table(spark, sf, "events")
    e.select(F.expr("concat('svc_', event_id % 3)").alias("svc"), F.col("event_id").alias("stream"), F.expr("CASE event_id % 2 WHEN 0 THEN 'in' ELSE 'out' END").alias("dir"), F.col("event_type").alias("type"), F.coalesce("props", F.lit("")).alias("msg")).write.json(path)
    return gateway.read_captures(spark, path).select("svc", "stream", "type", "msg")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS body_sha256 FROM documents")
def chunked_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies that arrive in chunks of 1000 characters, put together by their numbers."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("stream"), F.coalesce("text", F.lit("")).alias("text"))
    cut = docs.select("stream", "text", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 1000).cast("int"))).alias("seq"))
    chunks = cut.select("stream", "seq", F.substring("text", F.col("seq") * 1000 + 1, 1000).alias("chunk"))
    return gateway.bodies(chunks).select(F.col("stream").alias("doc_id"), F.sha2("body", 256).alias("body_sha256"))


# Errors.


@query("SELECT event_id, 'invalid argument' AS error FROM events WHERE event_id % 4 = 0")
def tool_body_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Calls whose body is no JSON; an empty body passes."""
    body = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"name":"t', event_id) WHEN 1 THEN '' WHEN 2 THEN '{"name":"t"}' ELSE '[]' END""")
    e = table(spark, sf, "events").select(F.col("event_id").alias("message_id"), F.lit("request").alias("direction"), F.lit("tools/call").alias("method"), body.alias("body"))
    return gateway.errors(e).select(F.col("message_id").alias("event_id"), "error")


_FAILED = "event_type <> 'click' AND event_id % 3 = 0"
_FAILING = f"(SELECT h.*, {_FAILED} AS failed FROM (SELECT * FROM {_EVENTS}) h JOIN events v ON v.event_id = h.hop_id) f"
_MADE = "surface = 'tool_definition' AND NOT failed"


def _failing(action: str) -> str:
    return f"""SELECT hop_id, '{action}' AS on_failure, CASE WHEN failed THEN '{action}' WHEN surface = 'tool_definition' THEN 'block'
  WHEN surface = 'tool_call' AND coalesce(max(CASE WHEN {_MADE} THEN 1 END) OVER ({_OF_TOOL}), 0) = 1 THEN 'block' ELSE 'allow' END AS action,
  coalesce(max(CASE WHEN {_MADE} THEN 1 END) OVER ({_BEFORE}), 0) = 1 AS tainted_before, {_MADE} AS taint_session FROM {_FAILING}"""


@query(f"{_failing('allow')} UNION ALL {_failing('block')}")
def failed_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Hops that fail get the policy's action on errors and write no state."""
    kinds = table(spark, sf, "events").select(F.col("event_id").alias("hop_id"), F.when(F.expr(_FAILED), "detector failed").alias("error"))
    hops = event_hops(spark, sf).join(kinds, "hop_id").withColumn("findings", D.none())
    out = []
    for on_error, action in (("fail_open", "allow"), ("something else", "block")):
        policy = parse_policy(f"defaults: {{ on_error: {on_error} }}\nrules:\n  - surface: tool_definition\n    action: block\n    taint_session: true\n")
        out.append(S.replay(hops, policy, ttl=0).select("hop_id", F.lit(action).alias("on_failure"), "action", "tainted_before", "taint_session"))
    return out[0].unionByName(out[1])


# Policies, dictionaries, sinks, the gate.


def _joined(c: str) -> Column:
    return F.concat_ws(",", c).alias(c)


@query("""SELECT * FROM (VALUES (0, '', 'injection_heuristic', '', CAST(0.8 AS DOUBLE), '', NULL, NULL, 'block', true), (1, 'output,tool_result', 'pii,secrets', 'card,email,aws_key', NULL, '', NULL, NULL, 'redact', false),
  (2, 'tool_result', 'exfil_url', '', NULL, '', NULL, NULL, 'flag', false), (3, 'tool_call', '', '', NULL, '', true, NULL, 'block', false), (4, 'tool_definition', '', '', NULL, '', NULL, true, 'block', false))
  r(rule_id, surface, detector, type_in, score_gte, tool, session_tainted, pin_changed, action, taint_session)""")
def policy_rules(spark: SparkSession, sf: str) -> DataFrame:
    """A policy file's rules as rows: strings and lists, conditions that are not stated null."""
    return rules_table(spark, POLICY_OF).select("rule_id", _joined("surface"), _joined("detector"), _joined("type_in"), "score_gte", "tool", "session_tainted", "pin_changed", "action", "taint_session")


_PATTERN = "proj[a-z]+ Blue[A-Z][a-z]+|AKIA[A-Z]{4}"


@query(f"SELECT doc_id, 'custom_dict' AS detector, 'custom_term' AS type, start_byte, end_byte, CAST(1.0 AS DOUBLE) AS score FROM {sql_spans(SEEDS, 'doc_id', _PATTERN)} s")
def dict_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """A tenant's patterns; a term inside of a longer hit isn't told twice."""
    own = D.CustomDict(("project bluebird",), (_PATTERN,))
    found = documents(spark, sf).select("doc_id", F.explode(own.detect(F.col("text"), F.lit(0))).alias("f"))
    return found.select("doc_id", "f.detector", "f.type", F.col("f.start").alias("start_byte"), F.col("f.end").alias("end_byte"), "f.score")


#: Values that say which hop it was. They hold no text of it, but a session's number or a hash may have the digits of a card.
_NAMES = '"session_id":"-?[0-9]*"|"content_hash":"[0-9a-f]{64}"'


def holds_content(line: Column) -> Column:
    """Whether a line of the audit log has a piece of a hop's text outside of the values that name it."""
    return F.regexp_replace(line, _NAMES, "").rlike("4111|jane|evil|nothing here|Ignore|hel")


@query(f"""SELECT surface, action, count(*) AS n, sum(n_findings)::BIGINT AS n_findings, count(*) FILTER (WHERE taint_session) AS n_taints, CAST(0 AS BIGINT) AS n_with_content,
  count(DISTINCT content_hash) AS n_hashes FROM ({SQL_STATE}) s GROUP BY surface, action""")
def audit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts written as JSON lines and read back as text: counts by path, and no content."""
    path = shared_folder(spark, "audit")
    audit.write_events(_inspected(spark, sf), path)
    line = spark.read.text(path).withColumnRenamed("value", "line")
    at = {name: F.get_json_object("line", f"$.{name}") for name in ("surface", "action", "taint_session", "content_hash")}
    read = line.select("line", *(c.alias(k) for k, c in at.items()), F.coalesce(F.json_array_length(F.get_json_object("line", "$.findings")), F.lit(0)).cast("long").alias("found"))
    return read.groupBy("surface", "action").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("found").alias("n_findings"),
        F.count(F.when(F.col("taint_session") == "true", 1)).alias("n_taints"),
        F.count(F.when(holds_content(F.col("line")), 1)).alias("n_with_content"),
        F.count_distinct("content_hash").alias("n_hashes"),
    )


_COUNTS = f"(SELECT split_part(label, '/', 1) AS detector, count(*) FILTER (WHERE expected AND produced) AS tp, count(*) FILTER (WHERE produced AND NOT expected) AS fp, count(*) FILTER (WHERE expected AND NOT produced) AS fn FROM {_LABELS} WHERE expected OR produced GROUP BY 1) c"


@query(f"SELECT detector, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE floor(tp / (tp + fp) * 10000 + 0.5) / 10000 END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE floor(tp / (tp + fn) * 10000 + 0.5) / 10000 END AS recall FROM {_COUNTS}")
def eval_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall per detector, as the report states them."""
    own = evals.summarize(_quality(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "expected", "produced", "missing", "extra", ((F.size("missing") == 0) & (F.size("extra") == 0)).alias("passed")))
    rows = [(name, s["tp"], s["fp"], s["fn"], s["precision"], s["recall"]) for name, s in own["per_detector"].items()]
    return spark.createDataFrame(rows, "detector string, tp long, fp long, fn long, precision double, recall double")


@query("SELECT concat('case ', event_id, ' passed in the baseline and fails now') AS failure FROM events WHERE event_id % 200 = 7 UNION ALL SELECT 'pii: recall ' || printf('%.4f', floor(count(*) FILTER (WHERE event_id % 200 <> 7) / count(*) * 10000 + 0.5) / 10000) || ' is below the baseline''s 1.0000' FROM events HAVING count(*) FILTER (WHERE event_id % 200 = 7) / count(*) > 0.005")
def eval_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A run held against its baseline: cases that passed and scores that fell."""
    label, none = F.array(F.lit("pii/email")), F.array().cast("array<string>")

    def run(lost: Column) -> DataFrame:
        cases = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), label.alias("expected"), F.when(lost, none).otherwise(label).alias("produced"))
        return cases.withColumns({"missing": F.array_except("expected", "produced"), "extra": F.array_except("produced", "expected"), "passed": ~lost})

    return evals.gate(run(F.expr("id % 200 = 7")), run(F.lit(False)))
