import pytest
from pyspark.sql import functions as F

from tollgate.operators.policy import Policy, evaluate, evaluate_row, load_policy, merge_rows, parse_policy

TEXT = """
tenant: t
rules:
  - surface: [tool_result]
    when: { detector: injection_heuristic }
    action: flag
    taint_session: true
  - surface: [output, tool_call]
    when: { detector: [pii, secrets], type_in: [card, aws_key] }
    action: redact
  - surface: tool_call
    when: { tool: mail.send, session_tainted: true }
    action: block
  - when: { score_gte: 0.0, type_in: gstin }
    action: redact
  - when: { pin_changed: true }
    action: block
  - surface: input
    action: unknown
    taint_session: true
"""
F_TYPE = "array<struct<detector:string,type:string,part:int,start:int,end:int,score:double>>"


def finding(detector, kind, start=0, end=4, score=1.0):
    return {"detector": detector, "type": kind, "part": 0, "start": start, "end": end, "score": score}


CASES = [
    ("tool_result", "", [finding("injection_heuristic", "role_spoof")], False, False, ("flag", True, [])),
    ("input", "", [finding("injection_heuristic", "role_spoof")], False, False, ("allow", True, [])),
    ("output", "", [finding("pii", "card", 3, 9), finding("pii", "email", 1, 2), finding("pii", "card", 9, 12)], False, False, ("redact", False, [(0, 3, 12)])),
    ("tool_call", "mail.send", [], True, False, ("block", False, [])),
    ("tool_call", "mail.send", [], False, False, ("allow", False, [])),
    ("tool_call", "mail.read", [], True, False, ("allow", False, [])),
    ("tool_definition", "x", [finding("pii", "gstin", 0, 5, 0.0)], False, False, ("redact", False, [(0, 0, 5)])),
    ("tool_definition", "x", [finding("pii", "gstin", 0, 5, 0.0)], False, True, ("block", False, [])),
]


@pytest.mark.parametrize("case", CASES)
def test_row(case):
    surface, source, found, tainted, changed, want = case
    action, taint, spans = evaluate_row(parse_policy(TEXT), surface, source, found, tainted, changed)
    assert (action, taint, merge_rows(spans) if action == "redact" else []) == want


def test_expressions_agree_with_rows(spark):
    rows = [(i, *c[:5]) for i, c in enumerate(CASES)]
    frame = spark.createDataFrame(rows, f"i int, surface string, source string, found {F_TYPE}, tainted boolean, changed boolean")
    out = frame.select("i", evaluate(parse_policy(TEXT), *map(F.col, ("surface", "source", "found", "tainted", "changed"))).alias("d")).orderBy("i").collect()
    assert [(r.d.action, r.d.taint_session, [tuple(s) for s in r.d.redactions]) for r in out] == [c[5] for c in CASES]
    none = frame.select(evaluate(Policy(), *map(F.col, ("surface", "source", "found", "tainted", "changed"))).alias("d")).first().d
    assert (none.action, none.taint_session, none.redactions) == ("allow", False, [])


@pytest.mark.parametrize("bad", ["rules: [{when: {nope: 1}}]", "extra: 1", "rules: [{surface: 3}]", "rules: [{surface: [1]}]", "rules: [{when: {score_gte: high}}]", "rules: [{taint_session: 1}]", "defaults: {on_fail: x}", "a: [", "rules: x"])
def test_strict(bad):
    with pytest.raises(ValueError):
        parse_policy(bad)


def test_defaults(tmp_path):
    assert load_policy(None) == Policy() and Policy().error_action == "block" and Policy().version == "default"
    assert parse_policy("defaults: {on_error: fail_open}").error_action == "allow"
    (tmp_path / "p.yaml").write_text(TEXT)
    p = load_policy(str(tmp_path / "p.yaml"))
    assert len(p.rules) == 6 and len(p.version) == 12 and p.on_error == "fail_closed" and p.rules[2].stateful and p.rules[3].selects
