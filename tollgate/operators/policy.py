"""Declarative rules: parsing, and evaluation as column expressions or in Python.

Rules that only read the row compile into expressions, so that evaluating a
policy is a projection without a join. The Python form is for the session
fold, where one hop's outcome changes the next hop's input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.spans import let, merge_spans
from tollgate.schema import ACTIONS, severity

_RULE = {"surface", "when", "action", "taint_session"}
_WHEN = {"detector", "score_gte", "type_in", "tool", "session_tainted", "pin_changed"}
_TOP = {"tenant", "defaults", "rules"}


@dataclass(frozen=True)
class Rule:
    """Null and empty conditions hold for all; false is a real condition."""

    surface: tuple[str, ...] = ()
    detector: tuple[str, ...] = ()
    type_in: tuple[str, ...] = ()
    score_gte: float | None = None
    tool: str = ""
    session_tainted: bool | None = None
    pin_changed: bool | None = None
    action: str = ""
    taint_session: bool = False

    @property
    def selects(self) -> bool:
        """Whether the rule is about findings, not just about the hop."""
        return bool(self.detector or self.type_in) or self.score_gte is not None

    @property
    def stateful(self) -> bool:
        return self.session_tainted is not None or self.pin_changed is not None


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...] = ()
    on_error: str = "fail_closed"
    tenant: str = ""
    version: str = "default"
    text: str = field(default="", repr=False)

    @property
    def error_action(self) -> str:
        """What a failed hop gets: anything but fail_open blocks."""
        return "allow" if self.on_error == "fail_open" else "block"


def _strings(value, where: str) -> tuple[str, ...]:
    if value is None:
        return ()
    if isinstance(value, str):
        return (value,)
    if isinstance(value, list) and all(isinstance(x, str) for x in value):
        return tuple(value)
    raise ValueError(f"{where}: a string or a list of strings is needed")


def _known(value, keys: set[str], where: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ValueError(f"{where}: a mapping is needed")
    if extra := sorted(map(str, set(value) - keys)):
        raise ValueError(f"{where}: unknown key {extra[0]}")
    return value


def _typed(value, kind, where: str):
    if value is None or (isinstance(value, kind) and (kind is bool or not isinstance(value, bool))):
        return value
    raise ValueError(f"{where}: wrong type")


def parse_policy(text: str | bytes) -> Policy:
    """A policy from YAML. Unknown keys and wrong types are errors; unknown
    actions are kept, and never win. The version is the first 12 hex digits of
    the text's SHA-256."""
    raw = text.encode() if isinstance(text, str) else text
    try:
        top = _known(yaml.safe_load(raw), _TOP, "policy")
    except yaml.YAMLError as e:
        raise ValueError(f"policy: {e}") from e
    defaults = _known(top.get("defaults"), {"on_error"}, "defaults")
    rules = []
    for i, r in enumerate(_typed(top.get("rules"), list, "rules") or []):
        where = f"rule {i}"
        r = _known(r, _RULE, where)
        w = _known(r.get("when"), _WHEN, f"{where}: when")
        score = _typed(w.get("score_gte"), (int, float), f"{where}: score_gte")
        rules.append(
            Rule(
                surface=_strings(r.get("surface"), f"{where}: surface"),
                detector=_strings(w.get("detector"), f"{where}: detector"),
                type_in=_strings(w.get("type_in"), f"{where}: type_in"),
                score_gte=None if score is None else float(score),
                tool=_typed(w.get("tool"), str, f"{where}: tool") or "",
                session_tainted=_typed(w.get("session_tainted"), bool, f"{where}: session_tainted"),
                pin_changed=_typed(w.get("pin_changed"), bool, f"{where}: pin_changed"),
                action=_typed(r.get("action"), str, f"{where}: action") or "",
                taint_session=bool(_typed(r.get("taint_session"), bool, f"{where}: taint_session")),
            )
        )
    return Policy(tuple(rules), _typed(defaults.get("on_error"), str, "on_error") or "fail_closed", _typed(top.get("tenant"), str, "tenant") or "", hashlib.sha256(raw).hexdigest()[:12], raw.decode())


def load_policy(path: str | None) -> Policy:
    """The policy of a file; without one: no rules, closed on errors, version ``default``."""
    if not path:
        return Policy()
    with open(path, "rb") as f:
        return parse_policy(f.read())


def rules_table(spark: SparkSession, policy: Policy) -> DataFrame:
    """The rules as rows, for reports."""
    schema = "rule_id int, surface array<string>, detector array<string>, type_in array<string>, score_gte double, tool string, session_tainted boolean, pin_changed boolean, action string, taint_session boolean"
    return spark.createDataFrame([(i, list(r.surface), list(r.detector), list(r.type_in), r.score_gte, r.tool, r.session_tainted, r.pin_changed, r.action, r.taint_session) for i, r in enumerate(policy.rules)], schema)


def _selected(rule: Rule, found: Column) -> Column:
    """The findings that satisfy all of a rule's conditions at once."""
    if not rule.selects:
        return found

    def holds(f: Column) -> Column:
        ok = F.lit(True)
        if rule.detector:
            ok &= f["detector"].isin(*rule.detector)
        if rule.type_in:
            ok &= f["type"].isin(*rule.type_in)
        if rule.score_gte is not None:
            ok &= f["score"] >= rule.score_gte
        return ok

    return F.filter(found, holds)


def matches(rule: Rule, surface: Column, source: Column, found: Column, tainted: Column, pin_changed: Column) -> Column:
    ok = F.lit(True)
    if rule.surface:
        ok &= surface.isin(*rule.surface)
    if rule.tool:
        ok &= source == rule.tool
    if rule.session_tainted is not None:
        ok &= tainted == rule.session_tainted
    if rule.pin_changed is not None:
        ok &= pin_changed == rule.pin_changed
    if rule.selects:
        ok &= F.size(_selected(rule, found)) > 0
    return F.coalesce(ok, F.lit(False))


NO_SPANS = "array<struct<part:int,start:int,end:int>>"


def evaluate(policy: Policy, surface: Column, source: Column, found: Column, tainted: Column, pin_changed: Column) -> Column:
    """A struct: action (the most severe of all matching rules), taint_session (of
    any), and the merged redactions (of redact rules, when the action is redact).

    ``found`` is computed once a row, and each rule is matched once.
    """

    def decided(own: Column) -> Column:
        hits = F.array(*(matches(r, surface, source, own, tainted, pin_changed) for r in policy.rules)) if policy.rules else F.array().cast("array<boolean>")
        return let(hits, lambda hit: outcome(own, hit))

    def outcome(own: Column, hit: Column) -> Column:
        def of(i: int) -> Column:
            return F.element_at(hit, i + 1)

        ranks = [F.when(of(i), F.lit(severity(r.action))) for i, r in enumerate(policy.rules) if r.action in ACTIONS]
        action = F.element_at(F.array(*map(F.lit, ACTIONS)), F.greatest(F.lit(0), *ranks) + 1) if ranks else F.lit("allow")
        taint = F.lit(False)
        for i, r in enumerate(policy.rules):
            if r.taint_session:
                taint |= of(i)
        none = F.array().cast(NO_SPANS)
        spans = [F.when(of(i), F.transform(_selected(r, own), lambda f: F.struct(f["part"].alias("part"), f["start"].alias("start"), f["end"].alias("end")))).otherwise(none) for i, r in enumerate(policy.rules) if r.action == "redact"]
        redactions = F.when(action == "redact", merge_spans(F.concat(*spans))).otherwise(none) if spans else none
        return F.struct(action.alias("action"), taint.alias("taint_session"), redactions.alias("redactions"))

    return let(found, decided)


def evaluate_row(policy: Policy, surface: str, source: str, found: Sequence[dict], tainted: bool, pin_changed: bool) -> tuple[str, bool, list[tuple[int, int, int]]]:
    """The same for one hop in Python: action, taint, redaction spans (not merged)."""
    best, taint, spans = 0, False, []
    for r in policy.rules:
        if r.surface and surface not in r.surface or r.tool and r.tool != source:
            continue
        if r.session_tainted is not None and r.session_tainted != tainted or r.pin_changed is not None and r.pin_changed != pin_changed:
            continue
        own = found
        if r.selects:
            own = [f for f in found if (not r.detector or f["detector"] in r.detector) and (not r.type_in or f["type"] in r.type_in) and (r.score_gte is None or f["score"] >= r.score_gte)]
            if not own:
                continue
        best, taint = max(best, severity(r.action)), taint or r.taint_session
        if r.action == "redact":
            spans += [(f["part"], f["start"], f["end"]) for f in own]
    return ACTIONS[best], taint, spans


def merge_rows(spans: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for part, a, b in sorted(spans):
        if out and out[-1][0] == part and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([part, a, b])
    return [tuple(x) for x in out]
