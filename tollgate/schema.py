"""Row types: hops, parts, findings, verdicts, audit events."""

from __future__ import annotations

# The surfaces, in order, and the actions by severity.
SURFACES = ("tool_definition", "input", "tool_call", "tool_result", "output")
ACTIONS = ("allow", "flag", "redact", "block")

SPAN = "struct<part:int,start:int,end:int>"
#: Offsets are half-open UTF-8 byte positions in the text as it was sent.
FINDING = "struct<detector:string,type:string,part:int,start:int,end:int,score:double>"
FINDINGS = f"array<{FINDING}>"
PART = "struct<role:string,text:string,trust:string>"
HOP = f"hop_id bigint, ts timestamp_ntz, seq int, surface string, session string, caller string, source string, parts array<{PART}>"
VERDICT = f"action string, findings {FINDINGS}, redactions array<{SPAN}>, taint_session boolean, policy_version string"


def severity(action: str) -> int:
    """Rank of an action; -1 for one that is not known, which never wins."""
    return ACTIONS.index(action) if action in ACTIONS else -1
