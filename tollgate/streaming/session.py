"""Per-session state: taint, pinned tool definitions, blocked tools.

One pure function applies a session's hops in order. Batch replay runs it over
each session's slim rows; the streaming form keeps the same state in Spark's
state store. Detection happens before, on unsharded rows; what is shuffled by
session is a hop's identity, content hash and findings.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.operators.policy import Policy, evaluate_row, merge_rows

_FINDINGS = "array<struct<detector:string,type:string,part:int,start:int,end:int,score:double>>"
DECIDED = f"hop_id bigint, session string, action string, findings {_FINDINGS}, redactions array<struct<part:int,start:int,end:int>>, taint_session boolean, tainted_before boolean, pin_changed boolean, tool_blocked boolean"


class State:
    """A session's state. Entries die at exactly their expiry; a ttl of 0 or less never expires."""

    def __init__(self, taint=None, pins=None, blocked=None):
        self.taint: list | None = taint  # [expiry] in microseconds, expiry None: never
        self.pins: dict[str, list] = pins or {}
        self.blocked: dict[str, list] = blocked or {}

    @staticmethod
    def alive(entry: list | None, now: int) -> bool:
        return entry is not None and (entry[-1] is None or entry[-1] > now)

    def dump(self) -> str:
        return json.dumps([self.taint, self.pins, self.blocked])

    @classmethod
    def load(cls, text: str | None) -> State:
        return cls(*json.loads(text)) if text else cls()


def apply(policy: Policy, state: State, hops: Iterable[dict], ttl: float) -> Iterator[dict]:
    """Decide hops (hop_id, session, ts_us, surface, source, content_hash, findings,
    error) in their order. Hops without a session touch no state; definitions
    and calls without a source name no tool. An error gives the policy's
    on_error action without findings, and what would follow it is not written.
    """
    for h in hops:
        now = int(h["ts_us"])
        expiry = None if ttl <= 0 else now + round(ttl * 1e6)
        session, source, surface = h["session"] or "", h["source"] or "", h["surface"]
        tool = bool(session and source)
        tainted = bool(session) and state.alive(state.taint, now)
        changed = blocked = False
        if surface == "tool_definition" and tool and h.get("error_stage") != "normalize":
            pin = state.pins.get(source)
            if state.alive(pin, now):
                changed = pin[0] != h["content_hash"]
            else:
                state.pins[source] = [h["content_hash"], expiry]
        if surface == "tool_call" and tool:
            blocked = state.alive(state.blocked.get(source), now)
        if h.get("error"):
            yield {"hop_id": h["hop_id"], "session": session, "action": policy.error_action, "findings": [], "redactions": [], "taint_session": False, "tainted_before": tainted, "pin_changed": changed, "tool_blocked": False}
            continue
        found = list(h["findings"])
        action, taint, spans = evaluate_row(policy, surface, source, found, tainted, changed)
        if blocked:
            action = "block"
            found.append({"detector": "tool_state", "type": "tool_blocked", "part": 0, "start": 0, "end": 0, "score": 0.0})
        redactions = [dict(zip(("part", "start", "end"), s, strict=True)) for s in merge_rows(spans)] if action == "redact" else []
        if taint and session:
            state.taint = [expiry]
        if action == "block" and surface == "tool_definition" and tool:
            state.blocked[source] = [expiry]
        yield {"hop_id": h["hop_id"], "session": session, "action": action, "findings": found, "redactions": redactions, "taint_session": taint, "tainted_before": tainted, "pin_changed": changed, "tool_blocked": blocked}


SLIM = ("hop_id", "session", "ts_us", "seq", "surface", "source", "content_hash", "findings", "error")


def slim(hops: DataFrame, *more: str) -> DataFrame:
    """Only what the fold needs: hop_id, session, ts, seq, surface, source, content_hash, findings, error."""
    error = F.col("error") if "error" in hops.columns else F.lit(None).cast("string")
    return hops.select("hop_id", F.coalesce("session", F.lit("")).alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "seq", "surface", F.coalesce("source", F.lit("")).alias("source"), "content_hash", "findings", error.alias("error"), *more)


def _records(frame: pd.DataFrame) -> list[dict]:
    rows = frame.sort_values(["ts_us", "seq", "hop_id"]).to_dict("records")
    for r in rows:
        r["findings"] = [dict(f) for f in (r["findings"] if r["findings"] is not None else [])]
    return rows


def _frame(rows: list[dict], keep: Sequence[str] = ()) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["hop_id", "session", "action", "findings", "redactions", "taint_session", "tainted_before", "pin_changed", "tool_blocked", *keep])


def replay(hops: DataFrame, policy: Policy, ttl: float = 3600.0, salt: int = 64, keep: Sequence[str] = ()) -> DataFrame:
    """Decide a batch of hops, each session in the order of (ts, seq, hop_id).
    ``keep``: string columns that are handed on.

    Hops without a session have no state: they are dealt over ``salt`` groups, so
    that they don't meet in one task. A session is read in sorted batches of
    rows and its state is small, however long it is.
    """
    more = [c for c in keep if c not in SLIM]
    own = slim(hops, *more)
    key = F.when(F.col("session") == "", F.pmod(F.xxhash64("hop_id"), F.lit(salt))).otherwise(F.lit(-1))
    dealt = own.withColumn("salt", key).repartition("session", "salt").sortWithinPartitions("session", "salt", "ts_us", "seq", "hop_id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, State()
        for frame in frames:
            out = []
            for h in frame.to_dict("records"):
                h["findings"] = [dict(f) for f in (h["findings"] if h["findings"] is not None else [])]
                if h["session"] != current:
                    current, state = h["session"], State()
                out += ({**{c: h[c] for c in keep}, **d} for d in apply(policy, state, [h], ttl))
            yield _frame(out, keep)

    return dealt.mapInPandas(fold, ", ".join([DECIDED, *(f"{c} string" for c in keep)]))


def stream(hops: DataFrame, policy: Policy, ttl: float = 3600.0) -> DataFrame:
    """The same over a stream, in order of arrival (within a batch: ts, seq, hop_id).

    State is kept per session with transformWithStateInPandas and needs the
    RocksDB state store. Time mode is "none": expiries are part of the state
    value, so nothing has to wake up for them.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import StringType, StructField, StructType

    class Session(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.store = handle.getValueState("session", StructType([StructField("state", StringType())]))

        def handleInputRows(self, key, rows, timer_values=None):  # noqa: N802
            frames = list(rows)
            if not frames:
                return
            state = State.load(self.store.get()[0] if self.store.exists() else None)
            out = list(apply(policy, state, _records(pd.concat(frames)), ttl))
            if key[0]:
                self.store.update((state.dump(),))
            yield _frame(out)

        def close(self) -> None:
            pass

    return slim(hops).groupBy("session").transformWithStateInPandas(statefulProcessor=Session(), outputStructType=DECIDED, outputMode="Append", timeMode="none")


def taint_by_window(hops: DataFrame, taints: str, ttl: float = 0.0) -> DataFrame:
    """Whether each hop's session was tainted before it, as a running maximum: exact
    where no tainting rule reads state. ``taints``: a boolean expression."""
    from pyspark.sql import Window

    w = Window.partitionBy("session").orderBy("ts", "seq", "hop_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.expr(taints), F.unix_micros(F.col("ts").cast("timestamp")))).over(w)
    live = last.isNotNull() if ttl <= 0 else last + F.lit(round(ttl * 1e6)) > F.unix_micros(F.col("ts").cast("timestamp"))
    return hops.withColumn("tainted_before", F.coalesce(live & (F.col("session") != ""), F.lit(False)))


def pin_drift_by_window(definitions: DataFrame) -> DataFrame:
    """Whether each definition differs from the first of its session and tool (pins that never expire)."""
    from pyspark.sql import Window

    w = Window.partitionBy("session", "source").orderBy("ts", "seq", "hop_id").rowsBetween(Window.unboundedPreceding, 0)
    return definitions.withColumn("pin_changed", F.first("content_hash").over(w) != F.col("content_hash"))
