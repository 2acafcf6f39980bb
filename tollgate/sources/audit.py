"""Audit events: what was decided, never what was said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("time", "trace_id", "session_id", "surface", "caller", "source", "action", "policy_version", "taint_session", "findings", "content_hash", "latency_ms", "error")


def rfc3339(ts: Column) -> Column:
    """UTC time with the fraction's trailing zeros cut."""
    whole, fraction = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.concat(whole, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit("")), F.lit("Z"))


def events(verdicts: DataFrame) -> DataFrame:
    """One event per verdict. Latency has no meaning for a batch and stays null."""

    def has(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in verdicts.columns else F.lit(None).cast(kind)

    found = F.transform("findings", lambda f: F.struct(f["detector"].alias("detector"), f["type"].alias("type"), f["score"].alias("score"), f["part"].alias("part"), f["start"].alias("start"), f["end"].alias("end")))
    return verdicts.select(
        (rfc3339(F.col("ts")) if "ts" in verdicts.columns else F.lit(None).cast("string")).alias("time"),
        has("trace_id").alias("trace_id"),
        F.col("session").alias("session_id"),
        "surface",
        has("caller").alias("caller"),
        "source",
        "action",
        "policy_version",
        "taint_session",
        found.alias("findings"),
        "content_hash",
        F.lit(None).cast("double").alias("latency_ms"),
        has("error").alias("error"),
    )


def write_events(verdicts: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines, one event each; empty values are left out."""
    events(verdicts).write.mode(mode).json(path)


def stream_events(verdicts: DataFrame, path: str, checkpoint: str):
    """The same as a streaming file sink."""
    return events(verdicts).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
