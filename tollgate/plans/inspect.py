"""The inspection plan: hops -> normalised parts -> findings -> verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.normalize import may_change, normalise_udf
from tollgate.functions.spans import original_span, redact
from tollgate.operators.detectors import Registry, standard
from tollgate.operators.policy import Policy, evaluate
from tollgate.schema import FINDINGS, SURFACES
from tollgate.streaming.session import replay


def content_hash(parts: Column) -> Column:
    """SHA-256 over each part's original text and a zero byte."""
    return F.sha2(F.concat(F.lit("").cast("binary"), F.array_join(F.transform(parts, lambda p: F.concat(F.coalesce(p["text"], F.lit("")), F.lit("\x00"))), "").cast("binary")), 256)


def with_part_findings(parts: DataFrame, registry: Registry, normalise: bool = True) -> DataFrame:
    """Adds to rows (text, part, ...) the normaliser's ``evidence`` and the
    detectors' ``found``, both in original offsets.

    One projection holds the normaliser's struct, so that it runs once a row.
    """
    part = F.col("part").cast("int")
    if not normalise:
        return parts.withColumns({"evidence": F.array().cast(FINDINGS), "found": registry.detect(F.col("text"), part)})
    own = parts.withColumn("n_made", normalise_udf(F.when(may_change(F.col("text")), F.col("text"))))
    own = own.withColumn("n_text", F.coalesce("n_made.text", "text"))
    segments = F.col("n_made.segments")

    def seen(e: Column) -> Column:
        return F.struct(F.lit("injection_heuristic").alias("detector"), e["type"].alias("type"), part.alias("part"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score"))

    def remapped(f: Column) -> Column:
        s = original_span(segments, f["start"], f["end"])
        return F.struct(f["detector"].alias("detector"), f["type"].alias("type"), f["part"].alias("part"), s["start"].alias("start"), s["end"].alias("end"), f["score"].alias("score"))

    evidence = F.coalesce(F.transform("n_made.evidence", seen), F.array().cast(FINDINGS))
    return own.withColumns({"evidence": evidence, "found": F.transform(registry.detect(F.col("n_text"), part), remapped)}).drop("n_made", "n_text")


def findings_by_hop(hops: DataFrame, registry: Registry | None = None, normalise: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """Per hop its findings (all normaliser evidence first, then by detector) and
    the columns ``carry``, which are the same in all its parts.

    Parts are exploded, inspected row by row and put together again by hop id. A
    text is dropped before that shuffle, and the table is read once.
    """
    registry = registry or standard()
    parts = hops.select("hop_id", *carry, F.posexplode_outer("parts").alias("part", "p")).select("hop_id", *carry, "part", F.coalesce("p.text", F.lit("")).alias("text"))
    found = with_part_findings(parts, registry, normalise).select("hop_id", *carry, "part", "evidence", "found")
    order = F.create_map(*[x for i, d in enumerate(registry.detectors) for x in (F.lit(d.name), F.lit(i))]) if registry.detectors else F.create_map(F.lit(""), F.lit(0))
    some = F.when((F.size("evidence") > 0) | (F.size("found") > 0), F.struct("part", "evidence", "found"))
    together = found.groupBy("hop_id").agg(*(F.first(c).alias(c) for c in carry), F.sort_array(F.collect_list(some)).alias("by_part"))
    evidence = F.flatten(F.transform("by_part", lambda x: x["evidence"]))
    detected = F.flatten(F.transform("by_part", lambda x: x["found"]))
    keyed = F.transform(detected, lambda f, i: F.struct(F.element_at(order, f["detector"]).alias("o"), i.alias("i"), f.alias("f")))
    sorted_ = F.transform(F.array_sort(keyed), lambda x: x["f"])
    return together.select("hop_id", *carry, F.concat(evidence, sorted_).alias("findings"))


def detect(hops: DataFrame, registry: Registry | None = None, normalise: bool = True) -> DataFrame:
    """Hops, whole, with their findings."""
    return hops.join(findings_by_hop(hops, registry, normalise), "hop_id")


def valid(hops: DataFrame) -> DataFrame:
    """Hops with ``error``: the surface must be known; unset trust is trusted."""
    parts = F.transform("parts", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"), F.coalesce(F.nullif(p["trust"], F.lit("")), F.lit("trusted")).alias("trust")))
    known = F.coalesce(F.col("surface").isin(*SURFACES), F.lit(False))
    return hops.withColumn("parts", F.coalesce(parts, F.array().cast("array<struct<role:string,text:string,trust:string>>"))).withColumn("error", F.when(~known, F.concat(F.lit("unknown surface "), F.coalesce("surface", F.lit("")))))


def verdicts_without_state(detected: DataFrame, policy: Policy) -> DataFrame:
    """Verdicts for hops that carry session_tainted and pin_changed: a projection, no shuffle."""
    out = evaluate(policy, F.col("surface"), F.col("source"), F.col("findings"), F.col("session_tainted"), F.col("pin_changed"))
    return detected.withColumn("decided", out).select("*", "decided.*").drop("decided").withColumn("policy_version", F.lit(policy.version))


#: What a verdict says of its hop besides the findings.
ABOUT = ("surface", "source", "caller", "content_hash", "error")


def inspect(hops: DataFrame, policy: Policy, registry: Registry | None = None, ttl: float = 3600.0, normalise: bool = True, parts: bool = True) -> DataFrame:
    """Verdicts of a batch of hops, with session state replayed in their order.

    Without ``parts`` a hop is read once, and of its texts only findings and a
    hash are ever shuffled; with them all of its columns are joined to its verdict.
    """
    own = valid(hops).withColumn("content_hash", content_hash(F.col("parts")))
    found = findings_by_hop(own, registry, normalise, [c for c in own.columns if c not in ("hop_id", "parts")])
    if parts:
        decided = own.join(replay(found, policy, ttl).drop("session"), "hop_id")
    else:
        decided = replay(found, policy, ttl, keep=[c for c in ABOUT if c in own.columns])
    return decided.withColumn("policy_version", F.lit(policy.version))


def redacted_parts(verdicts: DataFrame) -> DataFrame:
    """Parts with their redactions applied; other actions leave them alone."""

    def one(p: Column, i: Column) -> Column:
        own = F.filter("redactions", lambda s: s["part"] == i)
        return F.struct(p["role"].alias("role"), redact(p["text"], own).alias("text"), p["trust"].alias("trust"))

    return verdicts.withColumn("parts", F.transform("parts", one))
