"""Detector quality over labelled cases, and the gate against a baseline."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators.detectors import standard
from tollgate.plans.inspect import with_part_findings

CASE = "id string, note string, surface string, text string, expect array<struct<detector:string,type:string>>, synthetic boolean, dict array<string>, allowed_domains array<string>"
TOLERANCE = 0.005


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of all JSON files (arrays) under ``path``; a repeated id is an error."""
    cases = spark.read.schema(CASE).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    twice = cases.groupBy("id").count().where("count > 1").orderBy("id").first()
    if twice:
        raise ValueError(f"duplicate case id: {twice['id']}")
    return cases


def run_cases(cases: DataFrame) -> DataFrame:
    """Per case: id, expected, produced, missing, extra (sorted detector/type labels), passed.

    Cases with the same dictionary and allow-list are run together.
    """
    keyed = cases.withColumn("setting", F.to_json(F.struct(F.coalesce("dict", F.array().cast("array<string>")).alias("dict"), F.col("allowed_domains").alias("allowed"))))
    out = None
    for (setting,) in keyed.select("setting").distinct().orderBy("setting").collect():
        own, s = keyed.where(F.col("setting") == setting), json.loads(setting)
        found = with_part_findings(own.withColumn("part", F.lit(0)), standard(s["dict"], (), s.get("allowed")))
        done = found.withColumn("findings", F.concat("evidence", "found")).drop("evidence", "found")
        out = done if out is None else out.unionByName(done)
    label = "concat({0}.detector, '/', {0}.type)"
    labels = out.select(
        "id",
        F.expr(f"array_sort(array_distinct(transform(coalesce(expect, array()), x -> {label.format('x')})))").alias("expected"),
        F.expr(f"array_sort(array_distinct(transform(findings, x -> {label.format('x')})))").alias("produced"),
    )
    done = labels.withColumns({"missing": F.array_except("expected", "produced"), "extra": F.array_except("produced", "expected")})
    return done.withColumn("passed", (F.size("missing") == 0) & (F.size("extra") == 0))


def _ratio(a: int, b: int) -> float:
    return 1.0 if b == 0 else _round(a / b)


def _round(x: float) -> float:
    return int(x * 10000 + 0.5) / 10000


def confusion(results: DataFrame) -> DataFrame:
    """Per detector: tp, fp, fn over labels."""

    def of(column: str, kind: str) -> DataFrame:
        return results.select(F.explode(column).alias("label")).select(F.substring_index("label", "/", 1).alias("detector"), F.lit(kind).alias("kind"))

    right = results.withColumn("right", F.array_intersect("produced", "expected"))
    every = of("extra", "fp").unionByName(of("missing", "fn")).unionByName(right.select(F.explode("right").alias("label")).select(F.substring_index("label", "/", 1).alias("detector"), F.lit("tp").alias("kind")))
    return every.groupBy("detector").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("tp", "fp", "fn")))


def totals(results: DataFrame) -> dict:
    """Counts, false-positive rate over cases that expect nothing, scores per detector. Only sums leave Spark."""
    negative = F.size("expected") == 0
    n = results.agg(F.count(F.lit(1)).alias("cases"), F.count(F.when(negative, 1)).alias("negatives"), F.count(F.when(negative & (F.size("produced") > 0), 1)).alias("loud")).collect()[0]
    scores = {}
    for r in confusion(results).collect():
        p, q = _ratio(r.tp, r.tp + r.fp), _ratio(r.tp, r.tp + r.fn)
        scores[r.detector] = {"tp": r.tp, "fp": r.fp, "fn": r.fn, "precision": p, "recall": q, "f1": _round(2 * p * q / (p + q)) if p + q else 0.0}
    return {"cases": n.cases, "negatives": n.negatives, "fp_rate": _round(n.loud / n.negatives) if n.negatives else 0.0, "per_detector": dict(sorted(scores.items()))}


def summarize(results: DataFrame) -> dict:
    """:func:`totals` and the outcome of every case, for a report or a baseline file; all cases go to the driver."""
    return totals(results) | {"per_case": {r.id: r.passed for r in sorted(results.select("id", "passed").collect())}}


def _worse(now: dict, baseline: dict) -> list[str]:
    """What :func:`totals` say that got worse."""
    out = []
    if now["cases"] != baseline["cases"]:
        out.append(f"case count {now['cases']} differs from the baseline's {baseline['cases']}")
    if now["fp_rate"] > baseline["fp_rate"] + TOLERANCE:
        out.append(f"false-positive rate {now['fp_rate']:.4f} is above the baseline's {baseline['fp_rate']:.4f}")
    for name, want in baseline["per_detector"].items():
        got = now["per_detector"].get(name)
        if got is None:
            out.append(f"detector {name} reported nothing")
            continue
        out += [f"{name}: {m} {got[m]:.4f} is below the baseline's {want[m]:.4f}" for m in ("precision", "recall") if got[m] < want[m] - TOLERANCE]
    return out


_NOT_RUN, _FAILS = "was not run", "passed in the baseline and fails now"


def check(now: dict, baseline: dict) -> list[str]:
    """What got worse than the baseline, sorted. A case that passed may not fail, whatever the means say."""
    out = _worse(now, baseline)
    for case, passed in baseline["per_case"].items():
        if case not in now["per_case"]:
            out.append(f"case {case} {_NOT_RUN}")
        elif passed and not now["per_case"][case]:
            out.append(f"case {case} {_FAILS}")
    return sorted(out)


def gate(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """:func:`check` of two runs' results, as rows (failure) in any order.

    Cases are held against each other by one shuffle of ids, and none goes to the
    driver. Of rows that share an id one that passed counts, as in a summary. Both
    frames are read several times.
    """
    said, passed, none = _worse(totals(now), totals(baseline)), F.coalesce("passed", F.lit(False)), F.lit(None).cast("boolean")
    both = now.select("id", passed.alias("now"), none.alias("then")).unionByName(baseline.select("id", none.alias("now"), passed.alias("then")))
    cases = both.groupBy("id").agg(F.max("now").alias("now"), F.max("then").alias("then")).where("then is not null and (now is null or then and not now)")
    why = F.when(F.col("now").isNull(), _NOT_RUN).otherwise(_FAILS)
    failed = cases.select(F.concat_ws(" ", F.lit("case"), F.coalesce(F.col("id").cast("string"), F.lit("None")), why).alias("failure"))
    return failed.unionByName(now.sparkSession.createDataFrame([(f,) for f in said], "failure string"))


def write_baseline(path: str, subset: str, summary: dict) -> None:
    """Merge a summary into the baseline file under its subset's key."""
    try:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
    except FileNotFoundError:
        whole = {}
    whole[subset] = summary
    with open(path, "w", encoding="utf-8") as f:
        json.dump(whole, f, indent=2)
        f.write("\n")


def main(argv: list[str] | None = None) -> int:
    """``python -m tollgate.plans.evals --cases DIR [--check FILE] [--write-baseline FILE] [--report FILE]``"""
    import argparse
    import sys

    import tollgate

    args = argparse.ArgumentParser()
    args.add_argument("--cases", required=True)
    args.add_argument("--check")
    args.add_argument("--write-baseline")
    args.add_argument("--report")
    args.add_argument("--subset", default="fast")
    a = args.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    tollgate.ship(spark)
    summary = summarize(run_cases(load_cases(spark, a.cases)).cache())
    if a.report:
        write_baseline(a.report, a.subset, summary)
    if a.write_baseline:
        write_baseline(a.write_baseline, a.subset, summary)
    failures = []
    if a.check:
        with open(a.check, encoding="utf-8") as f:
            failures = check(summary, json.load(f)[a.subset])
    for f in failures:
        print(f, file=sys.stderr)
    return int(bool(failures))


if __name__ == "__main__":
    raise SystemExit(main())
