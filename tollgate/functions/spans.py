"""Span algebra as built-in expressions: no UDF, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgate.functions.patterns import NEEDS, java

HIT = "struct<start:int,end:int,text:string>"
MARK = "[REDACTED]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def may_match(text: Column, pattern: str) -> Column:
    """Whether a text can match at all: plain substrings first, then the pattern itself."""
    words, simple = NEEDS.get(pattern, ((), ""))
    ok = text.rlike(java(pattern))
    if simple:
        ok = text.rlike(simple) & ok
    if words:
        if (name := _NAME.fullmatch(str(text))) and words not in (("@",), ("![",)):
            folded = f"translate(lower(`{name[1]}`), '\u017f\u212a', 'sk')" if any(w.isalpha() for w in words) else f"lower(`{name[1]}`)"
            return F.expr(f"element_at(transform(array({folded}), t -> {' OR '.join(f'contains(t, {_quoted(w)})' for w in words)}), 1)") & ok
        # Case folding knows two more letters than lower-casing: the long s and the Kelvin sign.
        plain = any(w.isalpha() for w in words)
        folded = F.translate(F.lower(text), "\u017f\u212a", "sk") if plain else F.lower(text)
        found = let(folded, lambda t: _any(t, words)) if len(words) > 1 else folded.contains(words[0])
        ok = (text.contains(words[0]) if words in (("@",), ("![",)) else found) & ok
    return ok


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out |= text.contains(w)
    return out


#: A column's plain name.
_NAME = re.compile(r"Column<'([A-Za-z_][A-Za-z0-9_]*)'>")

_FOUND = f"""aggregate(
  element_at(transform(array(regexp_extract_all(%(text)s, %(pattern)s, 0)), hits ->
    zip_with(slice(split(%(text)s, %(pattern)s, -1), 1, size(hits)), hits, (g, h) -> named_struct('gap', g, 'hit', h))), 1),
  named_struct('at', 0, 'out', cast(array() AS array<{HIT}>)),
  (acc, pair) -> named_struct('at', acc.at + octet_length(pair.gap) + octet_length(pair.hit), 'out', concat(acc.out, array(named_struct(
    'start', acc.at + octet_length(pair.gap), 'end', acc.at + octet_length(pair.gap) + octet_length(pair.hit), 'text', pair.hit)))),
  acc -> acc.out)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as (start, end, text), offsets in bytes.

    The pieces between matches and the matches themselves give the offsets by
    running sums of byte lengths. Text without a match costs a scan for what the
    pattern needs. The pattern must not match the empty string. Null text has no
    matches.

    The expression is given to Spark as SQL, in one call: built column by column
    it would take longer than many a table takes to search.
    """
    name = _NAME.fullmatch(str(text))
    if not name:
        return _spans_of(text, pattern)
    found = F.expr(_FOUND % {"text": f"`{name[1]}`", "pattern": _quoted(java(pattern))})
    return F.when(may_match(text, pattern), found).otherwise(F.array().cast(f"array<{HIT}>"))


def _spans_of(text: Column, pattern: str) -> Column:
    """The same for any expression."""
    p = java(pattern)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{HIT}>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.octet_length(pair["gap"])
        end = start + F.octet_length(pair["hit"])
        found = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), pair["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    def paired(hits: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, p, -1), 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))

    pairs = let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), paired)
    found = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.when(may_match(text, pattern), found).otherwise(F.array().cast(f"array<{HIT}>"))


def merge_spans(spans: Column) -> Column:
    """Union of overlapping and touching (part, start, end), per part, ascending."""
    empty = F.array().cast("array<struct<part:int,start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (last["part"] == s["part"]) & (s["start"] <= last["end"])
        wider = F.struct(last["part"].alias("part"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(s)))

    def merged(own: Column) -> Column:
        return F.when(F.size(own) <= 1, own).otherwise(F.aggregate(own, empty, step))

    return let(F.array_sort(F.transform(spans, lambda s: F.struct(s["part"].alias("part"), s["start"].alias("start"), s["end"].alias("end")))), merged)


def suppress_contained(findings: Column) -> Column:
    """Drop findings that lie inside another of their part (or equal one that
    comes first): by start, longer first, higher score first, then as found."""
    zero = F.struct(F.lit(-1).alias("part"), F.lit(-1).alias("reach"), F.array().cast("array<struct<detector:string,type:string,part:int,start:int,end:int,score:double>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        inside = (acc["part"] == k["p"]) & (k["f"]["end"] <= acc["reach"])
        reach = F.when(acc["part"] == k["p"], F.greatest(acc["reach"], k["f"]["end"])).otherwise(k["f"]["end"])
        return F.struct(k["p"].alias("part"), reach.alias("reach"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(k["f"]))).alias("out"))

    def kept(own: Column) -> Column:
        keyed = F.transform(own, lambda f, i: F.struct(f["part"].alias("p"), f["start"].alias("s"), (-f["end"]).alias("e"), (-f["score"]).alias("c"), i.alias("i"), f.alias("f")))
        return F.when(F.size(own) < 2, own).otherwise(F.aggregate(F.array_sort(keyed), zero, step, lambda acc: acc["out"]))

    return let(findings, kept)


def near_any(hit: Column, anchors: Column, window: int) -> Column:
    """Whether a span is within ``window`` bytes of one of the anchors (a range semi-join within the row)."""
    return F.exists(anchors, lambda a: (hit["start"] < a["end"] + window) & (a["start"] < hit["end"] + window))


def original_span(segments: Column, start: Column, end: Column) -> Column:
    """(start, end) in the original text of a span of the normalised one.

    ``segments``: (ns, ne, os, oe), ascending, without gaps; null or empty
    leaves offsets alone. A segment of equal length maps byte by byte; of another
    one every byte maps to the whole original run.
    """
    first, last = F.element_at(segments, 1), F.element_at(segments, -1)

    def at(p: Column, holds) -> Column:
        return F.element_at(F.filter(segments, holds), 1)

    def same(s: Column) -> Column:
        return s["ne"] - s["ns"] == s["oe"] - s["os"]

    s1 = at(start, lambda s: s["ne"] > start)
    e1 = at(end, lambda s: s["ne"] >= end)
    new_start = F.when(start <= first["ns"], first["os"]).when(start >= last["ne"], last["oe"]).when(same(s1), s1["os"] + start - s1["ns"]).otherwise(s1["os"])
    new_end = F.when(end <= first["ns"], first["os"]).when(end >= last["ne"], last["oe"]).when(same(e1), e1["os"] + end - e1["ns"]).otherwise(e1["oe"])
    mapped = F.struct(new_start.cast("int").alias("start"), F.greatest(new_start, new_end).cast("int").alias("end"))
    return F.when(segments.isNull() | (F.size(segments) == 0), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).otherwise(mapped)


def redact(text: Column, spans: Column, mark: str = MARK) -> Column:
    """Replace the bytes of each merged span (start, end) by a mark, from the end; empty spans are skipped."""
    raw = text.cast("binary")

    def step(acc: Column, s: Column) -> Column:
        n = F.octet_length(acc)
        a, b = F.least(F.greatest(s["start"], F.lit(0)), n), F.least(F.greatest(s["end"], F.lit(0)), n)
        changed = F.concat(F.substring(acc, F.lit(1), a), F.lit(mark).cast("binary"), F.substring(acc, b + 1, n))
        return F.when(b > a, changed).otherwise(acc)

    def changed(own: Column) -> Column:
        return F.when(F.size(own) == 0, text).otherwise(F.aggregate(F.reverse(own), raw, step).cast("string"))

    return let(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), changed)
