"""Detectors: text column -> array of findings, as built-in expressions.

Each one works on a row of one part; their results are concatenated in the
order of registration, so detection never shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgate.functions import patterns as P
from tollgate.functions.checks import digits_only, entropy, gstin, luhn, verhoeff
from tollgate.functions.spans import HIT, find_spans, let, near_any, suppress_contained
from tollgate.schema import FINDINGS

CHECKED, SHAPE = 1.0, 0.7
OVERRIDE_SCORE, SPOOF_SCORE, HIDDEN_SCORE = 0.8, 0.6, 0.6


def none() -> Column:
    return F.array().cast(FINDINGS)


def findings(hits: Column, part: Column, detector: str, kind: str, score: float, keep: Callable[[Column], Column] | None = None) -> Column:
    """Hits that pass a check, as findings."""
    if keep is not None:
        hits = F.filter(hits, keep)
    return F.transform(hits, lambda h: F.struct(F.lit(detector).alias("detector"), F.lit(kind).alias("type"), part.cast("int").alias("part"), h["start"].cast("int").alias("start"), h["end"].cast("int").alias("end"), F.lit(score).alias("score")))


class Detector:
    """Override ``name`` and ``detect``."""

    name = ""

    def detect(self, text: Column, part: Column) -> Column:
        raise NotImplementedError


class Noop(Detector):
    name = "noop"

    def detect(self, text: Column, part: Column) -> Column:
        return none()


class Pii(Detector):
    """Personal data: shapes, checksums where there are any, contained hits dropped."""

    name = "pii"

    #: The types, in the order in which they are looked for.
    kinds: tuple[str, ...] = ("aadhaar", "card", "gstin", "pan", "indian_passport", "indian_mobile", "email", "upi_vpa", "ifsc", "bank_account")

    def of(self, kind: str, text: Column, part: Column) -> Column:
        """All findings of one type."""

        def found(pattern: str, score: float, keep=None) -> Column:
            return findings(find_spans(text, pattern), part, self.name, kind, score, keep)

        def aadhaar(h: Column) -> Column:
            digits = digits_only(h["text"])
            return (F.length(digits) == 12) & verhoeff(digits)

        def card(h: Column) -> Column:
            digits = digits_only(h["text"])
            return F.length(digits).between(13, 19) & luhn(digits)

        def vpa(h: Column) -> Column:
            after = F.substring(text.cast("binary"), h["end"] + 1, F.lit(1))
            return (after != F.lit(b".")) & F.lower(F.substring_index(h["text"], "@", -1)).isin(*P.VPA_HANDLES)

        def account(ifsc: Column) -> Column:
            return F.when(F.size(ifsc) > 0, found(P.ACCOUNT, SHAPE, lambda h: near_any(h, ifsc, P.ACCOUNT_WINDOW))).otherwise(none())

        if kind == "aadhaar":
            return found(P.AADHAAR, CHECKED, aadhaar)
        if kind == "card":
            return found(P.CARD, CHECKED, card)
        if kind == "gstin":
            return found(P.GSTIN, CHECKED, lambda h: gstin(h["text"]))
        if kind == "upi_vpa":
            return found(P.VPA, SHAPE, vpa)
        if kind == "bank_account":
            return let(find_spans(text, P.IFSC), account)
        return found({"pan": P.PAN, "indian_passport": P.PASSPORT, "indian_mobile": P.MOBILE, "email": P.EMAIL, "ifsc": P.IFSC}[kind], SHAPE)

    def detect(self, text: Column, part: Column) -> Column:
        return suppress_contained(F.concat(*(self.of(k, text, part) for k in self.kinds)))


@dataclass
class Secrets(Detector):
    """Provider keys, and tokens of a mixed alphabet with high entropy.

    The entropy rule's least length and bits are not recoverable from outside
    behaviour; they are parameters. Tokens that decode to readable base64 are no
    secrets. Contained hits are dropped, so a provider's key is reported once.
    """

    min_length: int = 20
    min_bits: float = 4.0
    name = "secrets"

    def detect(self, text: Column, part: Column) -> Column:
        def secret(h: Column) -> Column:
            t = h["text"]
            mixed = t.rlike("[A-Z]") & t.rlike("[a-z]") & t.rlike("[0-9]")
            return (F.length(F.rtrim(t, F.lit("="))) >= self.min_length) & mixed & (entropy(t) >= self.min_bits) & ~readable_base64(t)

        providers = [findings(find_spans(text, p), part, self.name, k, CHECKED) for p, k in ((P.AWS_KEY, "aws_key"), (P.GITHUB_TOKEN, "github_token"), (P.SLACK_TOKEN, "slack_token"), (P.OPENAI_KEY, "openai_key"))]
        tokens = findings(find_spans(text, P.SECRET_TOKEN), part, self.name, "high_entropy", SHAPE, secret)

        def apart(known: Column) -> Column:
            # A token around or inside a provider's key is that key.
            return F.concat(known, F.filter(tokens, lambda t: ~F.exists(known, lambda k: (k["start"] < t["end"]) & (t["start"] < k["end"]))))

        return suppress_contained(let(F.concat(*providers), apart))


def readable_base64(token: Column) -> Column:
    """Whether a token decodes, in one of the four alphabets and paddings, to at
    least eight bytes of UTF-8 that are nine tenths printable."""
    url = token.rlike("[-_]")
    plain = F.translate(token, "-_", "+/")
    bare = F.regexp_replace(plain, "=+$", "")
    padding = F.length(token) - F.length(bare)
    need = (4 - F.length(bare) % 4) % 4
    # Without padding, or with just what is needed; the two alphabets don't mix.
    well = (need != 3) & ((padding == 0) | (padding == need)) & ~(url & token.rlike("[+/]"))
    raw = F.call_function("try_to_binary", F.concat(bare, F.repeat(F.lit("="), need)), F.lit("base64"))
    valid = F.call_function("is_valid_utf8", raw.cast("string"))
    text = F.when(valid, raw.cast("string"))
    printable = F.length(text) - F.length(F.regexp_replace(text, r"(?U)[\p{Graph} \n\t]", ""))
    return F.coalesce(well & (F.octet_length(raw) >= 8) & (printable * 10 >= F.length(text) * 9), F.lit(False))


class Injection(Detector):
    """Instruction overrides, chat markers and hidden markup; overlaps stay."""

    name = "injection_heuristic"

    def detect(self, text: Column, part: Column) -> Column:
        rules = ((P.OVERRIDE, "instruction_override", OVERRIDE_SCORE), (P.SPOOF, "role_spoof", SPOOF_SCORE), (P.HIDDEN, "hidden_text", HIDDEN_SCORE))
        return F.concat(*(findings(find_spans(text, p), part, self.name, kind, score) for p, kind, score in rules))


def url_host(url: Column) -> Column:
    """Lower-case host without user and port."""
    authority = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    host = F.substring_index(authority, "@", -1)
    return F.lower(F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"^\[|\]$", ""))


def url_parses(url: Column) -> Column:
    """Whether a strict parser takes the address: escapes are whole and the port is a number."""
    fragment = F.when(url.contains("#"), F.regexp_extract(url, r"#(.*)$", 1)).otherwise(F.lit(""))
    path = F.regexp_extract(url, r"^https?://([^?#]*)", 1)
    authority = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    broken = "%(?![0-9A-Fa-f]{2})"
    port = F.substring_index(authority, "@", -1).rlike(r"^(?:\[[^\]]*\]|[^:\[\]]*)(?::[0-9]*)?$")
    return ~path.rlike(broken) & ~fragment.rlike(broken) & port & ~authority.rlike(r"[\\^`{}|]")


def carries_data(url: Column, least: int = P.DATA_BYTES) -> Column:
    """Whether a query value or the fragment looks like a payload: long, or with an @, a space or a line break."""
    before = F.substring_index(url, "#", 1)
    query = F.when(before.contains("?"), F.regexp_extract(before, r"^[^?]*\?(.*)$", 1)).otherwise(F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: ~p.contains(";") & (F.length(p) > 0))

    def value(p: Column) -> Column:
        key = F.call_function("try_url_decode", F.substring_index(p, "=", 1))
        raw = F.when(p.contains("="), F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).otherwise(F.lit(""))
        return F.when(key.isNotNull(), F.call_function("try_url_decode", raw))

    decoded = F.transform(pairs, value)
    loud = F.exists(decoded, lambda v: F.coalesce((F.octet_length(v) >= least) | v.rlike("[@ \\n]"), F.lit(False)))
    fragment = F.when(url.contains("#"), F.regexp_extract(url, r"#(.*)$", 1)).otherwise(F.lit(""))
    # A plus sign stays in a fragment.
    plain = F.call_function("try_url_decode", F.replace(fragment, F.lit("+"), F.lit("%2B")))
    return loud | F.coalesce(F.octet_length(plain) >= least, F.lit(False))


@dataclass
class ExfilUrl(Detector):
    """Images and addresses that carry data out; ``allowed`` None means any host."""

    allowed: Sequence[str] | None = None
    name = "exfil_url"

    def detect(self, text: Column, part: Column) -> Column:
        images = findings(find_spans(text, P.MARKDOWN_IMAGE), part, self.name, "markdown_image", OVERRIDE_SCORE)
        urls = F.filter(find_spans(text, P.URL), lambda h: url_parses(h["text"]))

        def one(h: Column) -> Column:
            own = F.array(h)
            data = findings(own, part, self.name, "data_bearing_url", SPOOF_SCORE, lambda x: carries_data(x["text"]))
            if self.allowed is None:
                return data
            return F.concat(findings(own, part, self.name, "disallowed_domain", OVERRIDE_SCORE, lambda x: ~self.permitted(url_host(x["text"]))), data)

        return F.concat(images, F.flatten(F.transform(urls, one)))

    def permitted(self, host: Column) -> Column:
        """Whether a host or a parent domain of it is on the list."""
        known = sorted({d.lower().removeprefix(".") for d in self.allowed or () if d})
        if not known:
            return F.lit(False)
        labels = F.split(host, r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        return F.arrays_overlap(suffixes, F.array(*map(F.lit, known)))


def _overlaps_itself(term: str) -> bool:
    return any(term.startswith(term[k:]) for k in range(1, len(term)))


@dataclass
class CustomDict(Detector):
    """A tenant's terms (substrings, ASCII case ignored, all occurrences) and patterns.

    Few terms that can't overlap themselves are matched by built-in expressions;
    other dictionaries by one Arrow UDF with an Aho-Corasick automaton.
    """

    terms: Sequence[str] = ()
    regexes: Sequence[str] = ()
    native_terms: int = 50
    name = "custom_dict"

    def __post_init__(self):
        for r in self.regexes:
            try:
                re.compile(r)
            except re.error as e:
                raise ValueError(f"pattern {r!r}: {e}") from e
            if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", r):
                raise ValueError(f"pattern {r!r}: look-around and back-references are not supported")

    def detect(self, text: Column, part: Column) -> Column:
        own = list(dict.fromkeys(_fold(t) for t in self.terms if t))
        if not own and not self.regexes:
            return none()
        score, kind = CHECKED, "custom_term"
        found = []
        native = [t for t in own if not _overlaps_itself(t)] if len(own) <= self.native_terms else []
        if native:
            folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            found += [findings(find_spans(folded, re.escape(t).replace(r"\ ", " ")), part, self.name, kind, score) for t in native]
        if len(native) < len(own):
            found.append(findings(keyword_spans([t for t in own if t not in set(native)])(text), part, self.name, kind, score))
        found += [findings(find_spans(text, r), part, self.name, kind, score) for r in self.regexes]
        return suppress_contained(F.concat(*found))


_UPPER = {c: c + 32 for c in range(65, 91)}


def _fold(text: str) -> str:
    return text.translate(_UPPER)


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    """An Aho-Corasick automaton of the terms, built once a worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t, t)
    out.make_automaton()
    return out


def keyword_spans(terms: Sequence[str]):
    """An Arrow UDF: text -> all occurrences of the terms, overlaps too, in bytes, by
    end and start. One pass over a text finds them all, however many terms there are."""
    words = tuple(terms)

    @F.pandas_udf(f"array<{HIT}>")
    def run(texts: pd.Series) -> pd.Series:
        automaton, out = _automaton(words), []
        for t in texts:
            folded = _fold(t or "")
            hits = [(i + 1 - len(w), i + 1, w) for i, w in automaton.iter(folded)]
            if hits and not folded.isascii():
                # Characters before each place, in bytes.
                width = np.concatenate([[0], np.cumsum([len(c.encode()) for c in folded])])
                hits = [(int(width[a]), int(width[b]), w) for a, b, w in hits]
            out.append([{"start": a, "end": b, "text": w} for a, b, w in sorted(hits, key=lambda h: (h[1], h[0]))])
        return pd.Series(out)

    return run


class Registry:
    """Detectors with unique names; results in the order of registration."""

    def __init__(self, detectors: Sequence[Detector] = ()):
        self.detectors: list[Detector] = []
        for d in detectors:
            self.register(d)

    def register(self, detector: Detector) -> None:
        if not detector.name:
            raise ValueError("a detector needs a name")
        if any(d.name == detector.name for d in self.detectors):
            raise ValueError(f"detector {detector.name} is already registered")
        self.detectors.append(detector)

    def detect(self, text: Column, part: Column) -> Column:
        """All findings. The expression is kept: building it takes seconds, and it is
        the same for all tables whose columns have these names."""
        key = (id(SparkContext._jvm), str(text), str(part), *((type(d), repr(vars(d))) for d in self.detectors))
        if key not in _built:
            found = [d.detect(text, part) for d in self.detectors]
            _built[key] = F.concat(*found) if len(found) > 1 else found[0] if found else none()
        return _built[key]


_built: dict[tuple, Column] = {}


def standard(terms: Sequence[str] = (), regexes: Sequence[str] = (), allowed: Sequence[str] | None = None) -> Registry:
    """All detectors: pii, secrets, custom_dict, injection_heuristic, exfil_url."""
    return Registry([Pii(), Secrets(), CustomDict(terms, regexes), Injection(), ExfilUrl(allowed)])
