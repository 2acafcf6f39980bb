"""Toxicity scores: a learned lexicon, matched with its misspellings, and the
context that tells abuse from quotation."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.automaton import Automaton
from tollgate.llm.common import NULL_ID, documents, materialize, ranges, remove, text_columns
from tollgate.llm.symbols import word_spans

# General insults that the lexicon starts from, words that report
# speech, and words that address someone.
SEEDS = "idiot idiots moron morons imbecile stupid dumbass loser losers scum trash worthless pathetic disgusting clown bastard scumbag douchebag retard asshole bitch whore slut vermin".split()
REPORTING = frozenset("said says quote quoted quotes called wrote writes word words term phrase slur insult insults dijo dice palabra sagte sagt wort dit mot".encode().split())
ADDRESS = frozenset("you your youre ur u du dich dir dein tu te ti tus usted eres vous votre toi".encode().split())

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words end at white space and ASCII punctuation, except what misspellings use.
_INNER = b"*@$!-'._+"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[b for b in range(128) if not chr(b).isalnum() and b not in _INNER]] = True
_EDGE = np.zeros(256, bool)
_EDGE[list(_INNER)] = True
_QUOTES = [("“", b'"  '), ("”", b'"  '), ("„", b'"  '), ("«", b'" '), ("»", b'" '), ("‘", b"'  "), ("’", b"'  ")]
WINDOW = 6
FEATURES = 10


def normalised(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with plain quotes; positions stay."""
    raw = data.tobytes()
    for quote, plain in _QUOTES:
        raw = raw.replace(quote.encode(), plain)
    out = _LOWER[np.frombuffer(raw, np.uint8)]
    if len(out) > 1:
        # Capital Latin letters of the first supplement.
        after = out[:-1] == 0xC3
        tail = out[1:]
        tail[after & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return out


def spans(data: np.ndarray, offsets: np.ndarray):
    """Words without punctuation at their edges: starts, sizes, first word of each document."""
    starts, ends, first = word_spans(data, offsets, _SEPARATOR)
    if len(starts):
        # The next byte that stays, from each on, and the last one up to each.
        place = np.arange(len(data))
        stays = ~_EDGE[data]
        after = np.minimum.accumulate(np.where(stays, place, len(data))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(stays, place, -1))
        starts = np.minimum(after[starts], ends)
        ends = np.maximum(before[ends - 1] + 1, starts)
    return starts, ends - starts, first


def _stems(word: bytes):
    """Beginnings of a word of four bytes or more, short of the whole, at character edges."""
    for k in range(4, min(len(word), 10)):
        if word[k] & 0xC0 != 0x80:
            yield word[:k] + b"*"


def _training(docs: DataFrame, labels: DataFrame, folds: int, fold: int, sample: int) -> DataFrame:
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(rest != fold)
    chosen = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers.
    return materialize(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "labelled")


def _texts(batch):
    ids, data, offsets = text_columns(batch.select(["doc_id", "text"]))
    data = normalised(data)
    return ids, data, offsets


def _unique_words(data: np.ndarray, offsets: np.ndarray):
    starts, size, first = spans(data, offsets)
    raw, s, e = data.tobytes(), starts.tolist(), (starts + size).tolist()
    for i in range(len(offsets) - 1):
        yield {raw[s[k] : e[k]] for k in range(int(first[i]), int(first[i + 1])) if e[k] - s[k] >= 3}


def learn_lexicon(train: DataFrame) -> dict[bytes, float]:
    """Terms (a trailing * marks a stem) that explain the toxic labels, with weights.

    Words and stems are counted in all training documents, by label; of those in
    enough toxic documents and in few others, the term that is in most toxic
    documents not yet explained is taken, again and again, until none explains
    enough. Equal terms: the longer one. All counts are made and all terms
    chosen where the sample is read; what passes comes to the driver.
    """
    toxic = train.where("toxic = 1").count()
    clean = train.count() - toxic
    support = int(min(max(0.01 * toxic, 5), 30))

    def first(batches):
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            _, data, offsets = _texts(batch)
            count: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())
            for label, words in zip(labels, _unique_words(data, offsets), strict=True):
                own = count[int(label == 1)]
                own.update(words)
                own.update({s for w in words for s in _stems(w)})
            for label, own in enumerate(count):
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([label] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], ["term", "label", "n"])

    def counts(df: DataFrame, label: int) -> DataFrame:
        return df.mapInArrow(first, "term binary, label int, n long").groupBy("term").agg(F.sum("n").alias(f"n{label}"))

    frequent = counts(train.where("toxic = 1"), 1).where(F.col("n1") >= support)
    both = frequent.join(counts(train.where("toxic <> 1"), 0), "term", "left").na.fill(0, ["n0"])
    # n1 >= 0.8 (n1 + n0) without rounding.
    passed = both.where(5 * F.col("n1") >= 4 * (F.col("n1") + F.col("n0"))).orderBy("term").collect()
    counted = [(bytes(r.term), r.n1, r.n0) for r in passed]
    names = [t for t, _, _ in counted]
    n1, n0 = ([c[k] for c in counted] for k in (1, 2))
    good = {t: i for i, t in enumerate(names)}

    def third(batches):
        for batch in batches:
            _, data, offsets = _texts(batch)
            lists = [np.array(sorted({good[x] for w in words for x in (w, *_stems(w)) if x in good}), np.int32).tobytes() for words in _unique_words(data, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary())], ["items"])

    by_doc = [np.frombuffer(bytes(r["items"]), np.int32) for r in train.where("toxic = 1").mapInArrow(third, "items binary").toLocalIterator()]
    holders: list[list[int]] = [[] for _ in names]
    for d, own in enumerate(by_doc):
        for i in own.tolist():
            holders[i].append(d)
    lexicon: dict[bytes, float] = {}
    gain = [len(d) for d in holders]
    order = sorted(range(len(names)), key=lambda i: (not names[i].endswith(b"*"), len(names[i]), names[i]), reverse=True)
    place = {i: k for k, i in enumerate(order)}
    heap = [(-gain[i], place[i]) for i in order]
    heapq.heapify(heap)
    explained = np.zeros(len(by_doc), bool)
    while heap:
        had, k = heapq.heappop(heap)
        i = order[k]
        if gain[i] < support:
            continue
        if gain[i] < -had:
            heapq.heappush(heap, (-gain[i], k))
            continue
        lexicon[names[i]] = math.log((n1[i] + 0.5) / (toxic + 1)) - math.log((n0[i] + 0.5) / (clean + 1))
        for d in holders[i]:
            if not explained[d]:
                explained[d] = True
                for other in by_doc[d].tolist():
                    gain[other] -= 1
    for s in SEEDS:
        lexicon.setdefault(s.encode(), 3.0)
    return lexicon


class Matcher:
    """Hits of the lexicon in texts, and the features of a document's hits."""

    def __init__(self, lexicon: dict[bytes, float]):
        terms = [t for t in lexicon if not t.endswith(b"*")]
        stems = [t[:-1] for t in lexicon if t.endswith(b"*")]
        self.automaton = Automaton(terms, stems, wide=True)
        self.weight = [lexicon[t] for t in terms] + [lexicon[t + b"*"] for t in stems]
        self.stem_from = len(terms)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple]], np.ndarray]:
        """Per document its hits (form, term, errors, quoted, window words); and words per document."""
        starts, size, first = spans(data, offsets)
        word, term, errors = self.automaton.match(data, starts, size)
        doc = np.searchsorted(first, word, "right") - 1
        out: list[list[tuple]] = [[] for _ in range(len(offsets) - 1)]
        for w, t, e, d in zip(word.tolist(), term.tolist(), errors.tolist(), doc.tolist(), strict=True):
            lo, hi = max(int(first[d]), w - WINDOW), min(int(first[d + 1]), w + WINDOW + 1)
            begin, a, b = int(starts[lo]), int(starts[w]), int(starts[w] + size[w])
            end = int(starts[hi - 1] + size[hi - 1]) + 1
            before, after = data[max(begin - 1, int(offsets[d])) : a].tobytes(), data[b : min(end, int(offsets[d + 1]))].tobytes()
            quoted = before.count(b'"') % 2 == 1 and b'"' in after or before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")
            around = [data[starts[k] : starts[k] + size[k]].tobytes() for k in range(lo, hi) if k != w]
            out[d].append((data[a:b].tobytes(), t, e, quoted, around))
        return out, np.diff(first)


def features(hits: list[tuple], n_words: int, benign: frozenset, context: dict[bytes, float], weight: list[float], stem_from: int) -> list[float]:
    """A document's features; all zero without hits, but the first."""
    plain = quoted = fuzzy = fuzzy_quoted = stems = report = address = score = 0.0
    strongest = 0.0
    for form, term, errors, in_quotes, around in hits:
        if errors and form in benign:
            continue
        own = sum(context.get(x, 0.0) for x in around)
        score += max(-3.0, min(3.0, own))
        report += any(x in REPORTING for x in around)
        address += any(x in ADDRESS for x in around)
        share = 0.5 if in_quotes else 1.0
        quoted += in_quotes and not errors
        fuzzy_quoted += in_quotes and bool(errors)
        if errors:
            fuzzy += share
        elif term >= stem_from:
            stems += share
        else:
            plain += share
        strongest = max(strongest, weight[term] * share * (0.7 if errors else 1.0))
    total = plain + fuzzy + stems
    return [1.0, math.log1p(plain), math.log1p(fuzzy), math.log1p(stems), math.log1p(quoted + fuzzy_quoted), math.log1p(report), math.log1p(address), strongest / 5, score / max(total, 1.0), min(1.0, 10 * total / max(n_words, 1))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression with a ridge, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _hit_words(train: DataFrame, matcher: Matcher) -> tuple[dict, dict, list[int]]:
    """Of the training documents: edited forms that were hit and words around hits,
    both by label, and the number of documents with hits by label. Counted where
    they are read; the forms that are harmless and the words that are around hits
    five times or more come to the driver."""

    def run(batches):
        count: Counter[tuple] = Counter()
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            _, data, offsets = _texts(batch)
            for label, hits in zip(labels, matcher.hits(data, offsets)[0], strict=True):
                label = int(label == 1)
                count[("doc", b"", label)] += bool(hits)
                for word in {h[0] for h in hits if h[2]}:
                    count[("form", word, label)] += 1
                for word in {x for h in hits for x in h[4]}:
                    count[("near", word, label)] += 1
        keys = list(count)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64())], ["kind", "word", "label", "n"])

    sums = train.mapInArrow(run, "kind string, word binary, label int, n long").groupBy("kind", "word").pivot("label", [0, 1]).agg(F.sum("n")).na.fill(0)
    sums = sums.select("kind", "word", F.col("0").alias("n0"), F.col("1").alias("n1"))
    docs = sums.where("kind = 'doc'").first()
    top = [sums.where(F.col("kind") == k).where(own).collect() for k, own in (("form", "n0 > n1"), ("near", "n0 + n1 >= 5"))]
    forms, around = ({bytes(r.word): (r.n0, r.n1) for r in t} for t in top)
    return forms, around, [docs.n0, docs.n1] if docs else [0, 0]


def _feature_rows(train: DataFrame, matcher: Matcher, benign: frozenset, context: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the training documents."""

    def run(batches):
        for batch in batches:
            labels = batch.column("toxic").to_pylist()
            _, data, offsets = _texts(batch)
            hits, n = matcher.hits(data, offsets)
            rows = [np.array(features(h, int(k), benign, context, matcher.weight, matcher.stem_from)).tobytes() for h, k in zip(hits, n, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(t == 1) for t in labels], pa.int32()), pa.array(rows, pa.binary())], ["y", "x"])

    found = [(r.y, bytes(r.x)) for r in train.mapInArrow(run, "y int, x binary").toLocalIterator()]
    x = np.frombuffer(b"".join(r for _, r in found), np.float64).reshape(-1, FEATURES)
    return x, np.array([y for y, _ in found], float)


class Model:
    """What was learned; scores depend on a text alone."""

    def __init__(self, lexicon: dict[bytes, float], benign: frozenset, context: dict[bytes, float], w: np.ndarray):
        self.lexicon, self.benign, self.context, self.w = lexicon, benign, context, w
        self.matcher = Matcher(lexicon)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of a block of texts, 0 to 1."""
        out = [np.zeros(0)]
        for lo, hi in ranges(offsets, 2 << 20):
            hits, n = self.matcher.hits(normalised(data[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo])
            x = np.array([features(h, int(k), self.benign, self.context, self.matcher.weight, self.matcher.stem_from) for h, k in zip(hits, n, strict=True)]).reshape(-1, FEATURES)
            out.append(1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30))))
        return np.concatenate(out)


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, sample: int = 30_000) -> Model:
    """Fit on at most ``sample`` labelled documents (those with the least hash of
    their id) among the ones whose crc32(id as text) mod ``folds`` is not ``fold``."""
    train = _training(docs, labels, folds, fold, sample)
    lexicon = learn_lexicon(train)
    matcher = Matcher(lexicon)
    forms, around, holders = _hit_words(train, matcher)
    benign = frozenset(f for f, (n0, n1) in forms.items() if n0 > n1)
    # Words near hits, by label; what a document's label says is what they speak for.
    context = {w: 0.5 * (math.log((n1 + 1) / (holders[1] + 2)) - math.log((n0 + 1) / (holders[0] + 2))) for w, (n0, n1) in around.items() if n0 + n1 >= 5} if min(holders) else {}
    x, y = _feature_rows(train, matcher, benign, context)
    remove(train)
    if len(y) and 0 < y.sum() < len(y):
        w = fit(x, y)
    else:
        w = np.array([-3.0, 3.0, 2.0, 2.0, -1.0, -0.5, 0.5, 1.0, 0.5, 1.0])
    return Model(lexicon, benign, context, w)


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = 0.3, sample: int = 30_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Learns (see :func:`learn`) a lexicon of words and stems, which edited forms
    are harmless, which words around a hit speak for or against abuse, and a
    logistic regression over a document's hits. Scores depend on the text alone,
    all of it. Terms are matched with one edit by an automaton; a hit in
    quotation marks counts half.

    Null or empty text scores like any text without hits. Null ids are scored,
    and not learned from. Rows that share an id are scored one by one; an id
    with several labels is toxic if one of them is. Without labels, or with one
    kind only, the built-in terms alone decide. Other columns are ignored. An
    empty table gives no rows.
    """
    docs = documents(docs, id_col, text_col)
    model = learn(docs, labels, folds, fold, sample)

    def run(batches):
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(model.scores(data, offsets))], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    own = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    return scored.select(own.alias("doc_id"), "score").select("doc_id", F.coalesce(rest == fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, fold: int = 2, sample: int = 30_000) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that score below the
    threshold, filtered where they are read."""
    model = learn(documents(docs), labels, folds, fold, sample)

    def run(batches):
        for batch in batches:
            own = pa.Table.from_batches([batch]).select(["doc_id", "text"])
            _, data, offsets = text_columns(own)
            yield batch.filter(pa.array(model.scores(data, offsets) < threshold))

    typed = docs.withColumn("doc_id", docs["doc_id"].cast("long")).withColumn("text", docs["text"].cast("string"))
    return typed.mapInArrow(run, typed.schema)
