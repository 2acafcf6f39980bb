"""The training-data operators against brute force, on small texts with nulls,
empty and long texts, ties, repeated rows, extra columns and empty tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, hash string, bucket int"


def prose(rng, n):
    return " ".join(rng.choice(["the", "ana", "tion", "er,", "Re", "über", "x", "mo", "li.", "za"]) + rng.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    passage = prose(rng, 70)
    out = [*base, base[3], base[3], base[7] + " " + passage, passage + "\n" + base[9], "a  b " + passage + "\t c " + passage, None, "", " ", "one", "é" * 500, "aaaa " * 400, prose(rng, 9000) + " " + passage]
    words = base[11].split(" ")
    out += [" ".join([*words[:k], "edit", *words[k + 1 :]]) for k in (3, len(words) // 2)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", "h", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def pairs(texts):
    return [(i * 3, (t or "").encode()) for i, t in enumerate(texts)]


def runs(flags):
    return sum(1 for i, f in enumerate(flags) if f and not (i and flags[i - 1]))


@pytest.mark.parametrize("q", [5, 13])
def test_difference_cover(q):
    from tollgate.llm.cover import difference_cover

    v, cover = difference_cover(q)
    assert v == q * q + q + 1 and len(cover) == q + 1
    assert {(a - b) % v for a in cover.tolist() for b in cover.tolist()} == set(range(v))


def test_substring_dedup(docs, texts):
    from tollgate.llm.substring import substring_dedup

    got = {r.doc_id: r for r in substring_dedup(docs, digest=True).collect()}
    assert len(got) == len(texts)
    first, words = {}, {i: WORD.findall(t) for i, t in pairs(texts)}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    removed = 0
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        removed += sum(gone)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert removed
    assert {r.doc_id: r.text for r in substring_dedup(docs).collect()}[0] is not None


@pytest.mark.parametrize("q", [3, 5])
def test_block_sort(q):
    from tollgate.llm.blocksort import Block

    rng = np.random.default_rng(q)
    for _ in range(12):
        depth, letters = int(rng.integers(40, 120)), int(rng.integers(1, 4))
        base = rng.integers(97, 97 + letters, 600).astype(np.uint8)
        text = np.concatenate([base, base[100:400], rng.integers(97, 100, 50).astype(np.uint8), base[30:330]])
        raw, at = text.tobytes(), rng.permutation(len(text) - depth + 1)
        block = Block(text, depth, q)
        count = Counter(raw[i : i + depth] for i in at.tolist())
        found, number = block.classes(at.copy())
        repeated = set(found[np.bincount(number)[number] > 1].tolist()) if len(found) else set()
        assert repeated == {i for i in at.tolist() if count[raw[i : i + depth]] > 1}
        i, j = rng.choice(at, 300), rng.choice(at, 300)
        want = [(raw[x : x + depth] > raw[y : y + depth]) - (raw[x : x + depth] < raw[y : y + depth]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        assert block.compare(i, j).tolist() == want


def test_suffix_dedup_of_a_very_long_text(spark):
    """Strings that repeat across the parts in which a long text is read, and a text of one letter."""
    from tollgate.llm.suffixes import CHUNK, suffix_dedup

    rng = np.random.default_rng(5)
    body = bytearray(rng.integers(97, 123, 2 * CHUNK + 1000).astype(np.uint8).tobytes())
    body[CHUNK - 300 : CHUNK + 300] = body[5000:5600]
    body[2 * CHUNK : 2 * CHUNK + 399] = body[9000:9399]
    rows = [(1, body.decode()), (2, "a" * 30_000), (3, "b" * 400), (4, "c" * 401), (5, bytes(body[-500:]).decode() + "x")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest=True).collect()}
    assert got == {1: (len(body), 600 + 600 + 500, 3), 2: (30_000, 30_000, 1), 3: (400, 0, 0), 4: (401, 401, 1), 5: (501, 500, 1)}


def test_suffix_dedup_of_rows_that_share_an_id(spark):
    from tollgate.llm.suffixes import suffix_dedup

    one, two = "".join(chr(97 + (k * k) % 25) + str(k) for k in range(300)), "".join(chr(97 + (k * 7) % 25) + str(k * 3) for k in range(300))
    got = suffix_dedup(spark.createDataFrame([(1, one), (1, two), (2, two)], "doc_id long, text string"), digest=True).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got) == sorted([(1, len(one), 0), (1, len(two), len(two)), (2, len(two), len(two))])


@pytest.mark.parametrize(("length", "q", "frequent"), [(400, 5, 5000), (60, 5, 5000), (400, 3, 3)])
def test_suffix_dedup(docs, texts, length, q, frequent):
    """With a ``frequent`` of 3 nearly all repeated suffixes are dealt by fingerprints."""
    from tollgate.llm.suffixes import suffix_dedup

    got = {r.doc_id: r for r in suffix_dedup(docs, length, q, frequent, digest=True).collect()}
    count = Counter(t[k : k + length] for _, t in pairs(texts) for k in range(len(t) - length + 1))
    removed = 0
    for i, t in pairs(texts):
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        removed += sum(gone)
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(t), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest())
    assert removed


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "  a  b \n\n c ", "x<|endoftext|>y z <|endoftext|>", "it's  don't x  y\t z\r\n 12 345  ", "a" * 3000, "😀 😀 ​ z", "tail ", " head", "\n\n", "a　b", "'s 't"]


def test_encoder_equals_the_library():
    from tollgate.llm.tokens import Encoder, default_path

    coder, plain, rng = Encoder(default_path(), memo=50), tokenizer(), random.Random(1)
    every = ODD + [prose(rng, 60) for _ in range(20)] + ["".join(rng.choice(" a\nb.é😀　'1") for _ in range(40)) for _ in range(200)]
    for _ in range(3):
        raw = [t.encode() for t in every]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, first = coder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
        for k, t in enumerate(every):
            assert ids[first[k] : first[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_token_files(docs, texts):
    from tollgate.llm.packfile import token_files

    got, at, plain = {r.doc_id: r for r in token_files(docs).collect()}, 0, tokenizer()
    for i, t in sorted(pairs(texts)):
        ids = [*plain.encode(t.decode(), add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("vocabulary", [2, 3, 257, 50257, 65537, 1 << 20])
def test_packed_file_round_trip(vocabulary):
    import io

    from tollgate.llm.packfile import Reader, Writer

    rng, out = np.random.default_rng(3), io.BytesIO()
    docs = [rng.integers(0, vocabulary, n).astype(np.uint32) for n in (0, 1, 4095, 4096, 70000, 3)]
    w = Writer(out, vocabulary)
    for i, d in enumerate(docs):
        w.add(i, d)
    w.close()
    r, whole = Reader(out.getvalue()), np.concatenate(docs)
    assert all((r.document(i) == d).all() for i, d in enumerate(docs)) and (r.read(5000, 20000) == whole[5000:25000]).all()


def test_main_text():
    from tollgate.llm.pages import main_text

    page = """<html><head><title>T</title><style>p{x}</style><script>var a = "</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div class="cookie-notice"><p>We use cookies, and so on, for you.</p></div>
    <main><article><h1>Title &amp; more</h1><p><b>First paragraph, with text,<br>and &lt;marks&gt; in   it, long enough.<p>Second paragraph, which is
    a bit longer, has commas, and ends here.<ul><li>one point<li>two</ul><aside>Aside, not wanted, at all here.</aside><form><p>Sign up, please, now, today.</form>
    <blockquote>A quote, that stays.</blockquote></article><section id="comments"><p>Nice post, thanks, I liked it, very much.</p></section></main><div class=ad>Buy, now, cheap, things, today, here.</div><footer>&copy; me</footer>"""
    assert main_text(page).split("\n") == ["Title & more", "First paragraph, with text, and <marks> in it, long enough.", "Second paragraph, which is a bit longer, has commas, and ends here.", "one point", "two", "A quote, that stays."]
    assert main_text(None) == main_text("") == main_text("<p></p>") == "" and main_text("<div class=ad>x<article><p>Text") == "Text"
    assert main_text("<p>" * 3000 + "deep") == "deep"


def test_extract_pages(spark):
    from tollgate.llm.pages import extract_pages

    rows = [(1, "u", "<body><article><p>Hello, world"), (2, None, None), (2, "v", "x & y"), (None, "w", "<b")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "Hello, world", 12), (2, "", 0), (2, "x & y", 5), (None, "", 0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton():
    from tollgate.llm.automaton import Automaton

    terms, stems, rng = [b"idiot", b"clown", b"scum", b"worthless"], [b"lowei"], random.Random(2)
    a, words = Automaton(terms, stems), []
    for _ in range(3000):
        w = bytearray(rng.choice(terms + stems))
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = bytes(rng.sample(list(b"idotclwnsu"), rng.randint(0, 1)))
        words.append(bytes(w))
    size = np.array([len(w) for w in words])
    w, _, e = a.match(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    got = dict(zip(w.tolist(), e.tolist(), strict=True))
    for i, x in enumerate(words):
        near = [distance(x, t) for t in terms if x[:1] == t[:1]]
        near = [d for d, t in zip(near, [t for t in terms if x[:1] == t[:1]], strict=True) if d <= (len(t) >= 5)]
        assert got.get(i) == (0 if x.startswith(b"lowei") else min(near, default=None))


def test_automaton_of_wide_edits():
    from tollgate.llm.automaton import Automaton

    terms, alphabet = ["idiot", "clown", "scum", "worthless"], "abidotclwnsuzë€1😀"

    def edits(t):
        yield t, 0
        if len(t.encode()) < 5:
            return
        for k in range(len(t) + 1):
            if k:
                yield from ((t[:k] + c + t[k:], 1) for c in alphabet)
            if k < len(t):
                yield t[:k] + t[k + 1 :], 1
                yield from ((t[:k] + c + t[k + 1 :], 1) for c in alphabet if k or c == "1")
            if k + 1 < len(t):
                yield t[:k] + t[k + 1] + t[k] + t[k + 2 :], 1

    want = {}
    for t in terms:
        for x, e in edits(t):
            want[x] = min(e, want.get(x, 9))
    rng = random.Random(3)
    others = ["".join(rng.choice(alphabet) for _ in range(5)) for _ in range(500)] + [x[:k] + c + x[k + 1 :] for x in list(want)[::3] for k in range(len(x)) for c in "tz€"]
    plain = [x for x in others if x not in want]
    words = [x.encode() for x in [*want, *plain]]
    size = np.array([len(w) for w in words])
    w, _, e = Automaton([t.encode() for t in terms], [], wide=True).match(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    assert dict(zip(w.tolist(), e.tolist(), strict=True)) == dict(enumerate(want.values()))


def test_toxicity(spark):
    from tollgate.llm.toxicity import toxicity, without_toxic

    rng, rows, labels = random.Random(4), [], []
    for i in range(600):
        bad = i % 5 == 0
        words = prose(rng, 40).split(" ")
        if bad:
            words.insert(rng.randrange(40), rng.choice(["zorgon", "Blatfink,", "idiot", "grumpelig", "grumpelo", "grumpelax"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "so he is a zorrgon, you " + prose(rng, 9)), (None, "blatfink")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (901, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, marks).collect()}
    assert len(got) == len(rows) and got[5].held_out == (zlib.crc32(b"5") % 4 == 2) and not got[None].held_out
    assert all(got[i].predicted == (i % 5 == 0) for i in range(600) if got[i].held_out)
    assert got[902].predicted == 1 and got[None].predicted == 1 and got[900].predicted == got[901].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = without_toxic(docs.withColumn("label", F.lit(1)), marks)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted} and kept.columns == ["doc_id", "text", "label"]
    none = toxicity(docs, marks.limit(0)).collect()
    assert {r.doc_id for r in none if r.predicted} >= {i for i, t in rows if t and "idiot" in t}


def test_decontamination(spark):
    from tollgate.llm.decontam import common_subsequence, contaminated

    assert common_subsequence({1: 0b001, 2: 0b010, 3: 0b100}, [1, 9, 3, 2], 3) == 2
    rng = random.Random(6)
    noise = ["w" + "".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(400)]

    def text(n):
        return [rng.choice(noise) if rng.random() < 0.6 else rng.choice(["the", "of", "and"]) for _ in range(n)]

    items = [(k, " ".join(text(rng.randint(12, 60)))) for k in range(12)] + [(50, None), (51, ""), (52, " ".join(text(150)))]
    rows = [(i, " ".join(text(rng.randint(0, 300)))) for i in range(200)]
    for k in range(12):
        w = items[k][1].split()
        if len(w) > 30:
            w[5] = "changed"
        rows.append((1000 + k, " ".join(text(k * 20)) + " " + " ".join(w).upper() + ". " + " ".join(text(30))))
    rows += [(2000, " ".join(items[-1][1].split()[50:110])), (3000, None), (3001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), block_items=5).collect()}
    assert set(got) == {(1000 + k, k) for k in range(12)} | {(2000, 52)}
    assert contaminated(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def vectors(spark, n=700):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 12)) * rng.uniform(0.2, 3, size=(n, 1))
    x[100:200] = x[5] + rng.normal(size=(100, 12)) * 1e-3
    x[300:340] = x[300]
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    odd = [(5000, None), (5001, [0.0] * 12), (5002, [1.0, float("nan")] + [0.0] * 10), (5003, [1.0, None] + [0.0] * 10), (5004, [float("inf")] + [0.0] * 11), (None, x[0].tolist()), (5020, None)]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_nearest_neighbours(spark, shard_rows):
    from tollgate.llm.ann import nearest_neighbours

    rows, frame = vectors(spark)
    got = defaultdict(list)
    for r in nearest_neighbours(frame, frame.where("vec_id % 20 = 0"), k=20, shard_rows=shard_rows).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    hits = 0
    for q in range(0, 700, 20):
        s = x @ x[q]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and all(abs(s[v] - z) < 1e-12 for _, v, z in own)
        assert own == sorted(own, key=lambda r: (-r[2], r[1])) and q not in {v for _, v, _ in own}
        s[q] = -np.inf
        hits += len({v for _, v, _ in own} & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        if 300 <= q < 340:
            assert [v for _, v, _ in own][:20] == [v for v in range(300, 340) if v != q][:20] or s.max() > x[q] @ x[q]
    assert hits / (35 * 20) >= 0.97
    few = frame.where("vec_id < 5")
    assert nearest_neighbours(few, few, k=20).count() == 20
    assert nearest_neighbours(frame.limit(0), frame.limit(0)).count() == 0


def test_best_fit_packing(docs, texts):
    from tollgate.llm.binpack import bound, pack_documents

    plain, by, bins, open_ = tokenizer(), defaultdict(list), defaultdict(list), []
    rows = pack_documents(docs, capacity=64, shard_items=40).collect()
    for r in rows:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    for i, t in pairs(texts):
        ids, at = [*plain.encode(t.decode(), add_special_tokens=False).ids, 2], 0
        own = sorted(by[i], key=lambda r: r.piece)
        assert len(own) == -(-len(ids) // 64) and [r.piece for r in own] == list(range(len(own))) and all(r.length == 64 for r in own[1:])
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            open_ += [r.length] if r.length < 64 else []
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    full = sum(r.length == 64 for r in rows)
    assert full + bound(open_, 64) <= len(bins) <= full + bound(open_, 64) + 4


def test_genetic_packing_is_no_worse_than_best_fit():
    from tollgate.llm.binpack import evolve, individual

    rng = random.Random(9)
    for _ in range(5):
        lengths = sorted((rng.randint(200, 500) for _ in range(300)), reverse=True)
        bins, free = evolve(lengths, 1024, 1, [], 6, 30)
        assert sorted(i for b in bins for i in b) == list(range(300)) and all(1024 - sum(lengths[i] for i in b) == f >= 0 for b, f in zip(bins, free, strict=True))
        assert len(bins) <= len(individual(lengths, 1024, None)[0])


def test_lattice_scores(docs, texts):
    from tollgate.llm.lm import lattice, lattice_scores
    from tollgate.llm.tokens import default_path

    got = {r.doc_id: r for r in lattice_scores(docs).collect()}
    words = {i: [*WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in pairs(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in words}
    count = Counter(w for i, own in words.items() if not held[i] for w in own)
    n, v = sum(count.values()), len(count)
    for i, own in words.items():
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(own), sum(count[w] > 0 for w in own), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
    model = lattice(default_path())
    logp = model.start()
    score = {p: logp[i] for i, p in enumerate(model.pieces)}
    sample = [b"the", b"zaqo", "é".encode(), b"q" * 40]
    size = np.array([len(w) for w in sample])
    for w, x in zip(sample, model.log_probabilities(np.frombuffer(b"".join(sample), np.uint8), np.cumsum(size) - size, size, logp), strict=True):
        text, alpha = b" " + w, [1.0] + [0.0] * (len(w) + 1)
        for e in range(1, len(text) + 1):
            alpha[e] = sum(alpha[s] * math.exp(score[text[s:e]]) for s in range(max(0, e - 16), e) if text[s:e] in score)
        assert x == pytest.approx(math.log(alpha[-1]) + logp[model.end])
    assert math.isclose(np.exp(logp).sum(), 1)


def shingle_sets(texts):
    out = {}
    for i, t in pairs(texts):
        w = WORD.findall(t)
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def test_near_duplicates(spark, docs, texts):
    from tollgate.llm.neardup import near_duplicates, probability_jaccard

    sets, parent = shingle_sets(texts), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == {i: root(i) for i in ids} and len({root(i) for i in ids}) < len(ids)
    assert all(r.keep == (r.class_id == i) for i, r in got.items())
    # A chain whose ends are far apart, in one bucket with much else, must stay one class.
    rng = random.Random(3)
    words, chain = prose(rng, 120).split(" "), []
    for k in range(60):
        words = [*words[:k], f"new{k}", *words[k + 1 :]]
        chain.append((k, " ".join(words)))
    many = spark.createDataFrame(chain, "doc_id long, text string")
    assert {r.class_id for r in near_duplicates(many, block=16).collect()} == {0}
    assert near_duplicates(docs.limit(0)).count() == 0
    x, y = np.array([1.0, 2, 0, 1]), np.array([1.0, 1, 3, 0])
    want = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(4)) for i in range(2))
    assert probability_jaccard(x, y) == pytest.approx(want)


def test_prob_minhash_estimates_probability_jaccard():
    from tollgate.llm.common import mix
    from tollgate.llm.neardup import prob_minhash, probability_jaccard

    rng = np.random.default_rng(1)
    h = mix(np.arange(1, 301, dtype=np.uint64))
    wa, wb = rng.uniform(0.5, 4, 300) * (rng.random(300) < 0.9), rng.uniform(0.5, 4, 300) * (rng.random(300) < 0.9)
    doc = np.repeat([0, 1], 300)
    weight = np.concatenate([wa, wb])
    keep = weight > 0
    s = prob_minhash(doc[keep], np.concatenate([h, h])[keep], weight[keep], 2, 4000)
    assert (s[0] == s[1]).mean() == pytest.approx(probability_jaccard(wa, wb), abs=0.03)


def _mass(word: bytes, p: dict[bytes, float], longest: int) -> tuple[list[float], list[float]]:
    """Forward and backward mass of all segmentations of a spelled word, plainly."""
    forward, backward = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
    for e in range(1, len(word) + 1):
        forward[e] = sum(forward[s] * p.get(word[s:e], 0.0) for s in range(max(0, e - longest), e))
    for s in range(len(word) - 1, -1, -1):
        backward[s] = sum(backward[e] * p.get(word[s:e], 0.0) for e in range(s + 1, min(len(word), s + longest) + 1))
    return forward, backward


def test_lattice_scores_against_plain_sums(spark):
    """Counts, expectation maximisation, mixture, urn and end, all again by plain loops."""
    from tollgate.llm.lm import lattice, lattice_scores
    from tollgate.llm.tokens import default_path

    texts = {1: "the cat sat on the mat", 2: "The dog sat", 3: "", 4: "zebra zebra the cat qxzj", 5: "the the the dog", 9: "mat cat", 11: "a cat saw a zebra saw a cat"}
    got = {r.doc_id: r for r in lattice_scores(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), steps=1, prior=50.0).collect()}
    model = lattice(default_path())
    pieces, end = model.pieces, model.end
    p = dict(zip([*pieces, None], np.exp(model.start()).tolist(), strict=True))
    words = {i: t.lower().encode().split() for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 0 < len(train) < len(texts)
    count = Counter(w for i in train for w in words[i])
    total, kinds = sum(count.values()) + len(train), len(count) + 1
    expected: Counter = Counter()
    for w in count:
        spelled = b" " + w
        f, b = _mass(spelled, p, model.longest)
        for s in range(len(spelled)):
            for e in range(s + 1, len(spelled) + 1):
                if spelled[s:e] in p:
                    expected[spelled[s:e]] += f[s] * p[spelled[s:e]] * b[e] / f[-1]
        expected[None] += 1
    mass = sum(0.01 + expected[x] for x in [*pieces, None])
    p = {x: (0.01 + expected[x]) / mass for x in [*pieces, None]}
    assert end == len(pieces)
    often = [*count.values(), len(train)]
    once, twice = often.count(1), often.count(2)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95)
    spare = discount * kinds / total

    def chance(w: bytes) -> float:
        return max(count[w] - discount, 0) / total + spare * _mass(b" " + w, p, model.longest)[0][-1] * p[None]

    for i, own in words.items():
        lattice_score = sum(math.log10(chance(w)) for w in own) + math.log10((len(train) - discount) / total)
        seen: Counter = Counter()
        score = 0.0
        for j, w in enumerate(own):
            score += math.log10((50.0 * chance(w) + seen[w]) / (50.0 + j))
            seen[w] += 1
        score += math.log10(50.0 * (len(train) - discount) / total / (50.0 + len(own)))
        assert math.isclose(got[i].lattice_score, lattice_score, rel_tol=1e-6)
        assert math.isclose(got[i].score, score, rel_tol=1e-6)
        assert got[i].train_tokens == total and got[i].n_known == sum(w in count for w in own) + 1


def test_long_words_have_the_mass_of_the_plain_recursion():
    from tollgate.llm import lm
    from tollgate.llm.tokens import default_path

    model = lm.lattice(default_path())
    logp = model.start()
    p = dict(zip(model.pieces, np.exp(logp).tolist(), strict=False))
    long, short = (b"thereading=" * 90)[: lm.LONG + 100], b"thereading=" * 20
    data = np.frombuffer(long + short, np.uint8)
    starts, size = np.array([0, len(long)]), np.array([len(long), len(short)])
    got = model.log_probabilities(data, starts, size, logp)
    assert math.isclose(got[1], math.log(_mass(b" " + short, p, model.longest)[0][-1]) + logp[model.end], rel_tol=1e-9)
    lm_all = lm.LONG
    try:
        lm.LONG = 10
        assert np.allclose(model.log_probabilities(data, starts, size, logp), got, rtol=1e-9)
        parts = model.expected(data, starts, size, logp)
        lm.LONG = 10_000
        assert np.allclose(model.log_probabilities(data, starts, size, logp), got, rtol=1e-9)
        assert np.allclose(model.expected(data, starts, size, logp), parts, rtol=1e-6, atol=1e-9)
    finally:
        lm.LONG = lm_all


def test_words_with_many_marks_at_their_edges():
    from tollgate.llm.toxicity import normalised, spans

    text = b"!" * 30 + b"idiot" + b"." * 12 + b" -- ok!! " + b"*" * 9
    data = normalised(np.frombuffer(text, np.uint8))
    starts, size, _ = spans(data, np.array([0, len(data)]))
    assert [text[s : s + n] for s, n in zip(starts.tolist(), size.tolist(), strict=True)] == [b"idiot", b"", b"ok", b""]


def test_components(spark):
    from tollgate.llm.graph import components

    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 200), (200, 150), (7, 7)] + [(300, 300 + k) for k in range(1, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[200] == got[150] == 100 and got[339] == 300


@pytest.mark.parametrize("name", ["substring", "suffixes", "packfile", "binpack", "lm", "toxicity", "decontam"])
def test_null_and_repeated_ids_and_empty_tables(spark, name):
    import importlib

    module = importlib.import_module(f"tollgate.llm.{name}")
    rows = [(None, "x y z", 1), (None, None, 1), (4, "same text here", 2), (4, "same text here", 2), (5, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    labels = spark.createDataFrame([(4, 0, 1)], "doc_id long, quality int, toxic int")
    run = {
        "substring": lambda d: module.substring_dedup(d),
        "suffixes": lambda d: module.suffix_dedup(d),
        "packfile": lambda d: module.token_files(d),
        "binpack": lambda d: module.pack_documents(d),
        "lm": lambda d: module.lattice_scores(d),
        "toxicity": lambda d: module.toxicity(d, labels),
        "decontam": lambda d: module.contaminated(d, d.select(F.lit(1).alias("item_id"), "text").where("text is not null")),
    }[name]
    got = [r.doc_id for r in run(docs).collect()]
    assert sorted(got, key=str) == sorted([None, None, 4, 4, 5] if name != "decontam" else got, key=str)
    assert run(docs.limit(0)).count() == 0


def test_queries_cover_all_operators():
    from tollgate.llm.queries import QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
    json.dumps(sorted(QUERIES))


def test_rare_toxic_terms_behind_many_common_words(spark):
    from tollgate.llm.toxicity import learn_lexicon

    common, bad = [f"q{k:04d}" for k in range(6000)], [f"{chr(97 + k)}zxw{k}" for k in range(20)]
    rows = [(1, " ".join([bad[d % 20], *(common[(600 * d + j) % 6000] for j in range(600))])) for d in range(100)]
    rows += [(0, " ".join(common[(600 * d + j) % 6000] for j in range(600))) for d in range(50)]
    lexicon = learn_lexicon(spark.createDataFrame([(i, t, y) for i, (y, t) in enumerate(rows)], "doc_id long, text string, toxic int"))
    assert set(bad) <= {t.decode() for t in lexicon} and not {t.decode() for t in lexicon} & set(common)


def test_decontamination_looks_at_every_window(spark):
    from tollgate.llm.decontam import contaminated

    rare, other, common = [f"r{k}" for k in range(4)], [f"b{k}" for k in range(12)], [f"c{k}" for k in range(44)]
    items = [(0, " ".join(rare + common)), (1, " ".join(other))]
    # The window of the best cosine begins with the rare terms alone and ends before most of the passage.
    passage = rare * 2 + [f"n{k}" for k in range(52)] + rare + other[:4] + common
    rows = [(0, " ".join(passage)), *((k, " ".join(common + [f"m{k}"] * 20)) for k in range(1, 60)), *((k, " ".join(other[k % 9 : k % 9 + 3])) for k in range(60, 70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.lcs, r.answer) for r in got] == [(0, 0, 1.0, 1.0)]


def test_near_duplicates_by_plain_jaccard_alone(spark):
    from tollgate.llm.neardup import near_duplicates, probability_jaccard, shingles, similarity, weights

    rows = []
    for k in range(40):
        base = [f"w{k}x{i}" for i in range(64)]
        line = [f"l{k}x{i}" for i in range(10)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + line * 100))]
    own = []
    for _, t in rows[:2]:
        raw = t.encode()
        _, h, count, _ = shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 5)
        own.append((h, count))
    every = np.unique(np.concatenate([h for h, _ in own]))
    x, y = (np.array([dict(zip(h.tolist(), weights(c).tolist(), strict=True)).get(e, 0.0) for e in every.tolist()]) for h, c in own)
    assert similarity(*own) >= 0.8 > 0.5 > probability_jaccard(x, y)
    assert probability_jaccard(x, y) <= np.minimum(x / x.sum(), y / y.sum()).sum() + 1e-9
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i - i % 2 for i in got)


def test_near_duplicate_blocks_find_what_weights_alone_link(spark):
    from tollgate.llm.neardup import _across, compress, shingles, similarity

    # Few plain shingles are shared, but they hold nearly all the weight.
    words, texts = [f"c{i}" for i in range(5)], []
    for tail in ("p", "q"):
        texts.append(" ".join(words * 2000 + [f"{tail}{i}" for i in range(4)]).encode())
    own = []
    for raw in texts:
        _, h, count, _ = shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 5)
        own.append((h, count))
    shared = len(np.intersect1d(own[0][0], own[1][0]))
    plain, most = shared / (len(own[0][0]) + len(own[1][0]) - shared), similarity(*own)
    assert plain < 0.4 < most
    rows = [(1, i, i, 2, bytearray(len(t).to_bytes(8, "little") + compress(t))) for i, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "band long, doc long, label long, n long, body binary")
    assert [(r.a, r.b) for r in _across(members, 5, most - 0.001, 512).collect()] == [(0, 1)]


def test_attribute_values_of_any_length():
    from time import perf_counter

    from tollgate.llm.pages import main_text

    inner = "<p>Leaked words, of no article at all.</p></article><div class='comment'>" * 200
    text = "Real words, which the article is made of, and more of them."
    for value in (f'"{inner}"', "'" + inner.replace("'", '"') + "'"):
        assert main_text(f"<body><article data-props={value}><p>{text}</p><p>{text}</p></article>") == f"{text}\n\n{text}".replace("\n\n", main_text(f"<body><article><p>{text}</p><p>{text}</p></article>")[len(text) : -len(text)])
    # Quotes that open no value, and one that nothing closes.
    for tag in ("<p title=don't>", "<p title='x>", '<p class="a"b">', '<p title = "a > b">'):
        assert main_text(f"<body><article>{tag}{text}</p><p>It is so.</p></article>").startswith(text), tag
    start = perf_counter()
    for bad in ('<a x=">"', "<a x='", '<a x="', "<a x=\"'", "<a ="):
        main_text(bad * 40_000)
    assert perf_counter() - start < 20
