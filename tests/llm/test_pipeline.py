"""The pipeline on small tables: every stage against a plain version of its decision."""

import re

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        result = P.materialize(stage(spark, docs, SF), name)
        out.append((name, docs, result))
        docs = result
    return out


def test_columns_and_ids(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == list(P.COLUMNS), name
        a, b = {r.doc_id for r in before.collect()}, [r.doc_id for r in after.collect()]
        assert set(b) <= a and len(b) == len(set(b)), name


def test_near_duplicates_leave_one_each(stages):
    _, before, after = stages[1]
    kept = {r.doc_id: r.text for r in after.collect()}

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in kept.items()}
    for a in kept:
        for b in kept:
            if a < b and sets[a]:
                assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    texts = {}
    for r in before.collect():
        texts.setdefault(r.text, []).append(r.doc_id)
    assert all(min(ids) in kept or all(i not in kept for i in ids) for ids in texts.values())


def test_no_long_string_occurs_twice(stages):
    _, before, after = stages[2]
    length, count = 400, {}
    for r in before.collect():
        raw = r.text.encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            count[s] = count.get(s, 0) + 1
    kept = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        raw = r.text.encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            if count[raw[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        text = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode(errors="ignore")
        assert (kept[r.doc_id].text, kept[r.doc_id].n_chars, kept[r.doc_id].lang) == (text, len(text), r.lang)


def test_benchmark_passages_go(spark, stages):
    _, before, after = stages[3]

    def words(text):
        return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))

    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in after.collect()}
    for r in before.collect():
        assert (r.doc_id in kept) == (not any(i in words(r.text) for i in items if i))


def test_packing_holds_every_document(spark, stages):
    _, before, after = stages[4]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}
    assert after.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


def test_run(spark, stages):
    assert P.run(spark, SF).count() == stages[-1][2].count()


def test_near_duplicates_are_told_apart_by_text_and_not_by_id(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b + " tail"), (7, c), (7, d), (8, d), (9, b), (9, ""), (None, None), (10, c + " tail"), (7, d)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted((t or "")[:1] for _, t in kept) == ["", "", "a", "b", "c", "d"]
    assert {(i, (t or "")[:1]) for i, t in kept} == {(None, "a"), (None, "b"), (7, "c"), (7, "d"), (9, ""), (None, "")}


def test_later_stages_tell_rows_apart_when_ids_do_not(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 12)
    texts = [" ".join(f"{x}{k}" for k in range(20)) for x in "abc"] + [item]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i in (None, 7) for t in texts[:3] if (i, t) != (7, texts[2])] + [(None, item, "en", "web", len(item))], "doc_id long, text string, lang string, source string, n_chars long")
    before = sorted((str(r.doc_id), r.text) for r in docs.collect())
    assert sorted((str(r.doc_id), r.text) for r in P.cut_repeated_strings(spark, docs, SF).collect()) == before
    assert sorted((str(r.doc_id), r.text) for r in P.drop_contaminated(spark, docs, SF).collect()) == [x for x in before if x[1] != item]


def test_toxicity_stage_drops_what_the_operator_rejects(spark, stages):
    from tollgate.llm.toxicity import toxicity

    _, before, after = stages[0]
    scored = toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"), folds=4, fold=2, threshold=0.3)
    clean = {r.doc_id for r in scored.collect() if r.score < 0.3}
    assert {r.doc_id for r in after.collect()} == clean


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row long, cut string, tag string, bucket int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty texts, ids that repeat, rows that repeat, a
    long text, and columns with names that the stages use."""
    words = [" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 30), ("b", 30), ("c", 40_000))]
    rows = [(None, None), (None, ""), (None, words[0]), (5, words[1]), (5, words[1]), (5, " "), (6, None), (7, words[2]), (8, "\t\n")]
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", None, 0) for i, t in rows], EXTRA)


def shape(frame):
    return sorted((str(r.doc_id), r.text or "") for r in frame.collect())


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_stages_on_odd_tables(spark, odd, name, stage):
    after = stage(spark, odd, SF)
    assert after.columns == list(P.COLUMNS)
    want = shape(odd)
    if name == "near_dedup":
        want.remove(("5", next(t for i, t in want if t.startswith("b0"))))
    assert shape(after) == want
    assert shape(stage(spark, odd.limit(0), SF)) == []


def test_packing_of_odd_tables(spark, odd):
    packed = P.pack_sequences(spark, odd, SF)
    rows = packed.collect()
    assert sorted(str(r.doc_id) for r in rows if r.piece == 0) == sorted(str(r.doc_id) for r in odd.collect())
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024
    assert P.pack_sequences(spark, odd.limit(0), SF).count() == 0
