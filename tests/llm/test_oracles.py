"""The queries that SQL can express against their SQL, on the smallest tables and
on texts and vectors with nulls, repeated rows, ties and edges."""

import duckdb
import pyarrow.parquet as pq
import pytest

from tollgate.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def compare(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    frame = QUERIES[name](spark, str(folder))
    columns = sorted(frame.columns)
    got = sorted(tuple(r[c] for c in columns) for r in frame.collect())
    want = db.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())
    return got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert compare(spark, SF, name)


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Texts that are null, empty, repeated, of odd white space, of several bytes a character, near each other; vectors likewise."""
    import random

    import pyarrow as pa

    rng = random.Random(3)

    def prose(n):
        return " ".join(f"{rng.choice(['ana', 'über', 'x', '日本', 'mo.'])}{rng.randint(0, 400)}" for _ in range(n))

    long, passage, short = prose(600), prose(120), prose(9)
    words = long.split(" ")
    texts = [None, "", " \t\n", "one", "one", "one  two", "one\ttwo", short, short + " end", long, long.replace(" ", " "), "\x0b" + long, passage + " " + passage, prose(80) + passage, passage + prose(3), "ab" * 500, "日" * 300, "x" * 399, "x" * 400, prose(49), prose(50)]
    texts += [" ".join([*words[:k], "edit", *words[k + 1 :]]) for k in (0, 4, 300, 599)] + [" ".join([*words, *words[10:60]]), " ".join([*words, *["line of six plain words here"] * 40])]
    rng.shuffle(texts)
    vectors = [[float(rng.randint(-2, 2)) for _ in range(6)] for _ in range(90)] + [[0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, None]
    folder = tmp_path_factory.mktemp("edges")
    pq.write_table(pa.table({"doc_id": pa.array([3 * i for i in range(len(texts))], pa.int64()), "text": pa.array(texts)}), folder / "documents.parquet")
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_edges(spark, edges, name):
    assert compare(spark, edges, name)
