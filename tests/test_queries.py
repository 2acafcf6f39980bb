"""Every query of the catalogue against its SQL, on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tollgate.plans import boundary, shipped  # noqa: F401  register their queries
from tollgate.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    return sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = rows(columns, [[r[c] for c in columns] for r in frame.collect()])
    if name not in ORACLE_SQL:
        assert got
        return
    want = db.sql(ORACLE_SQL[name])
    at = [list(want.columns).index(c) for c in columns]
    assert len(want.columns) == len(columns)
    assert got == rows(columns, [[r[i] for i in at] for r in want.fetchall()])


def test_audit_lines_of_sessions_numbered_like_a_card(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select * replace (user_id + 4100 as user_id) from '{SF}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert con.execute("select count(*) from events where user_id = 4111").fetchall()[0][0]
    want = con.sql(ORACLE_SQL["audit_lines"])
    got = QUERIES["audit_lines"](spark, str(tmp_path)).select(*want.columns).collect()
    assert rows(None, got) == rows(None, want.fetchall())


def test_content_in_audit_lines_is_seen(spark):
    hashed = '"content_hash":"4111' + "0" * 60 + '"'
    lines = {
        '{"session_id":"4111","surface":"input",' + hashed + "}": False,
        '{"session_id":"card 4111 1111","surface":"input"}': True,
        '{"session_id":"4111","source":"4111"}': True,
        '{"content_hash":"4111"}': True,
        '{"findings":[{"type":"jane.doe"}],' + hashed + "}": True,
        '{"source":"\\"session_id\\":\\"4111\\""}': True,
    }
    found = spark.createDataFrame([(x,) for x in lines], "line string").select("line", boundary.holds_content(F.col("line")).alias("found")).collect()
    assert {r.line: r.found for r in found} == lines


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["hop_id", "surface", "action", "taint_session", "n_findings", "n_redactions", "content_hash"]
