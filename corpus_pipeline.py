"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tollgate
from tollgate.llm.binpack import pack_documents
from tollgate.llm.common import documents, materialize
from tollgate.llm.decontam import contaminated
from tollgate.llm.neardup import duplicate_classes, numbered
from tollgate.llm.suffixes import suffix_dedup
from tollgate.llm.toxicity import without_toxic

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    """With a number of each row, fixed by the write: ids may repeat or be null."""
    return materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Null and empty texts are scored too, as texts without words. Rows are judged
    one by one: those that share an id, or have none, stay or go by their own
    texts, and copies stay or go together. An empty table gives no rows.
    """
    tollgate.ship(spark)
    return without_toxic(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays, of the smallest id.

    Documents are told apart by id and text: those that share an id, or have
    none, are dropped only for a text that stays. Exact copies of a row with its
    id are one document, texts without words too. Null ids sort below all
    others. An empty table gives no rows.
    """
    tollgate.ship(spark)
    own = numbered(docs.select(*COLUMNS))
    kept = duplicate_classes(documents(docs)).where("keep").select(F.col("doc_id").alias("kept_id"), F.col("text_a").alias("kept_a"), F.col("text_b").alias("kept_b")).distinct()
    same = own["doc_id"].eqNullSafe(kept["kept_id"]) & (own["text_a"] == kept["kept_a"]) & (own["text_b"] == kept["kept_b"])
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text_a", "text_b"]).select(*COLUMNS)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur more than once are cut from every text.

    Every row stays, with what is left of its text, also if that is empty;
    n_chars is counted anew. A null text becomes an empty one. Rows are told
    apart by their place, so those that share an id, or have none, are documents
    of their own. An empty table gives no rows.
    """
    tollgate.ship(spark)
    own = _rows(docs)
    cut = suffix_dedup(own, id_col="row").select(F.col("doc_id").alias("row"), F.col("text").alias("cut"))
    joined = own.select("row", "doc_id", "lang", "source").join(cut, "row")
    return joined.select("doc_id", F.col("cut").alias("text"), "lang", "source", F.length("cut").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none and stay. Rows are judged one by one, whatever
    their ids; copies stay or go together. An empty table gives no rows, and an
    empty benchmark leaves all.
    """
    tollgate.ship(spark)
    own = _rows(docs)
    leaks = contaminated(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row").select(F.col("doc_id").alias("row")).distinct()
    return own.join(leaks, "row", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 1024 tokens.

    A null or empty text is one piece with the end id alone. Rows that share an
    id, or have none, are packed one by one. An empty table gives no rows.
    """
    tollgate.ship(spark)
    return pack_documents(docs, capacity=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_strings),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py has the brute-force check.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
