"""Shared plumbing of the training-data operators: input columns, durable
intermediate tables, bucket counts and packed binary blocks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of (compressed) input per bucket when the plan's size asks for more
#: buckets than the session's shuffle partitions.
BUCKET_BYTES = 32 << 20
#: Stands for a null document id inside blocks; it sorts below every real id.
NULL_ID = -(1 << 63)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a session that has none (tests, a single machine) gets its own.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = where.get() if where.isDefined() else None
    if not where:
        where = tempfile.mkdtemp(prefix="tollgate-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs a re-read, not a
    recomputation. Shuffle files of the write are removed when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm, root = spark._jvm, scratch(spark)
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.removeprefix("file:").lstrip("/") in file:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_count(df: DataFrame) -> int:
    """Buckets for hash-dealt blocks: one per shuffle partition, more if the
    estimated size asks for it; grows with the input, so that a bucket doesn't."""
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # statistics are advisory
        size = 0
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, min(size // BUCKET_BYTES, 1 << 22))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and text of a table, whatever else it holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), vectorised."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each document id; the same on every worker."""
    h = mix(np.ascontiguousarray(ids, dtype=np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int32)


def text_columns(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, UTF-8 bytes and offsets of the columns doc_id and text; null text is empty."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    ids = table.column("doc_id").combine_chunks()
    ids = (ids.fill_null(NULL_ID) if ids.null_count else ids).to_numpy(zero_copy_only=False)
    text = table.column("text").combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8) if len(text) and text.buffers()[2] is not None else np.zeros(0, np.uint8)
    return ids, data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(offsets: np.ndarray, limit: int):
    """Runs of whole items whose sizes add up to ``limit`` at most (one item may exceed it)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def compress(data: bytes, level: int = 1) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def decompress(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True) if size else b""


def encode(*arrays: np.ndarray) -> bytes:
    """Arrays of any dtypes as one compressed block; :func:`decode` reverses it."""
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = np.array([len(body), *(a.nbytes for a in arrays)], np.int64)
    return head.tobytes() + compress(body)


def decode(block: bytes, *dtypes) -> list[np.ndarray]:
    head = np.frombuffer(block, np.int64, 1 + len(dtypes))
    body, at, out = decompress(block[head.nbytes :], int(head[0])), 0, []
    for kind, size in zip(dtypes, head[1:].tolist(), strict=True):
        out.append(np.frombuffer(body, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def binary_column(table: pa.Table, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Blocks on their way to a bucket.
BLOCK = "bucket int, kind int, block binary"
BLOCK_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])


def deal(bucket: np.ndarray, kind: int, arrays: list[np.ndarray], out: list[tuple]) -> None:
    """Append one block per bucket present, each with its rows in their given order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    arrays = [a[order] for a in arrays]
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
        out.append((int(b[lo]), kind, encode(*(a[lo:hi] for a in arrays))))


def block_batch(out: list[tuple]) -> pa.RecordBatch:
    return rows(BLOCK_SCHEMA, [x[0] for x in out], [x[1] for x in out], [x[2] for x in out])


def block_table(out: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([block_batch(out)], schema=BLOCK_SCHEMA)


#: Kinds of text blocks.
TEXT = 0


def text_block(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, bucket: np.ndarray, out: list[tuple]) -> None:
    """Append one block of whole texts per bucket present: ids, lengths and bytes."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    raw = data.tobytes()
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
        own = order[lo:hi]
        body = b"".join(raw[offsets[i] : offsets[i + 1]] for i in own.tolist())
        out.append((int(b[lo]), TEXT, encode(ids[own], offsets[own + 1] - offsets[own], np.frombuffer(body, np.uint8))))


def read_text(blocks: list[bytes]):
    """Ids, bytes and offsets of the documents in each text block in turn."""
    for block in blocks:
        ids, lengths, data = decode(block, np.int64, np.int64, np.uint8)
        yield ids, data, np.concatenate([[0], np.cumsum(lengths)])


def packed_texts(docs: DataFrame, n_buckets: int, limit: int = 4 << 20) -> DataFrame:
    """Whole texts as compressed blocks, each dealt to its document's bucket."""

    def pack(batches):
        for batch in batches:
            ids, data, offsets = text_columns(batch)
            for lo, hi in ranges(offsets, limit):
                out: list[tuple] = []
                text_block(ids[lo:hi], data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], bucket_of(ids[lo:hi], n_buckets), out)
                yield block_batch(out)

    return docs.mapInArrow(pack, BLOCK)


def nullable_ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)
