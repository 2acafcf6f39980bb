"""Token ids in fixed-width bit-packed files with random access.

A file holds whole documents in ascending id order::

    payload   blocks of BLOCK ids, each id in ``bits`` bits, lowest bit first
    index     document ids (int64), their first token (uint64, one more at the
              end), byte offset of each block (uint64, one more at the end)
    trailer   magic, bits, ids per block, documents, tokens, blocks (48 bytes)

``bits`` is the least width that holds the vocabulary. A block is a whole
number of bytes, so any run of ids is found and unpacked alone with numpy.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import bucket_count, documents, materialize, nullable_ids, ranges, rows, scratch, text_columns
from tollgate.llm.tokens import default_path, encoder

BLOCK = 4096
MAGIC = b"TGPACK01"
TRAILER = struct.Struct("<8sQQQQQ")
SUFFIX = ".tgpack"


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Streams documents into one file; only the index is held in memory."""

    def __init__(self, stream, vocabulary: int):
        self.stream, self.bits = stream, width_of(vocabulary)
        self.waiting: list[np.ndarray] = []
        self.held = self.tokens = self.bytes = 0
        self.ids: list[int] = []
        self.starts, self.blocks = [0], [0]

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        self.starts.append(self.tokens)
        if self.held >= 16 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def add_end(self, ids: np.ndarray) -> None:
        """More ids of the document added last."""
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        self.starts[-1] = self.tokens

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        body = pack(ids[:count], self.bits)
        self.stream.write(body)
        for at in range(0, count, BLOCK):
            self.blocks.append(self.bytes + min(((at + BLOCK) * self.bits) // 8, len(body)))
        self.bytes += len(body)
        self.waiting, self.held = [ids[count:]], len(ids) - count

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        for values, kind in ((self.ids, "<i8"), (self.starts, "<u8"), (self.blocks, "<u8")):
            self.stream.write(np.array(values, kind).tobytes())
        self.stream.write(TRAILER.pack(MAGIC, self.bits, BLOCK, len(self.ids), self.tokens, len(self.blocks) - 1))


class Reader:
    """Random access to a file's bytes (any buffer)."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, self.bits, self.per_block, docs, self.tokens, blocks = TRAILER.unpack(self.data[len(self.data) - TRAILER.size :])
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = len(self.data) - TRAILER.size - 8 * (2 * docs + blocks + 2)
        self.ids = np.frombuffer(self.data, "<i8", docs, at)
        self.starts = np.frombuffer(self.data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        self.blocks = np.frombuffer(self.data, "<u8", blocks + 1, at + 8 * (2 * docs + 1)).astype(np.int64)

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the file; only their blocks are unpacked."""
        if count <= 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.per_block, (start + count - 1) // self.per_block
        have = min((last + 1) * self.per_block, self.tokens) - first * self.per_block
        ids = unpack(self.data[self.blocks[first] : self.blocks[last + 1]], self.bits, have)
        return ids[start - first * self.per_block :][:count]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i]))


MANIFEST = "part int, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them as packed files under ``path``, in
    ascending id order over the files. Returns the manifest, one row per file.

    Null text is empty and gives the end id alone. Null ids come first. Rows
    that share an id are all written, ordered by text. Other columns are
    ignored. An empty table writes no documents. A file is written under a
    name of its own and then renamed, so a repeated task does no harm.
    """
    tokenizer = tokenizer or default_path()
    parts = bucket_count(docs)
    ordered = documents(docs, id_col, text_col).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def save(batches):
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        own, final = f"{folder}/_{part:08d}-{uuid.uuid4().hex}", f"{folder}/part-{part:08d}{SUFFIX}"
        end, writer = np.array([end_id], np.uint32), None
        with fs.open_output_stream(own) as stream:
            writer = Writer(stream, max(coder.size, end_id + 1))
            for batch in batches:
                ids, data, offsets = text_columns(batch)
                for lo, hi in ranges(offsets, 2 << 20):
                    tokens, first = coder.encode(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    for i in range(hi - lo):
                        writer.add(int(ids[lo + i]), tokens[first[i] : first[i + 1]])
                        writer.add_end(end)
            writer.close()
        fs.move(own, final)
        yield rows(pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]), [part], [final.rsplit("/", 1)[-1]], [len(writer.ids)], [writer.tokens])

    path = _whole_path(docs.sparkSession, path)
    return materialize(ordered.mapInArrow(save, MANIFEST), "manifest")


def _whole_path(spark, path: str) -> str:
    """The folder's address with its file system, which is made if it isn't there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    whole = fs.makeQualified(folder).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digests(manifest: DataFrame, path: str) -> DataFrame:
    """Per document of the files: its first token over all files, its number of
    tokens and the checksum of its ids, from the files' bytes."""
    spark = manifest.sparkSession
    # Tokens before each file: within runs of parts, and before a run; runs are few.
    own = manifest.withColumn("run", F.floor(F.col("part") / 1024))
    runs = own.groupBy("run").agg(F.sum("n_tokens").alias("n")).select("run", F.coalesce(F.sum("n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = own.select("run", F.col("path").alias("name"), within.alias("within")).join(runs, "run").select("name", (F.col("within") + F.col("earlier")).alias("before"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def digest(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                file = Reader(content.as_buffer())
                n = len(file.ids)
                for lo in range(0, max(n, 1), 4096):
                    hi = min(n, lo + 4096)
                    a = int(file.starts[lo])
                    raw = memoryview(file.read(a, int(file.starts[hi]) - a).astype("<u4").tobytes())
                    at = ((file.starts[lo : hi + 1] - a) * 4).tolist()
                    crc = [zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (hi - lo), pa.string()), nullable_ids(file.ids[lo:hi]), pa.array(file.starts[lo:hi]), pa.array(np.diff(file.starts[lo : hi + 1])), pa.array(crc, pa.int64())], ["name", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = files.mapInArrow(digest, f"name string, {DIGESTS}")
    return found.join(before, "name").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as packed token files (in a folder of its own in the
    shared one, unless given) and return what the files hold per document."""
    path = path or f"{scratch(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_digests(write_tokens(docs, path, tokenizer, end_id), path)
