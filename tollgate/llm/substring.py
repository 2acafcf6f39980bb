"""Substring dedup: passages of ``width`` words that an earlier document has."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tollgate.llm.common import documents, nullable_ids
from tollgate.llm.cover import Rule, repeats
from tollgate.llm.symbols import Words, word_spans

SCHEMA = "doc_id long, n_words long, n_removed long, text string"


def substring_dedup(docs: DataFrame, width: int = 50, q: int = 5, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Remove every word that lies in a window of ``width`` words which also
    starts in a document with a smaller id (difference-cover anchors).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Windows are judged on the
    input. Returns one row per document: doc_id, n_words, n_removed and the kept
    words joined by one space (``text``, or ``kept_sha256`` with ``digest``).

    Null or empty text: no words, nothing removed. A null id is smaller than any
    other. Rows that share an id count as one document: none is earlier than the
    other, and what is removed at a position of one is removed in all. Other
    columns are ignored. An empty table gives an empty result.
    """
    rule = Rule(Words(), width, q)
    last = "kept_sha256" if digest else "text"

    def finish(ids, data, offsets, covered) -> pa.Table:
        starts, ends, first = word_spans(data, offsets)
        raw, total, gone, kept = data.tobytes(), np.diff(first), [], []
        for i in range(len(ids)):
            a, b = int(first[i]), int(first[i + 1])
            cover = covered(i, b - a)
            words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            if cover is not None:
                words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
            gone.append(b - a - len(words))
            body = b" ".join(words)
            kept.append(hashlib.sha256(body).hexdigest() if digest else body.decode())
        return pa.table({"doc_id": nullable_ids(ids), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), last: pa.array(kept, pa.string())})

    return repeats(documents(docs, id_col, text_col), rule, finish, SCHEMA.replace("text", last))
