"""Token counts per document by a compiled finite-state tokenizer.

Null or empty texts count 0 tokens and 0 bytes. Rows are independent: repeated rows each get their
row back, a null ``doc_id`` stays null, other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import doc_id_of, ship, text_of, text_slices
from .bpe import Transducer, loaded, vocabulary_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) of every row."""
    ship(docs.sparkSession)
    path = vocabulary or vocabulary_path()

    def run(batches):
        machine = loaded(Transducer, path)
        for rows, texts in text_slices(batches):
            n = machine.counts(texts)
            size = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(doc_id_of(docs).alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, SCHEMA)
