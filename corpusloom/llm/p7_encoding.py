"""Problem 7: encoding of the whole corpus with a public tokenizer, by prefix dynamic programming (``bpe``).

A null text and an empty text have no ids (an empty list); marker strings in a text are plain text.
The encoding is one pass over the scan, without a shuffle; ids leave Python as one flat array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.bpe import DEFAULT_RANKS, encoder
from corpusloom.llm.tables import table


def encode_batches(path: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        none = np.zeros(0, np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = [encode(t) if t else none for t in part["text"].to_pylist()]
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else none))], ["doc_id", "ids"])

    return make


def encode_documents(documents: DataFrame, path: str = DEFAULT_RANKS) -> DataFrame:
    """doc_id, ids of documents (doc_id, text)."""
    return documents.select("doc_id", "text").mapInArrow(encode_batches(path), "doc_id long, ids array<int>")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
