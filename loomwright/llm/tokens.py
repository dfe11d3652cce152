"""Corpus encoding and token counts with a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.llm.automaton import DEFAULT_PATH, load_tokenizer
from loomwright.session import spread

#: Bytes of text that are encoded between two output batches; memory only, no row is dropped.
SLICE_BYTES = 4_000_000


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """(id_col, ids): token ids of each row's whole text, no special tokens added, none recognised.

    Null and empty texts give an empty list, never null. One narrow stage, no shuffle; repeated rows stay repeated.
    """
    src = spread(docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text")))
    schema = T.StructType([T.StructField(id_col, src.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = load_tokenizer(path).encode
        for batch in batches:
            # a batch of long texts is cut, so that the Python lists of one slice stay small
            step = max(1, SLICE_BYTES * batch.num_rows // max(1, batch.column(1).nbytes))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = [one(t) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=ends[1:])
                flat = np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return src.mapInArrow(encode, schema)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_PATH) -> DataFrame:
    """(id_col, n_tokens); 0 for null and empty texts."""
    src = spread(docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text")))
    schema = T.StructType([T.StructField(id_col, src.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = load_tokenizer(path).count
        for batch in batches:
            n = pa.array([one(t) for t in batch.column(1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=[id_col, "n_tokens"])

    return src.mapInArrow(count, schema)
