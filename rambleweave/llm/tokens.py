"""Encoding a corpus with a public tokenizer, inside the scan's own tasks: no shuffle, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Columns key and ids (array<int>): the ids of each text by byte-level BPE, without special tokens.

    Null and empty texts give an empty array, a null key stays null, a repeated row comes out as often as it comes
    in, an empty table gives an empty one, other columns are not read. Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            places, ids = bpe.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Columns key and n_tokens (int): the number of ids that encode gives. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.count(batch.column(1)).astype(np.int32))], names=["key", "n_tokens"])

    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, n_tokens int").withColumnRenamed("key", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Columns key and text: the text of each list of ids, by the table of the tokens' places. Null and empty lists give ''; ids that are no whole UTF-8 are replaced by U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            texts = bpe.decode(np.concatenate([[0], np.cumsum(size)]), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["key", "text"])

    import pyarrow.compute  # noqa: F401

    narrow = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, text string").withColumnRenamed("key", key)
