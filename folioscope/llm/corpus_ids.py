"""Problem 7: encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import BYTE_BPE, broadcast_tokenizer, byte_strings, list_array, load, text_chunks

_byte_strings: dict[int, list[bytes]] = {}


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str = BYTE_BPE, offsets: bool = False) -> DataFrame:
    """``(id, ids)`` of every row, without special tokens; with ``offsets``
    also ``starts`` and ``ends``, the characters (from 0, end exclusive) that
    each id covers. Ids that share one character, because its bytes were
    split, all carry that character's place.

    A narrow map: no shuffle, no Python object per token. Null and empty texts
    give empty lists; blank texts are encoded as they stand; repeated rows are
    encoded each; other columns, whatever their names, are not read.
    """
    shared = broadcast_tokenizer(df.sparkSession, path)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(shared)
        for batch in batches:
            row = 0
            for texts in text_chunks(batch.column(1).to_pylist()):
                if offsets:
                    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
                else:
                    encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
                columns = {"id": batch.column(0).slice(row, len(texts)), "ids": list_array([np.array(e.ids, np.int32) for e in encoded], pa.int32())}
                if offsets:
                    places = [np.array(e.offsets, np.int32).reshape(-1, 2) for e in encoded]
                    columns["starts"] = list_array([p[:, 0] for p in places], pa.int32())
                    columns["ends"] = list_array([p[:, 1] for p in places], pa.int32())
                row += len(texts)
                yield pa.RecordBatch.from_pydict(columns)

    extra = ", starts array<int>, ends array<int>" if offsets else ""
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>{extra}")
    return out.withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str = BYTE_BPE) -> DataFrame:
    """``(id, n_tokens)``; null and empty texts have 0. The ids themselves
    never leave the worker."""
    shared = broadcast_tokenizer(df.sparkSession, path)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(shared)
        for batch in batches:
            counts: list[int] = []
            for texts in text_chunks(batch.column(1).to_pylist()):
                counts += [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_tokens": pa.array(counts, pa.int64())})

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def decode_corpus(df: DataFrame, id_col: str, ids_col: str, path: str = BYTE_BPE) -> DataFrame:
    """``(id, text)`` back from ids by the reversed byte table. Bytes are
    joined before they are read as UTF-8, so characters split over ids come
    back whole; a sequence that starts or ends inside a character gets U+FFFD
    there. Null ids give a null text, an empty list an empty text."""
    shared = broadcast_tokenizer(df.sparkSession, path)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _byte_strings:
            _byte_strings[key] = byte_strings(load(shared))
        pieces = _byte_strings[key]
        for batch in batches:
            texts = [None if ids is None else b"".join(pieces[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text": pa.array(texts, pa.string())})

    out = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)
