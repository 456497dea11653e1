"""Canonical words: case, accents, punctuation and spacing set aside."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def strip_marks(text: str) -> str:
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def canonical_words(text: str | None) -> list[str]:
    """Runs of letters and digits, case-folded, without combining marks."""
    return _WORD.findall(strip_marks((text or "").casefold())) if text else []


def slices(batches: Iterator[pa.RecordBatch], column: int, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many characters of ``column``, so that
    long texts don't fill a worker's memory."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.utf8_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > chars:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def with_words(df: DataFrame, keep: list[str], text_col: str, name: str = "words") -> DataFrame:
    """``keep`` and the canonical words of ``text_col`` joined by spaces (empty
    for null and wordless texts), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(canonical_words(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.string())], names=[*keep, name])

    rows = df.select(*keep, F.col(text_col).alias("__text"))
    kinds = dict(df.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), f"`{name}` string"]))
