"""A public byte-level BPE tokenizer inside Arrow batches.

The tokenizer file is read once on the driver and broadcast (its size is that
of the vocabulary, a few MB, whatever the data). Each Python worker builds the
tokenizer once and keeps it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import SparkSession

#: Default place of the vocabulary files; every operator takes a path.
TOKENIZER_FOLDER = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZER_FOLDER}/byte_bpe_50k.json"
#: A vocabulary file above this is not broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Characters handed to the tokenizer at once; bounds a worker's memory.
CHUNK_CHARS = 1 << 20

_loaded: dict[int, object] = {}


def broadcast_tokenizer(spark: SparkSession, path: str = BYTE_BPE) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        content = f.read()
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return spark.sparkContext.broadcast(content)


def load(shared: Broadcast):
    """The tokenizer of a broadcast; strings of special tokens in a text are
    ordinary text."""
    content = shared.value
    key = hash(content)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(content)
        tokenizer.encode_special_tokens = True
        _loaded[key] = tokenizer
    return _loaded[key]


def text_chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, nulls as empty, in lists of bounded size."""
    chunk: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if chunk and size + len(text) > CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list per array, without a Python object per element."""
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: bytes
    that print stand for themselves, the others take code points from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, spare = {}, 256
    for byte in range(256):
        if byte in plain:
            table[byte] = chr(byte)
        else:
            table[byte] = chr(spare)
            spare += 1
    return table


def byte_strings(tokenizer) -> list[bytes]:
    """The bytes of each id; an added token's string is its own UTF-8."""
    back = {c: b for b, c in byte_alphabet().items()}
    out = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i)
        try:
            out.append(bytes(back[c] for c in token))
        except KeyError:
            out.append(token.encode())
    return out
