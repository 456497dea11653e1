"""Problem 6: tokens per document, summed by source, language and domain.

Texts are cut into the tokenizer's own pieces (words with their leading
space, numbers, punctuation, white space). A piece that is a vocabulary entry
is one token and is counted where it stands. The other distinct pieces are
range-partitioned and sorted, so that each partition is a prefix trie walked
in depth-first order; along the path the exact tokenization state of every
prefix is kept, and only what follows the shared prefix is computed anew.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width
from .labels import language_code
from .tokenizer import BYTE_BPE, broadcast_tokenizer, load

NO_LANGUAGE = "(unlabelled)"
NO_SOURCE = "(no source)"
NO_DOMAIN = "(unmapped)"
#: Known pairs of neighbouring tokens that a worker keeps.
PAIR_MEMORY = 1 << 18


class PrefixStates:
    """Exact byte-pair encoding of every prefix of a string, one character
    (one byte of the text) at a time.

    A sequence of tokens is the encoding of its string exactly if each pair of
    neighbours encodes to itself. So the last token of a prefix is the one
    suffix that is a token and forms such a pair with the last token of what
    stands before it, and the count is one more than there.
    """

    def __init__(self, tokenizer) -> None:
        self.vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, self.vocabulary))
        self.model = tokenizer.model
        self.pairs: dict[tuple[str, str], bool] = {}
        self.text = ""
        self.last: list[str] = [""]
        self.count: list[int] = [0]

    def fits(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_MEMORY:
                self.pairs.clear()
            known = [t.value for t in self.model.tokenize(left + right)] == [left, right]
            self.pairs[key] = known
        return known

    def tokens(self, piece: str) -> int:
        """Tokens of ``piece``; keeps the states of the prefix that it shares
        with the piece before."""
        shared = 0
        for a, b in zip(self.text, piece, strict=False):
            if a != b:
                break
            shared += 1
        del self.last[shared + 1 :], self.count[shared + 1 :]
        self.text = piece
        for end in range(shared + 1, len(piece) + 1):
            for size in range(min(end, self.longest), 0, -1):
                token = piece[end - size : end]
                if token in self.vocabulary and (size == end or self.fits(self.last[end - size], token)):
                    self.last.append(token)
                    self.count.append(self.count[end - size] + 1)
                    break
            else:
                raise ValueError(f"no token ends at {end} of {piece!r}")
        return self.count[-1]


def _pieces(df: DataFrame, shared: Broadcast, kind: str) -> DataFrame:
    """(id, piece, n): for each row its distinct pieces that are no vocabulary
    entry, and under the null piece the number of those that are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(shared)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        cut = tokenizer.pre_tokenizer.pre_tokenize_str
        for batch in batches:
            rows: list[int] = []
            pieces: list[str | None] = []
            counts: list[int] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                whole, rest = 0, Counter()
                if text:
                    for piece, _ in cut(text):
                        if piece in vocabulary:
                            whole += 1
                        else:
                            rest[piece] += 1
                rows += [row] * (len(rest) + 1)
                pieces += [None, *rest]
                counts += [whole, *rest.values()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(pa.array(rows, pa.int32())), "piece": pa.array(pieces, pa.string()), "n": pa.array(counts, pa.int64())})

    return df.mapInArrow(run, f"id {kind}, piece string, n long")


def _piece_tokens(pieces: DataFrame, shared: Broadcast) -> DataFrame:
    """(piece, n_tokens) of distinct pieces, by walks over sorted ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = PrefixStates(load(shared))
        for batch in batches:
            counts = [states.tokens(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"piece": batch.column(0), "n_tokens": pa.array(counts, pa.int64())})

    ranges = pieces.repartitionByRange(shuffle_width(pieces.sparkSession), "piece").sortWithinPartitions("piece")
    return ranges.mapInArrow(run, "piece string, n_tokens long")


def document_tokens(df: DataFrame, id_col: str, text_col: str, path: str = BYTE_BPE) -> DataFrame:
    """``(id, n_tokens)`` for every row of ``df``, exact.

    ``id_col`` must tell rows apart; rows that repeat an id are summed into one
    row. Null and empty texts have 0 tokens. A null id counts as an id.
    """
    spark = df.sparkSession
    shared = broadcast_tokenizer(spark, path)
    found = cut_lineage(_pieces(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shared, dict(df.dtypes)[id_col]))
    rare = found.filter(F.col("piece").isNotNull())
    lengths = _piece_tokens(rare.select("piece").distinct(), shared)
    counted = rare.join(lengths, "piece").select("id", (F.col("n") * F.col("n_tokens")).alias("t"))
    whole = found.filter(F.col("piece").isNull()).select("id", F.col("n").alias("t"))
    return whole.unionByName(counted).groupBy("id").agg(F.sum("t").alias("n_tokens")).withColumnRenamed("id", id_col)


def source_name(source: Column) -> Column:
    """One spelling per source: lower case, words joined by ``_``."""
    plain = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")
    return F.when(plain != "", plain)


def token_budget(df: DataFrame, domains: DataFrame, id_col: str, text_col: str, source_col: str, language_col: str, path: str = BYTE_BPE) -> DataFrame:
    """``source, language, domain, n_docs, n_with_text, n_tokens``.

    Sources and languages are brought to one spelling; rows without a label,
    source or mapped domain stay in view under ``(unlabelled)``,
    ``(no source)`` and ``(unmapped)``. ``domains`` (source, domain) is a small
    fixed table; of several domains for one source the least is taken.
    """
    rows = df.select(F.col(id_col).alias("__id"), source_name(F.col(source_col)).alias("__source"), language_code(F.col(language_col)).alias("__language"), (F.length(F.coalesce(F.col(text_col), F.lit(""))) > 0).alias("__text"))
    tokens = document_tokens(df, id_col, text_col, path).withColumnsRenamed({id_col: "__tid", "n_tokens": "__n"})
    names = domains.select(source_name(F.col("source")).alias("__name"), F.col("domain").alias("__domain")).filter("__name is not null").groupBy("__name").agg(F.min("__domain").alias("__domain"))
    # one row per id carries the id's tokens: repeated ids must not count twice
    first = rows.groupBy("__id").agg(F.min(F.struct("__source", "__language", "__text")).alias("r")).select("__id", "r.*")
    slices = first.join(tokens, first["__id"].eqNullSafe(tokens["__tid"])).groupBy("__source", "__language").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("__text").alias("n_with_text"), F.sum("__n").alias("n_tokens"))
    return slices.join(names, slices["__source"] == names["__name"], "left").select(
        F.coalesce("__source", F.lit(NO_SOURCE)).alias("source"),
        F.coalesce("__language", F.lit(NO_LANGUAGE)).alias("language"),
        F.coalesce("__domain", F.lit(NO_DOMAIN)).alias("domain"),
        "n_docs",
        "n_with_text",
        "n_tokens",
    )
