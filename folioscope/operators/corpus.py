"""Corpus operators: dedup, balance, splits, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, infer_language, is_verse, word_count
from ..session import cut_lineage
from .ranking import hash_rank, seeded_hash, values_at

BINS = 8
SEED = 42


def process(df: DataFrame, text: str, order: str, **options: object) -> DataFrame:
    """Cleans ``text``, drops empty results and keeps, of equal texts, the row
    with the least ``order``. Null texts are dropped; the text column comes last.

    One aggregation on the hash: copies are reduced before the shuffle, so a
    text that a third of the rows share costs one row per task."""
    columns = [c for c in df.columns if c != text]
    cleaned = df.withColumn("__clean", clean(F.col(text), **options)).filter(F.length("__clean") > 0)
    row = F.struct(*columns, F.col("__clean").alias(text))
    first = cleaned.withColumn("__md5", F.md5("__clean")).groupBy("__md5").agg(F.min_by(row, F.struct(F.col(order), F.xxhash64(*columns))).alias("__row"))
    return first.select("__row.*")


def bin_edges(df: DataFrame, count: str, bins: int = BINS) -> DataFrame:
    """(edge): the distinct values at index ``int(n * i / bins)`` of the sorted
    counts, i from 1; no rows for an empty input."""
    names = {f"e{i}": i / bins for i in range(1, bins)}
    row = values_at(df, count, names, last=False)
    return row.select(F.explode(F.array(*names)).alias("edge")).filter("edge is not null").distinct()


def with_strata(df: DataFrame, text: str, bins: int = BINS, form: bool = True) -> DataFrame:
    """Adds ``bin`` (number of edges at or below the word count), and with
    ``form`` also ``language`` and ``verse``."""
    counted = df.withColumn("__words", word_count(F.col(text)))
    edges = bin_edges(counted, "__words", bins).agg(F.collect_list("edge").alias("__edges"))  # one row, fewer than `bins` values
    out = counted.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("__edges", lambda e: e <= F.col("__words")))).drop("__words", "__edges")
    if form:
        out = out.withColumns({"language": infer_language(F.col(text)), "verse": is_verse(F.col(text))})
    return out


def strata_columns(form: bool = True) -> list[str]:
    return ["bin", "language", "verse"] if form else ["bin"]


def surface_cells(df: DataFrame, text: str, label: str, bins: int = BINS, form: bool = True) -> DataFrame:
    """Per stratum the smaller of the two class counts, where it is not 0."""
    strata = strata_columns(form)
    counts = with_strata(df, text, bins, form).groupBy(*strata).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    return counts.select(*strata, F.least("p", "n").alias("kept")).filter("kept > 0")


def balanced(df: DataFrame, label: str, key: str, strata: list[str], seed: int = SEED) -> DataFrame:
    """In each stratum as many rows of either class as the smaller has, chosen
    by seeded hash; strata of one class vanish."""
    ranked = hash_rank(df.filter(F.col(label).isin(0, 1)), [*strata, label], seeded_hash(seed, key), key, "__rank")
    counts = df.groupBy(*strata).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    keep = counts.select(*(F.col(s).alias(f"__s{i}") for i, s in enumerate(strata)), F.least("p", "n").alias("__keep"))
    on = F.col("__rank") <= F.col("__keep")
    for i, s in enumerate(strata):
        on = on & ranked[s].eqNullSafe(keep[f"__s{i}"])
    return ranked.join(keep, on).drop("__rank", "__keep", *(f"__s{i}" for i in range(len(strata))))


def length_matched(df: DataFrame, text: str, label: str, key: str, seed: int = SEED, bins: int = BINS, form: bool = True) -> DataFrame:
    """``key, label`` and stratum of the rows kept by :func:`balanced`; join them
    with the texts where those are needed. The texts are read for the strata
    only; what is ranked and counted after that is narrow and kept once."""
    strata = with_strata(df.select(key, text, label), text, bins, form).select(key, label, *strata_columns(form))
    return balanced(cut_lineage(strata), label, key, strata_columns(form), seed)


def undersample(df: DataFrame, label: str, key: str, seed: int = SEED) -> DataFrame:
    """Trims the larger class only."""
    return balanced(df.withColumn("__all", F.lit(1)), label, key, ["__all"], seed).drop("__all")


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.15, seed: int = SEED) -> DataFrame:
    """Adds ``part``: ``val`` for ``round(share * n)`` rows of each label, else
    ``train``."""
    ranked = hash_rank(df, [label], seeded_hash(seed, key), key, "__rank")
    sizes = df.groupBy(F.col(label).alias("__label")).agg(F.round(F.count(F.lit(1)) * share).cast("long").alias("__val"))
    joined = ranked.join(sizes, ranked[label].eqNullSafe(sizes["__label"]))
    return joined.withColumn("part", F.when(F.col("__rank") <= F.col("__val"), "val").otherwise("train")).drop("__rank", "__label", "__val")


def kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``fold`` 0..k-1, even within each label."""
    return hash_rank(df, [label], seeded_hash(seed, key), key, "__rank").withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n`` rows without replacement: those with the least seeded hashes."""
    return df.orderBy(seeded_hash(seed, key), key).limit(n)


def class_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.filter(F.col(split).isNotNull()).groupBy(split).agg(F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))


def corpus_hash(df: DataFrame, text: str, groups: list[str] | None = None) -> DataFrame:
    """``text_hash``: SHA-256 of the sorted texts joined by newlines, nulls left
    out; of no text, the hash of nothing. Meant for builds of bounded size: the
    texts of a group are joined in one task. For whole corpora see
    :func:`corpus_fingerprint`."""
    joined = F.array_join(F.array_sort(F.collect_list(text)), "\n")
    grouped = df.groupBy(*groups) if groups else df
    return grouped.agg(F.sha2(joined, 256).alias("text_hash"))


def corpus_fingerprint(df: DataFrame, text: str) -> DataFrame:
    """``fingerprint, n_texts``: drift check of any size, in constant memory:
    the sum modulo 2^64 halves of all text hashes. Another value than
    :func:`corpus_hash`; order does not matter, repeats count."""
    digest = F.sha2(F.col(text), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)"))
    sums = df.filter(F.col(text).isNotNull()).agg(F.count(F.lit(1)).alias("n_texts"), *(part(i).alias(f"s{i}") for i in range(8)))
    return sums.select(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(8))), 256).alias("fingerprint"), "n_texts")


def drifted(actual: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Builds whose recomputed ``text_hash`` is not the manifest's; a build in
    only one of the two has drifted as well."""
    a, m = actual.select(key, F.col("text_hash").alias("actual_hash")), manifest.select(key, F.col("text_hash").alias("manifest_hash"))
    return a.join(m, key, "full").filter(~F.col("actual_hash").eqNullSafe(F.col("manifest_hash")))


def label_union(positives: DataFrame, negatives: DataFrame, text: str) -> DataFrame:
    """Positives with label 1 and negatives with label 0, other columns kept
    where both have them."""
    return positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)), allowMissingColumns=True)


def with_unfinished(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not finished yet; null keys are never finished."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def keep_same_language(candidates: DataFrame, sources: DataFrame, key: str, candidate_text: Column, source_text: Column) -> DataFrame:
    """Candidates in the language of their source text."""
    langs = sources.select(F.col(key).alias("__key"), infer_language(source_text).alias("__lang"))
    return candidates.join(langs, candidates[key] == F.col("__key")).filter(infer_language(candidate_text) == F.col("__lang")).drop("__key", "__lang")
