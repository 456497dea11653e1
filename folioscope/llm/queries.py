"""Registered queries of the training-data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, prepare, table
from .components import file_column, grouped_splits, record_keys, related_groups, tied_records
from .corpus_ids import decode_corpus, encode_corpus
from .cross_split import cross_split_pairs, cross_split_report
from .cutoff import cut_rates, cut_records
from .encoding_repair import find_garbled
from .language import fit_profiles, language_segments, text_languages, unnamed_languages
from .long_spans import shared_part, shared_stretches
from .packing import CAPACITY, container_fill, pack_texts
from .token_budget import document_tokens, token_budget


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return cross_split_pairs(table(spark, folder, "writing_samples"), "sample_id", "text", "split")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return cross_split_report(table(spark, folder, "writing_samples"), table(spark, folder, "manifest"), "sample_id", "text", "split", file_column(F.col("source")))


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    keys = record_keys(table(spark, folder, "writing_samples"), "sample_id", "source", "author", "text", table(spark, folder, "entities"))
    return related_groups(keys, "sample_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return tied_records(_groups(spark, folder), "sample_id")


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_splits(cut_lineage(_groups(spark, folder)), "sample_id")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Samples and completions as (rec_kind, rec_id, text)."""
    prepare(spark)
    samples = table(spark, folder, "writing_samples").select(F.lit("sample").alias("rec_kind"), F.col("sample_id").alias("rec_id"), "text")
    completions = table(spark, folder, "eval_completions").select(F.lit("completion").alias("rec_kind"), F.col("completion_id").alias("rec_id"), F.col("grpo_completion").alias("text"))
    return samples.unionByName(completions)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_stretches(_records(spark, folder)).drop("n_chars")


def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shared_part(shared_stretches(_records(spark, folder)))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of blog and probe texts; profiles from the labelled rows of
    both and of documents."""
    prepare(spark)
    blog = table(spark, folder, "blog_en").select(F.lit("blog_en").alias("rec_kind"), F.col("blog_id").cast("string").alias("rec_key"), "text", F.col("language").alias("lang"))
    probes = table(spark, folder, "probe_texts").select(F.lit("probe_texts").alias("rec_kind"), F.col("id").alias("rec_key"), "text", "lang")
    texts = blog.unionByName(probes)
    labelled = texts.select("text", "lang").unionByName(table(spark, folder, "documents").select("text", "lang"))
    return language_segments(texts, ["rec_kind", "rec_key"], "text", "lang", fit_profiles(labelled, "text", "lang"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return unnamed_languages(_segments(spark, folder), ["rec_kind", "rec_key"])


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder)


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    return text_languages(_segments(spark, folder), ["rec_kind", "rec_key"])


def _cut(spark: SparkSession, folder: str) -> DataFrame:
    """Samples by source file, completions by model; a run in no table gives
    its completions no model."""
    prepare(spark)
    samples = table(spark, folder, "writing_samples").select(F.lit("sample").alias("rec_kind"), F.col("sample_id").alias("rec_id"), file_column(F.col("source")).alias("origin"), "text")
    models = table(spark, folder, "eval_runs").groupBy("run_id").agg(F.max("model").alias("origin"))
    completions = table(spark, folder, "eval_completions").join(models, "run_id", "left").select(F.lit("completion").alias("rec_kind"), F.col("completion_id").alias("rec_id"), "origin", F.col("grpo_completion").alias("text"))
    return cut_records(samples.unionByName(completions))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder).filter("cut").select("rec_kind", "rec_id")


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    return _cut(spark, folder)


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    return cut_rates(_cut(spark, folder))


def p6_budget(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return token_budget(table(spark, folder, "blog_en"), table(spark, folder, "source_domains"), "blog_id", "text", "source", "language")


def p6_documents(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return document_tokens(table(spark, folder, "blog_en"), "blog_id", "text")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text")


def p7_offsets(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return encode_corpus(table(spark, folder, "documents"), "doc_id", "text", offsets=True)


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Texts after a round trip; a null text comes back empty."""
    return decode_corpus(p7_ids(spark, folder), "doc_id", "ids")


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return pack_texts(table(spark, folder, "documents"), "doc_id", "text")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: one row over all."""
    fill = container_fill(p8_packed(spark, folder))
    return fill.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), (F.count(F.lit(1)) * CAPACITY - F.coalesce(F.sum("used"), F.lit(0))).alias("room_left"), F.max("used").alias("fullest"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_restored(spark, folder).select("doc_id").distinct()


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return find_garbled(table(spark, folder, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
