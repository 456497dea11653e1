"""Pluggable scorers and tokenizers, and dataset builders around them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import control_prompt, seed_and_continuation
from ..functions.text import infer_language, shuffled_sentences, strip, word_count
from .corpus import label_union

STRATEGIES = ("shuffle", "prewritten", "rephrase", "random_corpus")
MIN_SEED_WORDS = 5


def scorer_column(load: Callable[[], object], text: Column, batch: int = 256) -> Column:
    """Column of ``load().predict(list of texts)``; the model is loaded once per
    worker and asked in batches. Null texts score null."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            known = texts[texts.notna()]
            scores = [s for i in range(0, len(known), batch) for s in model.predict(known.iloc[i : i + batch].tolist())]
            yield pd.Series(scores, index=known.index, dtype="float64").reindex(texts.index)

    return run(text)


def tokens_column(load: Callable[[], object], text: Column) -> Column:
    """Column of ``len(load().encode(text))``; null texts have 0."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load()
        for texts in batches:
            yield texts.map(lambda t: len(tokenizer.encode(t)) if t is not None else 0).astype("int32")

    return run(text)


def sft_pairs(df: DataFrame, text: str, min_completion_words: int = 5) -> DataFrame:
    """(prompt, completion) of positives with enough words on both sides."""
    rows = df.filter("label = 1").withColumn("__p", seed_and_continuation(F.col(text)))
    seed, rest = F.col("__p.seed"), F.col("__p.continuation")
    rows = rows.filter((word_count(seed) >= MIN_SEED_WORDS) & (word_count(rest) >= min_completion_words))
    return rows.select(control_prompt(seed, F.coalesce("style", F.lit("standard")), infer_language(strip(F.col(text)))).alias("prompt"), rest.alias("completion"))


def collate(prompt_ids: Column, completion_ids: Column, limit: int, pad_to: Column, pad: int = 0) -> Column:
    """Struct of ``input_ids``, ``attention_mask`` and ``labels``: both id lists
    joined and cut at ``limit``, the prompt masked with -100, right-padded."""
    ids = F.slice(F.concat(prompt_ids, completion_ids), F.lit(1), F.lit(limit))
    masked = F.slice(F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), completion_ids), F.lit(1), F.lit(limit))
    room = F.greatest(pad_to - F.size(ids), F.lit(0))
    fill = lambda xs, v: F.concat(xs, F.array_repeat(F.lit(v), room))
    return F.struct(fill(ids, pad).alias("input_ids"), fill(F.transform(ids, lambda _: F.lit(1)), 0).alias("attention_mask"), fill(masked, -100).alias("labels"))


def repeat_prompts(prompts: DataFrame, pos: str, each: int) -> DataFrame:
    """Every prompt ``each`` times in a row, with a new ``pos``."""
    rows = prompts.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    return rows.withColumn(pos, F.col(pos) * each + F.col("__k")).drop("__k")


def negatives(positives: DataFrame, text: str, strategy: str, per_positive: int = 1, prewritten: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Negative texts by strategy; prewritten ones come as they are, whatever
    ``per_positive`` says. Rephrasing asks a model and is out of scope."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "prewritten":
        if prewritten is None:
            raise ValueError("prewritten negatives are needed")
        return prewritten
    if strategy == "shuffle":
        rows = positives.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(per_positive - 1))))
        salted = F.concat(F.col("__i").cast("string"), F.lit("|"), F.col(text))
        return rows.withColumn(text, shuffled_sentences(F.col(text), seed)).withColumn("variant", F.md5(salted)).drop("__i")
    raise NotImplementedError(strategy)


def contrastive(positives: DataFrame, negative_rows: DataFrame, text: str) -> DataFrame:
    """Both classes with their labels; row order is a seeded hash of the text."""
    return label_union(positives, negative_rows, text)
