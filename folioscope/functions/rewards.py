"""Reward components of a completion; every component is one expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ngrams import copied_positions, ngrams, run_length, windows


@dataclass(frozen=True)
class RewardConfig:
    """Weights and limits; values out of range are brought into it as the
    scoring does."""

    temperature: float = 1.0
    style_weight: float = 0.65
    length_weight: float = 0.10
    relevance_weight: float = 0.20
    repetition_weight: float = 0.15
    echo_weight: float = 0.10
    reference_weight: float = 0.15
    target_length: int = 60
    reference_ngram: int = 8
    echo_ngram: int = 4
    echo_floor: float = 0.35
    exclusion_run: int = 2
    relevance_target: int = 8
    minimum: float = -1.0
    maximum: float = 1.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "reference_ngram", max(3, self.reference_ngram))
        object.__setattr__(self, "echo_ngram", max(2, self.echo_ngram))
        object.__setattr__(self, "exclusion_run", min(max(2, self.exclusion_run), self.echo_ngram))
        object.__setattr__(self, "relevance_target", max(1, self.relevance_target))


COMPONENTS = ["style_score", "length_bonus", "prompt_relevance", "repetition_penalty", "prompt_echo_penalty", "reference_copy_penalty"]


def temperature_scale(p: Column, temperature: float = 1.0) -> Column:
    # least and greatest pass over nulls: a null stays null here
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(1e-5)), F.lit(1 - 1e-5)))
    logit = F.ln(q / (1 - q))
    return 1 / (1 + F.exp(-logit / max(temperature, 1e-3)))


def length_bonus(tokens: Column, target: int = 60) -> Column:
    """1 at the target number of tokens, falling to 0 at none or twice as many."""
    return F.greatest(F.lit(0.0), 1 - F.abs(tokens - target) / F.lit(float(target)))


def prompt_relevance(seed: Column, text: Column, config: RewardConfig = RewardConfig()) -> Column:
    """Distinct seed tokens taken up outside copied runs, over the target, at most 1."""
    hits = copied_positions(text, seed, run_length(seed, config.exclusion_run))
    echoed = F.array_distinct(F.transform(hits, lambda i: F.get(text, i)))
    shared = F.array_except(F.array_intersect(seed, text), echoed)
    return F.least(F.lit(1.0), F.size(shared) / F.lit(float(config.relevance_target)))


def repetition_penalty(tokens: Column) -> Column:
    """Share of bigrams that repeat; 0 below four tokens."""
    pairs = F.size(windows(tokens, 2))
    return F.when(F.size(tokens) >= 4, (pairs - F.size(ngrams(tokens, 2))) / pairs).otherwise(F.lit(0.0))


def echo_penalty(seed: Column, text: Column, config: RewardConfig = RewardConfig()) -> Column:
    """Part of the seed copied in runs, beyond what is free."""
    copied = F.size(copied_positions(seed, text, run_length(seed, config.echo_ngram)))
    return F.when(F.size(seed) > 0, F.greatest(F.lit(0.0), copied / F.size(seed) - config.echo_floor)).otherwise(F.lit(0.0))


def weighted(prob: Column, tokens: Column, seed: Column, text: Column, reference: Column, has_prompt: Column, config: RewardConfig = RewardConfig()) -> dict[str, Column]:
    """Weighted components by name, and ``total``. Terms that need a prompt
    are 0 without one; a term of weight 0 is a literal 0."""
    zero = F.lit(0.0)

    def term(weight: float, value: Column) -> Column:
        return value * weight if weight else zero

    parts = {
        "style_score": term(config.style_weight, temperature_scale(prob, config.temperature)),
        "length_bonus": term(config.length_weight, length_bonus(tokens, config.target_length)),
        "prompt_relevance": F.when(has_prompt, term(config.relevance_weight, prompt_relevance(seed, text, config))).otherwise(zero),
        "repetition_penalty": term(config.repetition_weight, repetition_penalty(text)),
        "prompt_echo_penalty": F.when(has_prompt, term(config.echo_weight, echo_penalty(seed, text, config))).otherwise(zero),
        "reference_copy_penalty": term(config.reference_weight, reference),
    }
    total = parts["style_score"] + parts["length_bonus"] + parts["prompt_relevance"] - parts["repetition_penalty"] - parts["prompt_echo_penalty"] - parts["reference_copy_penalty"]
    bounded = F.greatest(F.lit(config.minimum), F.least(F.lit(config.maximum), total))
    return parts | {"total": F.when(total.isNotNull(), bounded)}
