"""Reward scoring and within-group diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ngrams import content_tokens, ngrams
from ..functions.rewards import COMPONENTS, RewardConfig, weighted

DEAD_BELOW = 0.01


def reference_ngrams(df: DataFrame, text: str, n: int = 8, label: str | None = "label") -> DataFrame:
    """(gram): distinct content n-grams of the positive texts (all texts
    without a label column)."""
    if label is not None and label in df.columns:
        df = df.filter(F.col(label) == 1)
    return df.select(F.explode(ngrams(content_tokens(F.col(text)), n)).alias("gram")).distinct()


def reference_copy(df: DataFrame, key: str, text: str, reference: DataFrame, n: int = 8) -> DataFrame:
    """(key, reference_copy): part of each text's distinct n-grams that stand in
    the reference; 0 for texts without one. A sort-merge join on the n-gram by
    hint: sizes are guessed from the files, and a text's n-grams hold several
    times its bytes, so a reference taken for small would go through the driver."""
    grams = df.select(key, F.explode_outer(ngrams(content_tokens(F.col(text)), n)).alias("gram"))
    marked = grams.join(reference.withColumn("__hit", F.lit(1)).hint("merge"), "gram", "left")
    return marked.groupBy(key).agg(F.coalesce(F.try_divide(F.count("__hit"), F.count("gram")), F.lit(0.0)).alias("reference_copy"))


def score(df: DataFrame, key: str, text: str, prompt: str, prob: str, tokens: Column, reference: DataFrame | None = None, config: RewardConfig = RewardConfig()) -> DataFrame:
    """Adds the weighted components, ``raw_style_prob`` and ``total``. ``tokens``
    counts the policy tokenizer's tokens. A null prompt is no prompt, a null
    text an empty one; a null probability leaves the score null. The copies have
    a row for each row scored, so they too are joined without the driver."""
    if reference is not None and config.reference_weight:
        copies = reference_copy(df, key, text, reference, config.reference_ngram).withColumnRenamed(key, "__key")
        df = df.join(copies.hint("merge"), df[key] == F.col("__key"), "left").withColumn("__ref", F.coalesce("reference_copy", F.lit(0.0))).drop("__key", "reference_copy")
    else:
        df = df.withColumn("__ref", F.lit(0.0))
    tokenised = df.withColumns({"__seed": content_tokens(F.coalesce(prompt, F.lit(""))), "__text": content_tokens(F.coalesce(text, F.lit("")))})
    parts = weighted(F.col(prob), tokens, F.col("__seed"), F.col("__text"), F.col("__ref"), F.col(prompt).isNotNull(), config)
    return tokenised.withColumns(parts | {"raw_style_prob": F.col(prob)}).drop("__seed", "__text", "__ref")


def group_runs(df: DataFrame, partition: list[str], order: str, prompt: str, name: str = "group_no") -> DataFrame:
    """Numbers contiguous runs of equal prompts from 0 within ``partition``; the
    same prompt further on is another run. Null prompts are equal."""
    window = Window.partitionBy(*partition).orderBy(order)
    changed = F.when(F.lag(F.lit(1)).over(window).isNull() | ~F.col(prompt).eqNullSafe(F.lag(prompt).over(window)), 1).otherwise(0)
    flagged = df.withColumn("__new", changed)
    return flagged.withColumn(name, (F.sum("__new").over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("__new")


def group_chunks(df: DataFrame, pos: str, size: int, name: str = "group_no") -> DataFrame:
    """Fixed chunks of ``size`` by position (from 0), the tail kept."""
    return df.withColumn(name, F.floor(F.col(pos) / size).cast("int"))


def summarize_groups(df: DataFrame, keys: list[str], total: str = "total", components: list[str] = COMPONENTS) -> DataFrame:
    """Per group: size, mean, sample std (0 for one row), min, max, dead flag and
    the spread of each component."""
    spread = lambda c: F.coalesce(F.when(F.max(c) == F.min(c), F.lit(0.0)).otherwise(F.stddev_samp(c)), F.lit(0.0))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.avg(total).alias("mean"), spread(total).alias("std"), F.min(total).alias("min"), F.max(total).alias("max"), *(spread(c).alias(f"std_{c}") for c in components)
    )
    return out.withColumn("is_dead", F.col("std") < DEAD_BELOW)


def run_summary(groups: DataFrame, keys: list[str] | None = None, components: list[str] = COMPONENTS) -> DataFrame:
    """Per run (or over all): groups, spread of groups, dead share, mean
    component spread and which components never spread; without groups one
    row with 0."""
    aggregates = [
        F.count(F.lit(1)).alias("groups"), F.avg("std").alias("std_mean"), F.min("std").alias("std_min"), F.max("std").alias("std_max"), F.avg("mean").alias("reward_mean"),
        F.count_if("is_dead").alias("dead_groups"), F.coalesce(F.try_divide(F.count_if("is_dead"), F.count(F.lit(1))), F.lit(0.0)).alias("dead_fraction"),
        *(F.avg(f"std_{c}").alias(f"spread_{c}") for c in components),
        F.array_compact(F.array(*(F.when(F.coalesce(F.max(f"std_{c}"), F.lit(1.0)) == 0, F.lit(c)) for c in components))).alias("without_spread"),
    ]
    return groups.groupBy(*keys).agg(*aggregates) if keys else groups.agg(*aggregates)


def advantages(df: DataFrame, keys: list[str], total: str = "total") -> DataFrame:
    """Adds ``advantage``: (reward - group mean) / group std; 0 where the group
    does not spread."""
    window = Window.partitionBy(*keys)
    std = F.stddev_samp(total).over(window)
    flat = F.max(total).over(window) == F.min(total).over(window)
    return df.withColumn("advantage", F.when(flat | std.isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col(total) - F.avg(total).over(window), std)))


def render_summary(row: dict) -> str:
    """A readable report of one :func:`run_summary` row."""
    if not row["groups"]:
        return "no groups recorded"
    lines = [f"groups {row['groups']}, reward mean {row['reward_mean']:.4f}, std mean {row['std_mean']:.4f} (min {row['std_min']:.4f}, max {row['std_max']:.4f})", f"dead groups {row['dead_groups']} ({row['dead_fraction']:.1%})"]
    spreads = sorted(((v, k[7:]) for k, v in row.items() if k.startswith("spread_")), key=lambda x: (-(x[0] or 0), x[1]))
    lines += [f"  {name}: {value or 0:.4f}" for value, name in spreads]
    if row["dead_fraction"] > 0.5:
        lines.append("warning: more than half of the groups carry no signal")
    if row["without_spread"]:
        lines.append("without spread: " + ", ".join(row["without_spread"]))
    return "\n".join(lines)
