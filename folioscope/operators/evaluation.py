"""Evaluation metrics, run comparison, correlations, probe and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ngrams import windows
from ..functions.text import word_count, word_list
from ..session import cut_lineage
from .ranking import average_rank, value_ranks, values_at

REDUNDANT, INDEPENDENT = 0.7, 0.3
OOD_ABOVE, CONTROL_LOW = 0.4, 0.5
# Metrics of which more is better.
HIGHER_IS_BETTER = ["style_score_mean", "style_score_min", "style_score_max", "distinct_1", "distinct_2", "avg_words"]


def _group(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def distinct_n(df: DataFrame, text: str, n: int, keys: list[str] | None = None) -> DataFrame:
    """``distinct_<n>``: distinct over all n-grams of lower-case words, within
    texts; 0 where there are none. Counts per n-gram are summed first, so one
    n-gram may be any share of all."""
    keys = keys or []
    grams = df.select(*keys, F.explode(windows(word_list(F.lower(F.col(text))), n)).alias("gram"))
    counts = grams.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("c"))
    found = _group(counts, keys, [(F.count(F.lit(1)) / F.sum("c")).alias(f"distinct_{n}")])
    if not keys:
        return found.select(F.coalesce(f"distinct_{n}", F.lit(0.0)).alias(f"distinct_{n}"))
    base = df.select(*keys).distinct()
    renamed = found.select(*(F.col(k).alias(f"__{k}") for k in keys), f"distinct_{n}")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return base.join(renamed, on, "left").select(*keys, F.coalesce(f"distinct_{n}", F.lit(0.0)).alias(f"distinct_{n}"))


def style_stats(df: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, population std, least and greatest score; nulls left out."""
    return _group(df, keys or [], [F.avg(score).alias("style_score_mean"), F.stddev_pop(score).alias("style_score_std"), F.min(score).alias("style_score_min"), F.max(score).alias("style_score_max")])


def length_stats(df: DataFrame, text: str, keys: list[str] | None = None) -> DataFrame:
    words = word_count(F.col(text))
    return _group(df, keys or [], [F.avg(words).alias("avg_words"), F.min(words).alias("min_words"), F.max(words).alias("max_words")])


def style_report(df: DataFrame, text: str, score: str | None = None, keys: list[str] | None = None, loss: str | None = None, tokens: str | None = None) -> DataFrame:
    """All style metrics of each group in one row: ``distinct_1``, ``distinct_2``,
    words, with ``score`` its statistics, with ``loss`` and ``tokens`` the
    perplexity. Without rows there is one row with distinct_1 = distinct_2 = 0
    and nulls (no row at all with ``keys``). Null texts have no words."""
    keys = keys or []
    parts = [distinct_n(df, text, 1, keys), distinct_n(df, text, 2, keys), length_stats(df, text, keys)]
    if score is not None:
        parts.append(style_stats(df, score, keys))
    if loss is not None and tokens is not None:
        parts.append(perplexity(df, loss, tokens, keys))
    out = parts[0]
    for part in parts[1:]:
        renamed = part.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in part.columns if c not in keys))
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        out = (out.join(renamed, on) if keys else out.join(F.broadcast(renamed))).drop(*(f"__k{i}" for i in range(len(keys))))  # one row each without keys
    return out


def judge_stats(df: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    """``judge_mean, judge_std`` (population) and ``n_judged`` of scores; groups
    without any score are left out."""
    return _group(df.filter(F.col(score).isNotNull()), keys or [], [F.avg(score).alias("judge_mean"), F.stddev_pop(score).alias("judge_std"), F.count(F.lit(1)).alias("n_judged")])


def perplexity(df: DataFrame, loss: str, tokens: str, keys: list[str] | None = None) -> DataFrame:
    """exp of the token-weighted mean loss; infinite without tokens."""
    mean = F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens))
    return _group(df, keys or [], [F.coalesce(F.exp(mean), F.lit(float("inf"))).alias("perplexity")])


def length_report(df: DataFrame, language: str, words: str, tokens: str, budget: int) -> DataFrame:
    """Per language: texts, mean tokens per word (texts with words), medians,
    90th value, longest, and the share above the budget."""
    stats = df.groupBy(language).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(words) > 0, F.col(tokens) / F.col(words))).alias("tokens_per_word"), F.max(tokens).alias("max_tokens"), (F.count_if(F.col(tokens) > budget) / F.count(F.lit(1))).alias("over_budget")
    )
    # both measures are ranked together
    long = df.select(language, F.explode(F.array(F.struct(F.lit("w").alias("k"), F.col(words).cast("long").alias("v")), F.struct(F.lit("t").alias("k"), F.col(tokens).cast("long").alias("v")))).alias("m")).select(language, "m.*")
    picked = values_at(long, "v", {"median": 0.5, "p90": 0.9}, [language, "k"])
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    wide = picked.groupBy(F.col(language).alias("__language")).agg(pick("w", "median").cast(dict(df.dtypes)[words]).alias("median_words"), pick("t", "median").alias("median_tokens"), pick("t", "p90").alias("p90_tokens"))
    return stats.join(wide, F.col(language).eqNullSafe(F.col("__language")), "left").drop("__language")


def unpivot(df: DataFrame, keys: list[str], metrics: str) -> DataFrame:
    """(keys, metric, value) of a map column; missing and null values left out."""
    return df.select(*keys, F.explode(metrics).alias("metric", "value")).filter("value is not null")


def metric_deltas(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics that both sides have: base, new, delta and its verdict."""
    joined = base.withColumnRenamed("value", "base").join(new.withColumnRenamed("value", "new"), [*keys, "metric"])
    delta = F.col("new") - F.col("base")
    return joined.withColumn("delta", delta).withColumn("verdict", delta_verdict(F.col("metric"), delta))


def run_metric_diff(a: DataFrame, b: DataFrame, keys: list[str], base: str, new: str) -> DataFrame:
    """``keys, metric, base_a, new_a, base_b, new_b, delta, verdict``: runs of two
    sides compared by ``keys``. The metrics are the union of both sides' ``new``
    maps; those without a value on both sides drop out. The ``base`` values are
    looked up and may be null. Several runs of one key are not told apart: name
    one per key."""
    sides = []
    for run, side in ((a, "a"), (b, "b")):
        metric = F.explode(F.map_keys(F.coalesce(F.col(new), F.create_map().cast("map<string,double>")))).alias("metric")
        sides.append(run.select(*keys, base, new, metric).select(*keys, "metric", F.try_element_at(base, F.col("metric")).alias(f"base_{side}"), F.try_element_at(new, F.col("metric")).alias(f"new_{side}")))
    union = sides[0].join(sides[1], [*keys, "metric"], "full").filter("new_a is not null and new_b is not null")
    delta = F.col("new_b") - F.col("new_a")
    return union.select(*keys, "metric", "base_a", "new_a", "base_b", "new_b", delta.alias("delta")).withColumn("verdict", delta_verdict(F.col("metric"), F.col("delta")))


def ranked_models(df: DataFrame, score: str, positive: str, model: str) -> DataFrame:
    """``model, auc, place``: models by AUC, the best first; equal ones by name.
    Models without both classes come last, with a null AUC."""
    aucs = roc_auc(df, score, positive, [model])
    # one row per model
    return aucs.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("auc", 12)), model)))


def metrics_report(row: dict) -> str:
    """A readable report of one :func:`binary_metrics` row, with ``auc`` where it
    is there."""
    names = [("accuracy", "Accuracy"), ("precision", "Precision"), ("recall", "Recall"), ("f1", "F1"), ("auc", "AUC")]
    return "\n".join([f"texts {row['n']}", *(f"{label:<10} {row[name]:.4f}" for name, label in names if row.get(name) is not None)])


def delta_verdict(metric: Column, delta: Column) -> Column:
    better = F.when(metric.isin(HIGHER_IS_BETTER), delta > 0).otherwise(delta < 0)
    return F.when(F.abs(delta) < 1e-6, "same").when(better, "better").otherwise("worse")


def last_per_prompt(df: DataFrame, prompt: str, pos: str, keep: list[str]) -> DataFrame:
    """One row per prompt: the last by position."""
    return df.groupBy(prompt).agg(F.max_by(F.struct(*keep), pos).alias("r")).select(prompt, "r.*")


def compare_prompts(a: DataFrame, b: DataFrame, prompt: str, pos: str, score: str) -> DataFrame:
    """``prompt, a, b, delta`` of prompts that both runs scored."""
    left = last_per_prompt(a, prompt, pos, [score]).withColumnRenamed(score, "a")
    right = last_per_prompt(b, prompt, pos, [score]).withColumnRenamed(score, "b")
    return left.join(right, prompt).filter("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))


def top_regressions(compared: DataFrame, prompt: str, n: int) -> DataFrame:
    return compared.filter("delta < 0").orderBy("delta", prompt).limit(n)


def change_counts(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count_if(F.col("delta") > 0).alias("improved"), F.count_if(F.col("delta") < 0).alias("regressed"), F.count_if(F.col("delta") == 0).alias("unchanged"))


def correlate(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: means, population stds, how often both are active, Pearson and
    Spearman, and the verdict. Below three rows the verdict is ``none``; a side
    without spread makes it ``flat``, with null correlations. Rows with a null
    on either side are left out."""
    return correlations(df, [(x, y)]).drop("x", "y")


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``x, y`` and what :func:`correlate` gives of each pair of columns, in one
    pass over the rows: they are counted by pair and values, and all that
    follows works on the counts. A pair without rows has a row with ``n`` 0."""
    one = lambda i, x, y: F.struct(F.lit(i).alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    long = df.select(F.explode(F.array(*(one(i, x, y) for i, (x, y) in enumerate(pairs)))).alias("r")).select("r.*").filter("x is not null and y is not null")
    counts = cut_lineage(long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    ranked = average_rank(average_rank(counts, "x", ["pair"], "rx", "w"), "y", ["pair"], "ry", "w")
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"mean_{c}")
    means = F.broadcast(ranked.groupBy("pair").agg(*(mean(c) for c in ("x", "y", "rx", "ry"))))  # one row per pair
    centred = ranked.join(means, "pair").withColumns({f"d_{c}": F.col(c) - F.col(f"mean_{c}") for c in ("x", "y", "rx", "ry")})
    moment = lambda a, b: F.sum(F.col(f"d_{a}") * F.col(f"d_{b}") * F.col("w")) / F.sum("w")
    flat = lambda c: F.max(c) == F.min(c)
    pearson = lambda a, b: F.when(flat("x") | flat("y"), F.lit(None)).otherwise(F.try_divide(moment(a, b), F.sqrt(moment(a, a)) * F.sqrt(moment(b, b))))
    times = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("w"))), F.lit(0))
    both, either = times((F.col("x") > 0) & (F.col("y") > 0)), times((F.col("x") > 0) | (F.col("y") > 0))
    stats = centred.groupBy("pair").agg(
        F.sum("w").alias("n"), F.first("mean_x").alias("mean_x"), F.first("mean_y").alias("mean_y"), F.sqrt(moment("x", "x")).alias("std_x"), F.sqrt(moment("y", "y")).alias("std_y"), both.alias("both_active"),
        F.coalesce(F.try_divide(both, either), F.lit(0.0)).alias("co_activation"), pearson("x", "y").alias("pearson"), pearson("rx", "ry").alias("spearman"), (flat("x") | flat("y")).alias("__flat"),
    )
    strongest = F.greatest(F.abs("pearson"), F.abs("spearman"))
    verdict = F.when(F.col("n") < 3, "none").when(F.col("__flat"), "flat").when(strongest >= REDUNDANT, "redundant").when(strongest <= INDEPENDENT, "independent").otherwise("entangled")
    names = df.sparkSession.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], "pair int, x string, y string")
    out = F.broadcast(names).join(stats, "pair", "left").fillna(0, ["n", "both_active"]).fillna(0.0, ["co_activation"])
    return out.withColumn("verdict", verdict).drop("pair", "__flat")


def probe_summary(df: DataFrame, category: str, score: str, control: str = "control") -> DataFrame:
    """Failures (scores strictly above the threshold) and margins of the probe."""
    is_control = F.coalesce(F.col(category) == control, F.lit(False))
    ood = F.when(~is_control, F.col(score))
    out = df.agg(F.count_if(ood > OOD_ABOVE).alias("failures"), F.max(ood).alias("max_ood"), F.avg(ood).alias("mean_ood"), F.avg(F.when(is_control, F.col(score))).alias("mean_control"))
    return out.withColumn("margin", F.col("mean_control") - F.col("mean_ood")).withColumn("passed", F.col("failures") == 0)


def probe_rows(df: DataFrame, category: str, score: str, control: str = "control") -> DataFrame:
    """Adds the verdict of each probe text: ``fail``, ``low`` (a control below
    its floor) or ``ok``."""
    is_control = F.coalesce(F.col(category) == control, F.lit(False))
    return df.withColumn("verdict", F.when(~is_control & (F.col(score) > OOD_ABOVE), "fail").when(is_control & (F.col(score) < CONTROL_LOW), "low").otherwise("ok"))


def roc_auc(df: DataFrame, score: str, positive: str, keys: list[str] | None = None) -> DataFrame:
    """``auc`` by rank sum, ties sharing ranks; null with one class only."""
    keys = keys or []
    rows = df.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(*keys, F.col(score).alias("__score"), F.col(positive).alias("__positive"))
    ranks = value_ranks(rows, "__score", keys, sums={"__p": F.count_if("__positive")})
    p, total = F.sum("__p"), F.sum("n")
    auc = F.try_divide(F.sum(F.col("avg_rank") * F.col("__p")) - p * (p + 1) / 2, p * (total - p))
    return _group(ranks, keys, [auc.alias("auc")])


def binary_metrics(df: DataFrame, prob: str, label: str, threshold: float = 0.5, keys: list[str] | None = None) -> DataFrame:
    """n, accuracy, precision, recall and F1; 0 where a ratio has no cases."""
    said, true = F.col(prob) > threshold, F.col(label) == 1
    tp, fp, fn = F.count_if(said & true), F.count_if(said & ~true), F.count_if(~said & true)
    n = F.count(F.lit(1))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = df.filter(F.col(prob).isNotNull() & F.col(label).isNotNull())
    return _group(rows, keys or [], [n.alias("n"), ratio(F.count_if(said == true), n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1")])


def feature_stats(df: DataFrame, vector: str) -> DataFrame:
    """``dim, mean, std`` (sample, at least 1e-6) of each dimension, from 0."""
    long = df.select(F.posexplode(vector).alias("dim", "value")).filter("value is not null")
    return long.groupBy("dim").agg(F.avg("value").alias("mean"), F.greatest(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), F.lit(1e-6)).alias("std"))


def standardize(df: DataFrame, vector: str, stats: DataFrame, name: str) -> DataFrame:
    """Adds (x - mean) / std per dimension. The statistics are one row per
    dimension of the vector, whatever the number of rows."""
    row = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("__stats"))
    scaled = F.zip_with(F.col(vector), F.col("__stats"), lambda x, s: (x.cast("double") - s["mean"]) / s["std"])
    return df.join(F.broadcast(row)).withColumn(name, scaled).drop("__stats")


def mean_pool(states: Column, mask: Column, dims: int) -> Column:
    """Mean of the token states whose mask is set; zeros where none is."""
    chosen = F.transform(F.filter(F.arrays_zip(states.alias("s"), mask.alias("m")), lambda z: z["m"] > 0), lambda z: z["s"])
    count = F.greatest(F.size(chosen).cast("double"), F.lit(1e-9))
    zero = F.array_repeat(F.lit(0.0), dims)
    total = F.aggregate(chosen, zero, lambda acc, s: F.zip_with(acc, s, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda v: v / count)


def mean_pool_rows(df: DataFrame, vector: str, order: str, keys: list[str], chunk: int = 256) -> DataFrame:
    """``keys, dim, value``: :func:`mean_pool` of each dimension over the vectors
    of all rows of ``keys``, with missing values masked. Pooled in chunks of
    ``order``, so that no key has to fit into one row, and weighted by what each
    chunk's mask sets."""
    long = df.select(*keys, F.floor(F.col(order) / chunk).alias("__chunk"), F.posexplode(vector).alias("dim", "__x")).withColumn("__m", F.col("__x").isNotNull().cast("int"))
    row = F.collect_list(F.struct(F.array(F.coalesce(F.col("__x").cast("double"), F.lit(0.0))).alias("s"), F.col("__m").alias("m")))
    chunks = long.groupBy(*keys, "dim", "__chunk").agg(row.alias("__rows"), F.sum("__m").alias("__n"))
    pooled = chunks.withColumn("__mean", mean_pool(F.col("__rows.s"), F.col("__rows.m"), 1)[0])
    return pooled.groupBy(*keys, "dim").agg(F.coalesce(F.try_divide(F.sum(F.col("__mean") * F.col("__n")), F.sum("__n")), F.lit(0.0)).alias("value"))


def linear_head(features: Column, weights: list[float], bias: float, gamma: list[float] | None = None, beta: list[float] | None = None, eps: float = 1e-5) -> Column:
    """Layer norm, linear layer and sigmoid on a standardised vector."""
    n = len(weights)
    mean = F.aggregate(features, F.lit(0.0), lambda a, x: a + x) / n
    variance = F.aggregate(features, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    scale = F.array(*(F.lit(w * (gamma[i] if gamma else 1.0)) for i, w in enumerate(weights)))
    shift = bias + sum(w * b for w, b in zip(weights, beta or [0.0] * n, strict=True))
    normed = F.transform(features, lambda x: (x - mean) / F.sqrt(variance + eps))
    z = F.aggregate(F.zip_with(normed, scale, lambda a, b: a * b), F.lit(float(shift)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-z))


def cv_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and population std of each metric over the folds."""
    return folds.agg(*(f(c).alias(f"{c}_{n}") for c in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))
