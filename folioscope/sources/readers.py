"""Readers: text, JSON Lines, run JSON, Parquet, configured sources.

Paths may be anything Spark reads; nothing is opened on the driver except the
configuration file. Every reader declares its schema.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip

MIN_LENGTH, MAX_LENGTH = 50, 2048
SAMPLE_SCHEMA = "text string, source string, source_type string, style string, label int, metadata map<string,string>, pos int"

BREAKDOWN = T.StructType([T.StructField(n, T.DoubleType()) for n in ("total", "raw_style_prob", "style_score", "length_bonus", "prompt_relevance", "repetition_penalty", "prompt_echo_penalty", "reference_copy_penalty")])
PER_PROMPT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("prompt", "base_completion", "grpo_completion")]
    + [T.StructField(n, T.DoubleType()) for n in ("base_style_score", "grpo_style_score")]
    + [T.StructField(n, BREAKDOWN) for n in ("base_reward_breakdown", "grpo_reward_breakdown")]
)
_METRICS = T.MapType(T.StringType(), T.DoubleType())
_RESULTS = [
    T.StructField("prompts", T.ArrayType(T.StringType())), T.StructField("base_metrics", _METRICS), T.StructField("grpo_metrics", _METRICS),
    T.StructField("base_completions", T.ArrayType(T.StringType())), T.StructField("grpo_completions", T.ArrayType(T.StringType())), T.StructField("per_prompt", T.ArrayType(PER_PROMPT)),
]
RUN_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("run_id", "timestamp", "git_hash", "model", "base_model")] + [T.StructField("prompt_count", T.IntegerType()), T.StructField("results", T.StructType(_RESULTS)), *_RESULTS]
)


@dataclass(frozen=True)
class SourceConfig:
    """One configured source; ``style`` tags its rows."""

    path: str
    kind: str = "directory"
    style: str = "standard"
    source_type: str = "unknown"
    text_field: str = "text"


@dataclass(frozen=True)
class CorpusConfig:
    """Typed settings of a corpus build; strings that hold numbers are read as
    numbers, unknown keys are kept apart so that nothing is dropped unseen."""

    sources: tuple[SourceConfig, ...] = ()
    min_length: int = MIN_LENGTH
    max_length: int | None = MAX_LENGTH
    bins: int = 8
    val_share: float = 0.15
    seed: int = 42
    match_form: bool = True
    unknown: dict = field(default_factory=dict)


def load_config(text: str) -> CorpusConfig:
    """From JSON, or YAML where a YAML library is installed."""
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml  # optional

        raw = yaml.safe_load(text)
    raw = dict(raw or {})
    sources = tuple(SourceConfig(**{k: v for k, v in s.items() if k in SourceConfig.__dataclass_fields__}) for s in raw.pop("sources", None) or ())
    casts: dict[str, Callable] = {"min_length": int, "max_length": lambda v: None if v is None else int(v), "bins": int, "val_share": float, "seed": int, "match_form": bool}
    known = {k: cast(raw.pop(k)) for k, cast in casts.items() if k in raw}
    return CorpusConfig(sources=sources, unknown=raw, **known)


def _in_band(text: Column, least: int, most: int | None) -> Column:
    size = F.length(text)
    return (size >= least) & (size <= most) if most is not None else size >= least


def _sample(text: Column, source: Column, source_type: str, style: str, metadata: Column, pos: Column) -> list[Column]:
    return [text.alias("text"), source.alias("source"), F.lit(source_type).alias("source_type"), F.lit(style).alias("style"), F.lit(1).alias("label"), metadata.alias("metadata"), pos.cast("int").alias("pos")]


def _no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def read_txt(spark: SparkSession, path: str | list[str], paragraphs: bool = True, least: int = MIN_LENGTH, most: int | None = MAX_LENGTH, style: str = "standard", source_type: str = "text", recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Samples from text files: paragraphs between blank lines (exactly two
    newlines), or whole files; stripped, without empty ones, within the length
    band (both ends inclusive). ``pos`` is the paragraph's place in its file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter=pattern).select("value", F.col("_metadata.file_path").alias("source"))
    parts = files.select("source", F.posexplode(F.split("value", "\n\n") if paragraphs else F.array("value")).alias("pos", "raw"))
    rows = parts.withColumn("t", strip(F.col("raw"))).filter((F.col("t") != "") & _in_band(F.col("t"), least, most))
    return rows.select(*_sample(F.col("t"), F.col("source"), source_type, style, _no_metadata(), F.col("pos")))


def read_jsonl(spark: SparkSession, path: str | list[str], text_field: str = "text", least: int = MIN_LENGTH, most: int | None = MAX_LENGTH, style: str = "standard", source_type: str = "message", recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """Samples from JSON Lines: blank lines skipped, a missing text field is an
    empty text, texts are not stripped, all other keys go to ``metadata`` as
    strings. A line that is no JSON object counts as empty."""
    lines = spark.read.text(path, recursiveFileLookup=recursive, pathGlobFilter=pattern).select("value", F.col("_metadata.file_path").alias("source")).filter(strip(F.col("value")) != "")
    parsed = lines.withColumn("m", F.coalesce(F.from_json("value", "map<string,string>"), _no_metadata()))
    text = F.coalesce(F.col("m")[text_field], F.lit(""))
    rows = parsed.withColumn("t", text).filter(_in_band(F.col("t"), least, most))
    return rows.select(*_sample(F.col("t"), F.col("source"), source_type, style, F.map_filter("m", lambda k, v: k != text_field), F.lit(0)))


def read_directory(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """All ``.txt`` and ``.jsonl`` files below ``path``; others are ignored."""
    text_options = {k: v for k, v in options.items() if k != "text_field"}
    jsonl_options = {k: v for k, v in options.items() if k != "paragraphs"}
    return read_txt(spark, path, recursive=True, pattern="*.txt", **text_options).unionByName(read_jsonl(spark, path, recursive=True, pattern="*.jsonl", **jsonl_options))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_sources(spark: SparkSession, config: CorpusConfig) -> tuple[DataFrame, list[str]]:
    """Samples of all configured sources, each with its style, and notices of
    those skipped (missing path, unknown kind)."""
    notices: list[str] = []
    out: DataFrame | None = None
    readers = {"txt": read_txt, "jsonl": read_jsonl, "directory": read_directory}
    for source in config.sources:
        if source.kind not in readers:
            notices.append(f"unknown kind {source.kind}: {source.path}")
            continue
        if not path_exists(spark, source.path):
            notices.append(f"missing: {source.path}")
            continue
        options = {"least": config.min_length, "most": config.max_length, "style": source.style, "source_type": source.source_type}
        if source.kind != "txt":
            options["text_field"] = source.text_field
        rows = readers[source.kind](spark, source.path, **options)
        out = rows if out is None else out.unionByName(rows)
    return (spark.createDataFrame([], SAMPLE_SCHEMA) if out is None else out), notices


def read_prewritten(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Negatives below ``path``: paragraphs of text files and the text of JSON
    Lines, stripped, without empty ones, no length band and no cleaning; beside
    them the count per parent folder relative to ``path`` ("." at the root)."""
    txt = read_txt(spark, path, least=1, most=None, recursive=True, pattern="*.txt")
    jsonl = read_jsonl(spark, path, least=0, most=None, recursive=True, pattern="*.jsonl").withColumn("text", strip(F.col("text"))).filter("text != ''")
    rows = txt.unionByName(jsonl)
    # what follows the given folder's own path, without the file name
    tail = F.regexp_extract("source", f"{_quoted(path)}/(?:(.*)/)?[^/]*$", 1)
    counts = rows.groupBy(F.when(tail != "", tail).otherwise(".").alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("label", F.lit(0)), counts


def _quoted(path: str) -> str:
    return "\\Q" + path.rstrip("/").split("://")[-1].removeprefix("file:") + "\\E"


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt): one per line, stripped, blanks dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("prompt")).filter("prompt != ''")


def read_probe_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, category string, lang string, text string").json(path)


def positive_controls(samples: DataFrame, pos: str, limit: int) -> DataFrame:
    """The first ``limit`` positives by ``pos`` as probe rows."""
    first = samples.filter("label = 1").orderBy(pos).limit(limit)
    numbered = first.withColumn("n", F.row_number().over(_by(pos)) - 1)  # at most `limit` rows
    return numbered.select(F.concat(F.lit("control_"), F.col("n").cast("string")).alias("id"), F.lit("control").alias("category"), F.lit("-").alias("lang"), "text")


def _by(pos: str):
    from pyspark.sql.window import Window

    return Window.orderBy(pos)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation runs from JSON files, results nested or flat, in one form."""
    raw = spark.read.schema(RUN_SCHEMA).option("multiLine", True).json(path)
    results = [f.name for f in _RESULTS]
    return raw.select(*(c for c in raw.columns if c != "results" and c not in results), *(F.coalesce(f"results.{c}", c).alias(c) for c in results))


def run_breakdowns(runs: DataFrame, label: str) -> DataFrame:
    """One row per prompt that has ``<label>_reward_breakdown``; ``check_rows``
    turns an empty result into an error."""
    rows = runs.select("run_id", F.posexplode("per_prompt").alias("pos", "p"))
    return rows.filter(F.col(f"p.{label}_reward_breakdown").isNotNull()).select("run_id", "pos", f"p.{label}_reward_breakdown.*")


def run_generations(runs: DataFrame, field_name: str) -> DataFrame:
    """(text): the stripped, non-blank completions of a list field."""
    if field_name not in runs.columns:
        raise ValueError(f"no field {field_name}; there are " + ", ".join(c for c in runs.columns if c.endswith("completions")))
    return runs.select(F.explode(field_name).alias("t")).select(strip(F.col("t")).alias("text")).filter("text != ''")


def check_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def finished_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key) already written below ``path``; empty before the first write."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{key} long")
    return spark.read.schema(f"{key} long").json(path).filter(F.col(key).isNotNull()).distinct()
