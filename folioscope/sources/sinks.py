"""Sinks, gates and reports. What is rendered on the driver is of fixed size;
tables go out through Spark's writers."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import with_unfinished
from .readers import finished_keys


def save_splits(df: DataFrame, path: str, split: str = "part") -> None:
    """Parquet, one folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def append_unfinished(df: DataFrame, path: str, key: str) -> int:
    """Appends as JSON Lines the rows whose key is not there yet; returns how
    many. Safe to run again after a crash."""
    rows = with_unfinished(df, finished_keys(df.sparkSession, path, key), key)
    n = rows.count()
    if n:
        rows.write.mode("append").json(path)
    return n


def provenance(spark: SparkSession, git_hash: str | None = None) -> dict:
    """Run id, time and versions of a run."""
    now = datetime.now(UTC)
    return {"run_id": now.strftime("%Y%m%d-%H%M%S"), "timestamp": now.isoformat(), "git_hash": git_hash, "versions": {"spark": spark.version}}


def write_json(row: dict, path: str) -> str:
    """A report of bounded size on the driver's file system."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, ensure_ascii=False, indent=2, default=str)
    return path


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def manifest(counts: DataFrame, negative_sources: DataFrame, cells: DataFrame, text_hash: str) -> dict:
    """The corpus manifest from its small tables: classes per split, negatives
    per source, kept rows per stratum, and the hash."""
    return {
        "counts_per_class": {r["split"]: {"positive": r["positive"], "negative": r["negative"]} for r in counts.collect()},
        "negative_source_counts": {r[0]: r[1] for r in negative_sources.collect()},
        "surface_cell_counts": {str(tuple(r[:-1])): r[-1] for r in cells.collect()},
        "text_hash": text_hash,
    }


def verify_manifest(said: dict | None, text_hash: str) -> None:
    """Raises where the manifest is missing or the corpus has drifted."""
    if not said:
        raise RuntimeError("no manifest")
    if said.get("text_hash") != text_hash:
        raise RuntimeError("the corpus does not match its manifest")


def probe_gate(report_path: str, model_path: str | None = None, skip: bool = False) -> str:
    """``passed`` or ``skipped``; raises for a missing, failed or stale report."""
    if skip:
        return "skipped"
    if not os.path.exists(report_path):
        raise RuntimeError(f"no probe report at {report_path}")
    with open(report_path, encoding="utf-8") as f:
        report = json.load(f)
    if not report.get("passed", False):
        raise RuntimeError(f"the probe failed: {len(report.get('failures', []))} failures")
    if model_path and os.path.exists(model_path) and os.path.getmtime(report_path) < os.path.getmtime(model_path):
        raise RuntimeError("the probe report is older than the model")
    return "passed"


def accuracy_gate(accuracy: float, least: float = 0.8) -> None:
    if accuracy < least:
        raise RuntimeError(f"accuracy {accuracy:.4f} is below {least}")


def score_verdict(score: Column) -> Column:
    return F.when(score > 0.7, "strong").when(score > 0.5, "moderate").otherwise("weak")


def human_eval_form(sample: DataFrame) -> tuple[str, list[dict]]:
    """The form (markdown, no origins) and the answer key of a numbered sample."""
    rows = sample.orderBy("number").collect()
    form = "\n\n".join(f"## {r['number']}\n\n{r['text']}\n\nReal or generated? ____" for r in rows)
    return form, [{"number": r["number"], "origin": r["origin"]} for r in rows]


def metric_table(deltas: DataFrame) -> str:
    """Signed deltas of a few metrics, as text."""
    rows = deltas.orderBy("metric").collect()
    return "\n".join(f"{r['metric']:<24} {r['base']:.4f} {r['new']:.4f} {r['delta']:+.4f} {r['verdict']}" for r in rows)


def resolve_options(wanted: dict, accepted: set[str]) -> tuple[dict, dict]:
    """(passed, dropped) options, so that nothing is dropped unseen."""
    return {k: v for k, v in wanted.items() if k in accepted}, {k: v for k, v in wanted.items() if k not in accepted}
