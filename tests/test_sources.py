"""Readers, sinks, gates and the streaming extension on small files."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.operators.scoring import run_summary
from folioscope.sources import readers, sinks
from folioscope.streaming.reward_log import reward_log_summary, start_reward_log, windowed_counts


def test_txt_and_jsonl(spark, tmp_path):
    long, short = "p" * 60, "q" * 49
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text(f"  {long}  \n\n{short}\n\n\n\n{'r' * 50}\n\n" + "s" * 2049)
    (tmp_path / "sub" / "b.jsonl").write_text(json.dumps({"text": " " + long, "ts": 3, "who": {"n": 1}}) + "\n\n" + json.dumps({"body": "x"}) + "\nnot json\n")
    (tmp_path / "c.md").write_text(long * 2)
    txt = readers.read_txt(spark, str(tmp_path / "a.txt")).collect()
    assert sorted(r.text for r in txt) == [long, "r" * 50] and txt[0].label == 1
    assert readers.read_txt(spark, str(tmp_path / "a.txt"), paragraphs=False, most=None).count() == 1
    both = readers.read_directory(spark, str(tmp_path), style="poetic").collect()
    assert len(both) == 3 and {r.style for r in both} == {"poetic"}
    row = next(r for r in both if r.text.startswith(" "))
    assert row.metadata["ts"] == "3" and "text" not in row.metadata
    rows, counts = readers.read_prewritten(spark, str(tmp_path))
    assert {r.folder: r.n for r in counts.collect()} == {".": 4, "sub": 1} and rows.filter("label != 0").count() == 0


def test_configured_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 60)
    raw = {"sources": [{"path": str(tmp_path / "a.txt"), "kind": "txt", "style": "poetic", "extra": 1}, {"path": str(tmp_path / "none"), "kind": "txt"}, {"path": "x", "kind": "csv"}], "val_share": "2e-1", "min_length": "10", "other": 5}
    config = readers.load_config(json.dumps(raw))
    assert config.val_share == 0.2 and config.min_length == 10 and config.unknown == {"other": 5}
    rows, notices = readers.read_sources(spark, config)
    assert [(r.text, r.style) for r in rows.collect()] == [("x" * 60, "poetic")] and len(notices) == 2
    assert readers.read_sources(spark, readers.CorpusConfig())[0].count() == 0


def test_runs(spark, tmp_path):
    per_prompt = [{"prompt": "p", "grpo_completion": "c", "grpo_reward_breakdown": {"total": 0.5, "style_score": 0.4}}, {"prompt": "q"}]
    results = {"grpo_metrics": {"distinct_1": 0.5}, "per_prompt": per_prompt, "grpo_completions": [" a ", " ", "b"]}
    (tmp_path / "nested.json").write_text(json.dumps({"run_id": "n", "model": "m", "results": results}, indent=1))
    (tmp_path / "flat.json").write_text(json.dumps({"run_id": "f"} | results))
    runs = readers.read_run(spark, str(tmp_path))
    assert {r.run_id: r.grpo_metrics for r in runs.collect()} == {"n": {"distinct_1": 0.5}, "f": {"distinct_1": 0.5}}
    assert readers.run_breakdowns(runs, "grpo").count() == 2 and readers.run_breakdowns(runs, "base").count() == 0
    with pytest.raises(ValueError):
        readers.check_rows(readers.run_breakdowns(runs, "base"), "breakdowns")
    assert sorted(r.text for r in readers.run_generations(runs, "grpo_completions").collect()) == ["a", "a", "b", "b"]
    with pytest.raises(ValueError, match="grpo_completions"):
        readers.run_generations(runs, "nothing")


def test_small_readers(spark, tmp_path):
    (tmp_path / "prompts.txt").write_text(" one \n\n  \ntwo\n")
    assert sorted(r.prompt for r in readers.read_prompts(spark, str(tmp_path / "prompts.txt")).collect()) == ["one", "two"]
    (tmp_path / "probe.jsonl").write_text('{"id": "a", "category": "news", "lang": "es", "text": "t"}\n')
    assert readers.read_probe_texts(spark, str(tmp_path / "probe.jsonl")).count() == 1
    samples = spark.createDataFrame([(1, "a", 1), (2, "b", 0), (3, "c", 1), (4, "d", 1)], "pos int, text string, label int")
    assert [(r.id, r.text) for r in readers.positive_controls(samples, "pos", 2).collect()] == [("control_0", "a"), ("control_1", "c")]


def test_sinks_and_gates(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "val")], "i long, t string, part string")
    sinks.save_splits(df, str(tmp_path / "splits"))
    assert spark.read.parquet(str(tmp_path / "splits")).count() == 2
    out = str(tmp_path / "done")
    assert [sinks.append_unfinished(df, out, "i"), sinks.append_unfinished(df.unionByName(df.withColumn("i", F.col("i") + 5)), out, "i")] == [2, 2]
    assert spark.read.json(out).count() == 4
    report = tmp_path / "probe.json"
    with pytest.raises(RuntimeError, match="no probe"):
        sinks.probe_gate(str(report))
    assert sinks.probe_gate(str(report), skip=True) == "skipped"
    sinks.write_json({"passed": False, "failures": [1]}, str(report))
    with pytest.raises(RuntimeError, match="1 failures"):
        sinks.probe_gate(str(report))
    sinks.write_json({"passed": True}, str(report))
    assert sinks.probe_gate(str(report)) == "passed"
    model = tmp_path / "model"
    model.write_text("x")
    os.utime(report, (1, 1))
    with pytest.raises(RuntimeError, match="older"):
        sinks.probe_gate(str(report), str(model))
    with pytest.raises(RuntimeError):
        sinks.accuracy_gate(0.79)
    with pytest.raises(RuntimeError):
        sinks.verify_manifest({"text_hash": "a"}, "b")
    sinks.verify_manifest({"text_hash": "a"}, "a")
    assert sinks.provenance(spark)["versions"]["spark"] == spark.version
    assert sinks.resolve_options({"a": 1, "b": 2}, {"a"}) == ({"a": 1}, {"b": 2})
    form, key = sinks.human_eval_form(spark.createDataFrame([(2, "y", "real"), (1, "x", "generated")], "number int, text string, origin string"))
    assert form.index("x") < form.index("y") and "real\n" not in form and key[0] == {"number": 1, "origin": "generated"}
    counts = spark.createDataFrame([("train", 2, 1)], "split string, positive long, negative long")
    made = sinks.manifest(counts, spark.createDataFrame([("poetry", 3)], "s string, n long"), spark.createDataFrame([(0, "en", True, 4)], "b int, l string, v boolean, k long"), "h")
    assert made["surface_cell_counts"] == {"(0, 'en', True)": 4} and made["counts_per_class"]["train"]["negative"] == 1


def test_reward_log(spark, tmp_path):
    rows = [("r", i // 2, float(i % 2), 0.5) for i in range(8)]
    source = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "run string, group_no int, total double, style_score double")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    start_reward_log(stream, ["run", "group_no"], str(tmp_path / "sink"), str(tmp_path / "cp"), ["style_score"]).awaitTermination(60)
    groups = spark.read.parquet(str(tmp_path / "sink"))
    got = reward_log_summary(groups, ["style_score"]).collect()[0]
    assert got.groups == 4 and got.without_spread == ["style_score"]
    assert run_summary(groups, components=["style_score"]).collect()[0] == got


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a"), ("2024-01-01 00:55:00", "a"), ("2024-01-01 01:05:00", "b"), (None, "a"), ("2024-01-09 00:00:00", "z")]
    df = spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("ts"), "k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", "k")
    stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    got = {(str(r.start), r.k): r.n for r in spark.sql("select window.start as start, k, n from windowed").collect()}
    assert got == {("2024-01-01 00:00:00", "a"): 2, ("2024-01-01 01:00:00", "b"): 1, ("2024-01-09 00:00:00", "z"): 1}


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) >= 60"
    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"bin", "language", "verse", "kept"}
