"""Corpus, scoring and evaluation operators: invariants and exact cases."""

import hashlib
import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.functions import payloads
from folioscope.functions.rewards import COMPONENTS
from folioscope.operators import corpus, evaluation, hooks, models, scoring
from folioscope.operators.ranking import average_rank, hash_rank, seeded_hash, values_at
from folioscope.plans.catalog import QUERIES
from folioscope.session import even_rank, latest


def labelled(spark, seed=1, n=300):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["word"] * rnd.randint(1, 60)) if rnd.random() < 0.6 else "\n".join(["the line"] * rnd.randint(1, 6)), int(rnd.random() < 0.3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "i int, text string, label int").repartition(5)


def test_hash_rank_is_one_window(spark):
    df = spark.createDataFrame([(i, "hot" if i % 5 else None) for i in range(500)], "i int, g string")
    got = {r.i: r.r for r in hash_rank(df, ["g"], seeded_hash(3, "i"), "i", "r").collect()}
    for g in ("hot", None):
        ids = sorted((i for i in range(500) if (i % 5 == 0) == (g is None)), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))
    ranks = even_rank(df, "g", ["i"], "e").collect()
    assert sorted(r.e for r in ranks if r.g is None) == list(range(100)) and sorted(r.e for r in ranks if r.g) == list(range(400))


def test_process_keeps_first(spark):
    rows = [(3, "Same  text", "c"), (1, "Same text", "a"), (2, "", "b"), (4, None, "d"), (5, "same text", "e"), (1, "Same text", "a")]
    got = corpus.process(spark.createDataFrame(rows, "i int, text string, __md5x string"), "text", "i")
    assert got.columns[-1] == "text" and sorted((r.i, r.text) for r in got.collect()) == [(1, "Same text"), (5, "same text")]
    again = corpus.process(got, "text", "i")
    assert sorted(again.collect()) == sorted(got.collect())
    assert corpus.process(got.limit(0), "text", "i").count() == 0


def test_balance(spark):
    rows, df = labelled(spark)
    words = sorted(len(t.split()) for _, t, _ in rows)
    want = {words[len(words) * i // 8] for i in range(1, 8)}
    assert {r.edge for r in corpus.bin_edges(df.select(F.size(F.split("text", r"\s+")).alias("w")), "w").collect()} == want
    assert corpus.bin_edges(df.limit(0).select(F.lit(1).alias("w")), "w").count() == 0
    kept = corpus.length_matched(df, "text", "label", "i").collect()
    counts = Counter((r.bin, r.language, r.verse, r.label) for r in kept)
    assert all(counts[(*k[:3], 0)] == counts[(*k[:3], 1)] for k in counts)
    cells = {tuple(r[:3]): r.kept for r in corpus.surface_cells(df, "text", "label").collect()}
    assert sum(cells.values()) * 2 == len(kept) and all(counts[(*k, 1)] == v for k, v in cells.items())
    assert sorted(corpus.length_matched(df.repartition(2), "text", "label", "i").collect()) == sorted(kept)
    other = corpus.length_matched(df, "text", "label", "i", seed=7).collect()
    assert len(other) == len(kept) and {r.i for r in other} != {r.i for r in kept}
    one_class = df.withColumn("label", F.lit(1))
    assert corpus.length_matched(one_class, "text", "label", "i").count() == 0


def test_undersample_split_folds(spark):
    df = spark.createDataFrame([(i, int(i < 30)) for i in range(40)], "i int, label int")
    assert Counter(r.label for r in corpus.undersample(df, "label", "i").collect()) == {0: 10, 1: 10}
    recorded = spark.createDataFrame([(i, i % 2) for i in range(506)], "i int, label int")
    parts = Counter((r.label, r.part) for r in corpus.stratified_split(recorded, "label", "i").collect())
    assert parts == {(0, "train"): 215, (1, "train"): 215, (0, "val"): 38, (1, "val"): 38}
    folds = Counter((r.label, r.fold) for r in corpus.kfold(df, "label", "i").collect())
    assert max(folds.values()) - min(v for (y, _), v in folds.items() if y == 1) <= 6 and {f for _, f in folds} == set(range(5))
    assert corpus.sample_by_hash(df, "i", 7).count() == 7


def test_hash_and_drift(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "x"), (2, "x")], "k int, text string")
    got = {r.k: r.text_hash for r in corpus.corpus_hash(df, "text", ["k"]).collect()}
    assert got == {1: hashlib.sha256(b"a\nb").hexdigest(), 2: hashlib.sha256(b"x\nx").hexdigest()}
    assert corpus.corpus_hash(df.limit(0), "text").collect()[0].text_hash == hashlib.sha256(b"").hexdigest()
    said = spark.createDataFrame([(1, got[1]), (2, "other"), (3, "gone")], "k int, text_hash string")
    assert {r.k for r in corpus.drifted(corpus.corpus_hash(df, "text", ["k"]), said, "k").collect()} == {2, 3}
    prints = [corpus.corpus_fingerprint(d, "text").collect()[0] for d in (df, df.repartition(4), df.filter("k = 1"), df.limit(0))]
    assert prints[0] == prints[1] != prints[2] and prints[3].n_texts == 0


def test_joins_and_guards(spark):
    a = spark.createDataFrame([(1, "the dog and you"), (2, "la casa de el"), (None, "x")], "k int, text string")
    assert {r.k for r in corpus.with_unfinished(a, spark.createDataFrame([(1,), (1,)], "k int"), "k").collect()} == {2, None}
    kept = corpus.keep_same_language(a.withColumn("c", F.lit("the dog and you")), a, "k", F.col("c"), F.col("text"))
    assert [r.k for r in kept.collect()] == [1]
    late = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None), (None, "d", 1)], "k int, v string, at int")
    assert sorted(((r.k or 0), r.v) for r in latest(late, "k", "at", ["k", "v"]).collect()) == [(0, "d"), (1, "b"), (2, "c")]


def test_groups(spark):
    prompts = list("aaabba")
    df = spark.createDataFrame([("r", i, p, float(i % 2), 0.5) for i, p in enumerate(prompts)], "run string, pos int, prompt string, total double, style_score double")
    runs = scoring.group_runs(df, ["run"], "pos", "prompt")
    assert [r.group_no for r in runs.orderBy("pos").collect()] == [0, 0, 0, 1, 1, 2]
    assert [r.group_no for r in scoring.group_chunks(df, "pos", 4).orderBy("pos").collect()] == [0, 0, 0, 0, 1, 1]
    groups = scoring.summarize_groups(runs, ["group_no"], components=["style_score"])
    by = {r.group_no: r for r in groups.collect()}
    assert math.isclose(by[0].std, statistics.stdev([0, 1, 0])) and by[2].std == 0.0 and by[2].is_dead and by[0].std_style_score == 0.0
    summary = scoring.run_summary(groups, components=["style_score"]).collect()[0]
    assert (summary.groups, summary.dead_groups, summary.without_spread) == (3, 1, ["style_score"])
    assert "without spread" in scoring.render_summary(summary.asDict())
    empty = scoring.run_summary(groups.limit(0), components=["style_score"]).collect()[0]
    assert empty.groups == 0 and empty.dead_fraction == 0.0 and scoring.render_summary(empty.asDict()) == "no groups recorded"
    advantage = {r.pos: r.advantage for r in scoring.advantages(runs, ["group_no"]).collect()}
    assert advantage[5] == 0.0 and math.isclose(sum(advantage[i] for i in range(3)), 0, abs_tol=1e-9)


def test_score_order(spark):
    seed = "the quiet lighthouse keeper counts every passing ship tonight"
    good = "a lighthouse needs keeper hands because ship lamps burn until morning comes slowly over water"
    bad = "ship ship ship ship ship ship ship ship ship ship ship ship"
    df = spark.createDataFrame([(1, seed, good, 0.9), (2, seed, bad, 0.9), (3, seed, seed, 0.9), (4, None, good, 0.9), (5, seed, None, None)], "k int, p string, t string, prob double")
    reference = scoring.reference_ngrams(spark.createDataFrame([(good, 1), (bad, 0)], "x string, label int"), "x")
    got = {r.k: r for r in scoring.score(df, "k", "t", "p", "prob", F.length("t") / 4, reference).collect()}
    assert got[1].prompt_relevance > got[3].prompt_relevance == 0.0 and got[2].repetition_penalty > got[1].repetition_penalty
    assert got[3].prompt_echo_penalty > 0 and got[4].prompt_relevance == 0.0 and got[1].reference_copy_penalty == 0.15 and got[5].total is None
    plain = {r.k: r for r in scoring.score(df, "k", "t", "p", "prob", F.length("t") / 4).collect()}
    assert plain[1].total > got[1].total


def test_metrics(spark):
    texts = lambda *xs: spark.createDataFrame([(x,) for x in xs], "t string")
    assert evaluation.distinct_n(texts("a a a a"), "t", 1).collect()[0][0] == 0.25
    assert evaluation.distinct_n(texts("x y z", "X y z"), "t", 2).collect()[0][0] == 0.5
    assert evaluation.distinct_n(texts("one", None, ""), "t", 2).collect()[0][0] == 0.0
    rows = spark.createDataFrame([(1.0, 2), (3.0, 6)], "l double, n int")
    assert math.isclose(evaluation.perplexity(rows, "l", "n").collect()[0][0], math.exp(2.5))
    assert evaluation.perplexity(rows.limit(0), "l", "n").collect()[0][0] == math.inf
    values = spark.createDataFrame([(v,) for v in range(1, 11)], "v int")
    assert tuple(values_at(values, "v", {"p90": 0.9, "med": 0.5}).collect()[0]) == (10, 6)
    ties = spark.createDataFrame([(v,) for v in (5, 1, 5, 3, None)], "v int")
    assert {(r.v, r.k) for r in average_rank(ties, "v", [], "k").collect()} == {(1, 1.0), (3, 2.0), (5, 3.5), (None, None)}
    scores = spark.createDataFrame([("ood", 0.4), ("ood", 0.41), ("control", 0.3), (None, 0.2)], "c string, s double")
    summary = evaluation.probe_summary(scores, "c", "s").collect()[0]
    assert summary.failures == 1 and not summary.passed and math.isclose(summary.margin, 0.3 - (0.4 + 0.41 + 0.2) / 3)
    assert [r.verdict for r in evaluation.probe_rows(scores, "c", "s").collect()] == ["ok", "fail", "low", "ok"]


def verdict(spark, xs, ys):
    return evaluation.correlate(spark.createDataFrame(list(zip(xs, ys, strict=True)), "a double, b double"), "a", "b").collect()[0]


def test_correlation(spark):
    x = [i / 20 for i in range(1, 21)]
    assert verdict(spark, x, x).verdict == "redundant"
    curved = verdict(spark, x, [v**20 for v in x])
    assert curved.verdict == "redundant" and curved.pearson < 0.7 <= curved.spearman
    assert verdict(spark, x, [1.0] * 20).verdict == "flat" and verdict(spark, x, [1.0] * 20).pearson is None
    assert verdict(spark, [1.0, 2.0], [1.0, 2.0]).verdict == "none"
    assert verdict(spark, [1.0, 0.0, 1.0, 0.0], [1.0, 1.0, 0.0, 0.0]).co_activation == pytest.approx(1 / 3)


def test_run_comparison(spark):
    a = spark.createDataFrame([("p", 0, 0.1), ("p", 1, 0.5), ("q", 2, 0.9), ("r", 3, None)], "prompt string, pos int, s double")
    b = spark.createDataFrame([("p", 0, 0.7), ("q", 1, 0.3), ("r", 2, 0.1), ("z", 3, 0.1)], "prompt string, pos int, s double")
    got = evaluation.compare_prompts(a, b, "prompt", "pos", "s")
    assert {r.prompt: round(r.delta, 6) for r in got.collect()} == {"p": 0.2, "q": -0.6}
    assert [r.prompt for r in evaluation.top_regressions(got, "prompt", 5).collect()] == ["q"]
    assert tuple(evaluation.change_counts(got).collect()[0]) == (1, 1, 0)
    runs = spark.sql("select 'r' run_id, map('distinct_1', 0.2D, 'perplexity', 9D, 'x', null) a, map('distinct_1', 0.3D, 'perplexity', 9D, 'y', 1D) b")
    deltas = evaluation.metric_deltas(evaluation.unpivot(runs, ["run_id"], "a"), evaluation.unpivot(runs, ["run_id"], "b"), ["run_id"])
    assert {r.metric: r.verdict for r in deltas.collect()} == {"distinct_1": "better", "perplexity": "same"}


def test_classifier_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.5, 1), (0.1, 0), (0.9, 1), (None, 1)], "p double, y int")
    m = evaluation.binary_metrics(df, "p", "y").collect()[0]
    assert (m.n, m.accuracy, round(m.precision, 4), round(m.recall, 4)) == (5, 0.6, 0.6667, 0.6667)
    auc = evaluation.roc_auc(df.withColumn("pos", F.col("y") == 1), "p", "pos").collect()[0].auc
    assert math.isclose(auc, 5 / 6)
    assert evaluation.roc_auc(df.withColumn("pos", F.lit(True)), "p", "pos").collect()[0].auc is None


def test_features(spark):
    rows = spark.createDataFrame([(1, [1.0, 1e6, 5.0]), (2, [3.0, 3e6, 5.0])], "i int, v array<float>")
    stats = evaluation.feature_stats(rows, "v")
    assert {(r.dim, r.mean) for r in stats.collect()} == {(0, 2.0), (1, 2e6), (2, 5.0)} and min(r.std for r in stats.collect()) == 1e-6
    z = {r.i: r.z for r in evaluation.standardize(rows, "v", stats, "z").collect()}
    assert [round(a + b, 9) for a, b in zip(z[1], z[2], strict=True)] == [0.0, 0.0, 0.0]
    states = spark.sql("select array(array(1D, 2D), array(3D, 4D), array(9D, 9D)) s, array(1, 1, 0) m union all select array(array(1D, 1D)), array(0)")
    pooled = [r.p for r in states.select(evaluation.mean_pool(F.col("s"), F.col("m"), 2).alias("p")).collect()]
    assert [2.0, 3.0] in pooled and [0.0, 0.0] in pooled
    head = spark.sql("select array(1D, -1D) z").select(evaluation.linear_head(F.col("z"), [2.0, 0.0], 0.5).alias("p")).collect()[0].p
    assert math.isclose(head, 1 / (1 + math.exp(-(2 / math.sqrt(1 + 1e-5) + 0.5))))


def test_reward_groups_hold_one_prompt(spark, tmp_path):
    parts = ", ".join(f"'{c}', 0.25D * id" for c in ["total", *COMPONENTS])
    prompts = "array('The sea', 'The sea', 'The canal', 'The canal', 'A map', 'The sea')"
    spark.range(6).selectExpr("id as completion_id", "'r' as run_id", "cast(id as int) as pos", f"{prompts}[int(id)] as prompt", f"named_struct({parts}) as grpo_reward_breakdown", "timestamp'2026-01-01' as loaded_at").write.parquet(str(tmp_path / "eval_completions.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r.group_no, r["size"], r["mean"]) for r in run("reward_groups")) == [(0, 2, 0.125), (1, 2, 0.625), (2, 1, 1.0), (3, 1, 1.25)]
    half = round(1 / math.sqrt(2), 9)
    assert {r.completion_id: (r.group_no, r.advantage) for r in run("group_advantage")} == {0: (0, -half), 1: (0, half), 2: (1, -half), 3: (1, half), 4: (2, 0.0), 5: (3, 0.0)}
    assert [(r.groups, r.dead_groups) for r in run("dead_group_summary")] == [(4, 2)]
    assert run("components_without_spread") == []


def test_mean_pool_takes_all_vectors(spark, tmp_path):
    rows = [(0, [1.0, 2.0], 0), (1, [5.0, None], 0), (300, [3.0, 8.0], 0), (3, [7.0, None], 1), (5, [9.0, None], 1), (7, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.label, r.dim): r.value for r in QUERIES["mean_pool"](spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 3.0, (0, 1): 5.0, (1, 0): 8.0, (1, 1): 0.0}


def test_reference_is_not_sent_through_the_driver(spark, tmp_path):
    words = "uno dos tres cuatro cinco seis siete ocho nueve diez"
    spark.createDataFrame([(1, words), (2, words + " once doce"), (3, None)], "i int, x string").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))  # a file's size is known to the planner
    copies = scoring.reference_copy(texts, "i", "x", scoring.reference_ngrams(texts.filter("i = 1"), "x"))
    assert "BroadcastExchange" not in copies._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.reference_copy for r in copies.collect()} == {1: 1.0, 2: 0.6, 3: 0.0}


def test_scoring_sends_nothing_through_the_driver(spark, tmp_path):
    words = "uno dos tres cuatro cinco seis siete ocho nueve diez"
    spark.createDataFrame([(1, words, 0.5), (2, "otras palabras", 0.5)], "i int, x string, p double").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    scored = scoring.score(texts.withColumn("q", F.lit("q")), "i", "x", "q", "p", F.lit(60), scoring.reference_ngrams(texts, "x"))
    assert "BroadcastExchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.reference_copy_penalty for r in scored.collect()} == {1: 0.15, 2: 0.0}


class Length:
    def predict(self, texts):
        return [len(t) / 10 for t in texts]

    def encode(self, text):
        return list(text[::4])


def test_hooks(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, None), (3, "")], "i int, t string")
    got = {r.i: (r.s, r.n) for r in df.select("i", hooks.scorer_column(Length, F.col("t")).alias("s"), hooks.tokens_column(Length, F.col("t")).alias("n")).collect()}
    assert got == {1: (0.8, 2), 2: (None, 0), 3: (0.0, 0)}
    made = hooks.negatives(df.filter("t is not null").withColumn("t", F.lit("One. Two. Three.")), "t", "shuffle", 2)
    assert made.count() == 4 and {tuple(sorted(r.t.split())) for r in made.collect()} == {("One.", "Three.", "Two.")}
    with pytest.raises(NotImplementedError):
        hooks.negatives(df, "t", "random_corpus")
    with pytest.raises(ValueError):
        hooks.negatives(df, "t", "nonsense")
    row = spark.sql("select array(1,2) p, array(3,4,5) c").select(hooks.collate(F.col("p"), F.col("c"), 4, F.lit(6)).alias("b")).collect()[0].b
    assert row.input_ids == [1, 2, 3, 4, 0, 0] and row.labels == [-100, -100, 3, 4, -100, -100] and row.attention_mask == [1, 1, 1, 1, 0, 0]
    repeated = hooks.repeat_prompts(spark.createDataFrame([("a", 0), ("b", 1)], "p string, pos int"), "pos", 3)
    assert [r.p for r in repeated.orderBy("pos").collect()] == list("aaabbb")
    pairs = hooks.sft_pairs(spark.createDataFrame([("One two three. Four five six. Seven eight nine ten eleven.", 1, None), ("short. text.", 1, "poetic"), ("x", 0, "y")], "text string, label int, style string"), "text")
    assert [r.completion for r in pairs.collect()] == ["Seven eight nine ten eleven."]
    assert {r.label for r in hooks.contrastive(df.select("t"), df.select("t"), "t").collect()} == {0, 1}


def test_payloads(spark):
    values = ['[{"role": "user", "content": "a"}]', '{"content": "b"}', '"c"', "plain [text", "", None, "  "]
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    rows = df.select("i", payloads.payload_text(F.col("t")).alias("p"), payloads.or_placeholder(F.col("t")).alias("o"), payloads.rephrase_request(F.lit("x"), F.col("i")).alias("r")).orderBy("i").collect()
    assert [r.p for r in rows] == ["a", "b", "c", "plain [text", "", None, "  "]
    assert [r.o for r in rows[4:]] == ["empty"] * 3 and len({r.r for r in rows}) == 3
    texts = spark.createDataFrame([("Short. More.",), ("This one is long enough. More.",), ("x" * 300 + ".",)], "t string")
    assert [r.s for r in texts.select(payloads.opening_sentence(F.col("t")).alias("s")).collect()] == [None, "This one is long enough.", None]
    half = spark.sql("select array(1.0D, 1.0D) a").select(payloads.second_class_probability(F.col("a")).alias("p")).collect()[0].p
    assert half == 0.5


def test_fit_prompts(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "p string, pos int")
    fitted = lambda n, d=df: [r.p for r in payloads.fit_prompts(d, "pos", n).orderBy("pos").collect()]
    assert fitted(3) == list("abc") and fitted(6) == list("aabbcc") and fitted(2) == list("ab")
    assert fitted(4, df.filter("pos = 0")) == list("aaaa") and fitted(2, df.limit(0)) == []
    assert payloads.zip_by_position(df, df.filter("pos > 0").withColumnRenamed("p", "q"), "pos").count() == 2


def test_logistic(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(200):
        y = i % 2
        rows.append((i, y, [rnd.gauss(2 * y, 1.0), rnd.gauss(0, 1e4), 3.0]))
    folds, summary = models.cross_validate(spark.createDataFrame(rows, "i int, y int, v array<double>"), "v", "y", "i", k=3)
    assert folds.count() == 3 and summary.collect()[0].auc_mean > 0.85
