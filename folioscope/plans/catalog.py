"""Registered queries over the driver tables and their oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ngrams as ng
from ..functions import prompts as pr
from ..functions import rewards as rw
from ..functions import text as tx
from ..operators import corpus, evaluation, models, scoring
from ..operators.ranking import hash_rank, seeded_hash
from ..session import latest, prepare, table
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, folder: f(prepare(spark), folder)
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _samples(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "writing_samples"), "sample_id", "loaded_at", ["sample_id", *columns])


def _texts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return _samples(spark, folder, "text", *columns).filter("text is not null")


def _completions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return latest(table(spark, folder, "eval_completions"), "completion_id", "loaded_at", ["completion_id", *columns])


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# corpus -----------------------------------------------------------------------------------


@query(f"SELECT doc_id, {sql.clean('text')} AS text FROM documents WHERE text IS NOT NULL")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", tx.clean(F.col("text")).alias("text"))


@query(f"SELECT min(doc_id) AS doc_id, md5(c) AS text_md5, count(*) AS copies FROM (SELECT doc_id, {sql.clean('text')} AS c FROM documents) WHERE length(c) > 0 GROUP BY c")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = table(spark, folder, "documents").withColumn("c", tx.clean(F.col("text"))).select("doc_id", F.md5("c").alias("text_md5"), F.length("c").alias("n")).filter("n > 0")
    return cleaned.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"SELECT doc_id, source, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM (SELECT doc_id, source, lang, {sql.clean('text')} AS text FROM documents)) WHERE length(text) > 0 AND k = 1")
def processed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.process(table(spark, folder, "documents").select("doc_id", "source", "lang", "text"), "text", "doc_id")


@query(f"SELECT doc_id, {sql.words('text')}::INT AS words, {sql.is_verse('text')} AS verse, {sql.infer_language('text')} AS language FROM documents WHERE text IS NOT NULL")
def surface_features(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", tx.word_count(F.col("text")).alias("words"), tx.is_verse(F.col("text")).alias("verse"), tx.infer_language(F.col("text")).alias("language"))


_COUNTED = f"{sql.TEXTS}, counted AS (SELECT *, {sql.words('text')} AS w FROM texts), {sql.edges('counted', 'w')}"
_STRATA = f"{_COUNTED}, strata AS (SELECT c.*, (SELECT count(*) FROM edges WHERE edge <= w)::INT AS bin, {sql.infer_language('text')} AS language, {sql.is_verse('text')} AS verse FROM counted c)"
_CELLS = "SELECT bin, language, verse, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS kept FROM strata GROUP BY ALL HAVING kept > 0"


@query(f"WITH {_COUNTED} SELECT edge::INT AS edge FROM edges")
def length_bins(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.bin_edges(_texts(spark, folder).select(tx.word_count(F.col("text")).alias("words")), "words")


@query(f"WITH {_STRATA} {_CELLS}")
def surface_cells(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.surface_cells(_texts(spark, folder, "label").select("text", "label"), "text", "label")


@query(f"WITH {_COUNTED}, strata AS (SELECT label, (SELECT count(*) FROM edges WHERE edge <= w)::INT AS bin FROM counted) SELECT bin, least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS kept FROM strata GROUP BY ALL HAVING kept > 0")
def length_cells(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.surface_cells(_texts(spark, folder, "label").select("text", "label"), "text", "label", form=False)


@query(f"WITH {_STRATA}, cells AS ({_CELLS}), ranked AS (SELECT *, row_number() OVER (PARTITION BY bin, language, verse, label ORDER BY {sql.hash_order(42, 'sample_id')}, sample_id) AS k FROM strata) SELECT sample_id, label, bin, language, verse FROM ranked JOIN cells USING (bin, language, verse) WHERE k <= kept")
def length_matched(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.length_matched(_texts(spark, folder, "label").select("sample_id", "text", "label"), "text", "label", "sample_id").select("sample_id", "label", "bin", "language", "verse")


@query(f"WITH {sql.SAMPLES}, kept AS (SELECT least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS n FROM samples), ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql.hash_order(42, 'sample_id')}, sample_id) AS k FROM samples WHERE label IN (0, 1)) SELECT sample_id, label FROM ranked, kept WHERE k <= n")
def undersample(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.undersample(_samples(spark, folder, "label").select("sample_id", "label"), "label", "sample_id").select("sample_id", "label")


@query(f"WITH {sql.SAMPLES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql.hash_order(42, 'sample_id')}, sample_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM samples) SELECT sample_id, label, CASE WHEN k <= round(n * 0.15) THEN 'val' ELSE 'train' END AS part FROM ranked")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.stratified_split(_samples(spark, folder, "label").select("sample_id", "label"), "label", "sample_id").select("sample_id", "label", "part")


@query(f"WITH {sql.SAMPLES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql.hash_order(7, 'sample_id')}, sample_id) AS k FROM samples) SELECT sample_id, label, ((k - 1) % 5)::INT AS fold FROM ranked")
def kfold_assign(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.kfold(_samples(spark, folder, "label").select("sample_id", "label"), "label", "sample_id", seed=7).select("sample_id", "label", "fold")


@query(f"WITH {sql.SAMPLES} SELECT split, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative FROM samples WHERE split IS NOT NULL GROUP BY 1")
def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.class_counts(_samples(spark, folder, "split", "label"), "split", "label")


@query(f"WITH {sql.SAMPLES} SELECT source_type, count(*) AS n FROM samples WHERE label = 0 GROUP BY 1")
def negative_sources(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(spark, folder, "source_type", "label").filter("label = 0").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {sql.SAMPLES} SELECT build_id, sha256(coalesce(array_to_string(list_sort(list(text) FILTER (text IS NOT NULL)), chr(10)), '')) AS text_hash FROM samples GROUP BY 1")
def corpus_hash(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.corpus_hash(_samples(spark, folder, "build_id", "text"), "text", ["build_id"])


@query()
def corpus_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.corpus_fingerprint(_samples(spark, folder, "text"), "text")


@query(f"WITH {sql.SAMPLES}, a AS (SELECT build_id, sha256(coalesce(array_to_string(list_sort(list(text) FILTER (text IS NOT NULL)), chr(10)), '')) AS actual_hash FROM samples GROUP BY 1), m AS (SELECT build_id, text_hash AS manifest_hash FROM manifest) SELECT build_id, actual_hash, manifest_hash FROM a FULL JOIN m USING (build_id) WHERE actual_hash IS DISTINCT FROM manifest_hash")
def manifest_drift(spark: SparkSession, folder: str) -> DataFrame:
    actual = corpus.corpus_hash(_samples(spark, folder, "build_id", "text"), "text", ["build_id"])
    return corpus.drifted(actual, table(spark, folder, "manifest"), "build_id")


_COUNTS = "SELECT build_id, split, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative FROM samples WHERE split IS NOT NULL GROUP BY 1, 2"


@query(f"WITH {sql.SAMPLES} {_COUNTS}")
def corpus_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _samples(spark, folder, "build_id", "split", "label").filter("split is not null")
    return rows.groupBy("build_id", "split").agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


@query(f"WITH {sql.SAMPLES}, c AS ({_COUNTS}), m AS (SELECT build_id, unnest(['train', 'val', 'test']) AS split, unnest([counts_per_class.train, counts_per_class.val, counts_per_class.test]) AS k FROM manifest) SELECT build_id, split, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, k.positive AS said_positive, k.negative AS said_negative FROM m LEFT JOIN c USING (build_id, split) WHERE coalesce(positive, 0) <> k.positive OR coalesce(negative, 0) <> k.negative")
def manifest_count_drift(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "manifest").select("build_id", F.explode(F.array(*(F.struct(F.lit(s).alias("split"), F.col(f"counts_per_class.{s}").alias("k")) for s in ("train", "val", "test")))).alias("x"))
    said = said.select("build_id", "x.split", F.col("x.k.positive").alias("said_positive"), F.col("x.k.negative").alias("said_negative"))
    joined = said.join(corpus_manifest(spark, folder), ["build_id", "split"], "left").fillna(0, ["positive", "negative"])
    return joined.filter("positive <> said_positive or negative <> said_negative").select("build_id", "split", "positive", "negative", "said_positive", "said_negative")


# prompts ----------------------------------------------------------------------------------


@query(f"WITH {sql.TEXTS} SELECT sample_id, {sql.infer_language('text')} AS language FROM texts")
def infer_language(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("sample_id", tx.infer_language(F.col("text")).alias("language"))


@query(f"WITH {sql.TEXTS} SELECT sample_id, {sql.detect_language('text')} AS language FROM texts")
def detect_language(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("sample_id", tx.detect_language(F.col("text")).alias("language"))


@query(f"WITH {sql.SEEDS} SELECT sample_id, seed, continuation FROM seeds")
def seed_split(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).withColumn("p", pr.seed_and_continuation(F.col("text"))).select("sample_id", "p.seed", "p.continuation")


_STYLE = "coalesce(style, 'standard')"


@query(f"WITH {sql.SEEDS} SELECT sample_id, {sql.control_prompt('seed', _STYLE, sql.infer_language('t'))} AS prompt, seed AS raw_prompt, {_STYLE} AS style, {sql.infer_language('t')} AS language FROM seeds WHERE label = 1 AND {sql.words('seed')} >= 5 ORDER BY sample_id LIMIT 500")
def control_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The first 500 prompts by id: the limit is the feature."""
    style = F.coalesce("style", F.lit("standard"))
    language = tx.infer_language(tx.strip(F.col("text")))
    rows = _texts(spark, folder, "label", "style").filter("label = 1").select("sample_id", pr.seed_and_continuation(F.col("text"))["seed"].alias("raw_prompt"), style.alias("style"), language.alias("language"))
    rows = rows.filter(tx.word_count(F.col("raw_prompt")) >= 5).orderBy("sample_id").limit(500)
    return rows.select("sample_id", pr.control_prompt(F.col("raw_prompt"), F.col("style"), F.col("language")).alias("prompt"), "raw_prompt", "style", "language")


@query(f"WITH {sql.SEEDS} SELECT sample_id, {sql.control_prompt('seed', _STYLE, sql.infer_language('t'))} AS prompt, continuation AS completion FROM seeds WHERE label = 1 AND split = 'train' AND {sql.words('seed')} >= 5 AND {sql.words('continuation')} >= 5")
def sft_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder, "label", "style", "split").filter("label = 1 and split = 'train'").withColumn("p", pr.seed_and_continuation(F.col("text"))).select("sample_id", "p.seed", F.col("p.continuation").alias("completion"), F.coalesce("style", F.lit("standard")).alias("style"), tx.infer_language(tx.strip(F.col("text"))).alias("language"))
    rows = rows.filter((tx.word_count(F.col("seed")) >= 5) & (tx.word_count(F.col("completion")) >= 5))
    return rows.select("sample_id", pr.control_prompt(F.col("seed"), F.col("style"), F.col("language")).alias("prompt"), "completion")


@query(f"SELECT prompt_id, {sql.control_prompt('prompt', chr(39) + 'standard' + chr(39), sql.infer_language('prompt'))} AS wrapped, true AS stable, {sql.strip('prompt')} AS seed FROM eval_prompts")
def ensure_prompt(spark: SparkSession, folder: str) -> DataFrame:
    wrapped = table(spark, folder, "eval_prompts").withColumn("wrapped", pr.ensure_control_prompt(F.col("prompt")))
    return wrapped.select("prompt_id", "wrapped", (pr.ensure_control_prompt(F.col("wrapped")) == F.col("wrapped")).alias("stable"), pr.seed_of_prompt(F.col("wrapped")).alias("seed"))


# rewards ----------------------------------------------------------------------------------

def _tokens() -> Column:
    """A stand-in tokenizer: four characters a token."""
    return F.floor(F.length(F.coalesce("grpo_completion", F.lit(""))) / 4)


_COUNT = f"{sql.COMPLETIONS}, t AS (SELECT completion_id, {sql.content_tokens('grpo_completion')} AS tt FROM completions WHERE grpo_completion IS NOT NULL)"


@query(f"WITH {_COUNT} SELECT completion_id, array_to_string(tt, ' ') AS tokens, len(tt)::INT AS n FROM t")
def content_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = _completions(spark, folder, "grpo_completion").filter("grpo_completion is not null").withColumn("t", ng.content_tokens(F.col("grpo_completion")))
    return rows.select("completion_id", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n"))


@query(f"WITH {_COUNT} SELECT completion_id, gram FROM (SELECT completion_id, unnest({sql.distinct_windows('tt', 3)}) AS gram FROM t)")
def ngrams(spark: SparkSession, folder: str) -> DataFrame:
    rows = _completions(spark, folder, "grpo_completion").filter("grpo_completion is not null")
    return rows.select("completion_id", F.explode(ng.ngrams(ng.content_tokens(F.col("grpo_completion")), 3)).alias("gram"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    reference = scoring.reference_ngrams(_texts(spark, folder, "label"), "text", 8)
    return scoring.score(_completions(spark, folder, "run_id", "pos", "prompt", "grpo_completion", "grpo_style_score"), "completion_id", "grpo_completion", "prompt", "grpo_style_score", _tokens(), reference)


def _part(name: str, column: str, weight: float) -> None:
    sql_text = f"WITH {sql.REWARDS} SELECT completion_id, round({column} / {weight}, 9) AS {name} FROM rewards"

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _scored(spark, folder).select("completion_id", F.round(F.col(column) / weight, 9).alias(name))

    run.__name__ = name
    query(sql_text)(run)


for _name, _column, _weight in (("repetition_penalty", "repetition_penalty", 0.15), ("reference_copy", "reference_copy_penalty", 0.15), ("prompt_relevance", "prompt_relevance", 0.2), ("prompt_echo", "prompt_echo_penalty", 0.1), ("length_bonus", "length_bonus", 0.1)):
    _part(_name, _column, _weight)


@query("SELECT completion_id, round(max(CASE WHEN grpo_style_score IS NOT NULL THEN 1 / (1 + exp(-ln(least(greatest(grpo_style_score, 1e-5), 1 - 1e-5) / (1 - least(greatest(grpo_style_score, 1e-5), 1 - 1e-5))) / 2)) END), 9) AS scaled FROM eval_completions GROUP BY 1")
def temperature_scale(spark: SparkSession, folder: str) -> DataFrame:
    return _completions(spark, folder, "grpo_style_score").select("completion_id", F.round(rw.temperature_scale(F.col("grpo_style_score"), 2.0), 9).alias("scaled"))


_PARTS = ["total", "raw_style_prob", *rw.COMPONENTS]


@query(f"WITH {sql.REWARDS} SELECT completion_id, {', '.join(f'round({c}, 9) AS {c}' for c in _PARTS)} FROM rewards")
def reward_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_scored(spark, folder).select("completion_id", *_PARTS))


def _breakdowns(spark: SparkSession, folder: str) -> DataFrame:
    """Stored breakdowns with groups: contiguous runs of equal prompts. The
    oracle cuts prompts to their first character and so has other groups."""
    rows = _completions(spark, folder, "run_id", "pos", "prompt", "grpo_reward_breakdown").filter("grpo_reward_breakdown is not null").select("completion_id", "run_id", "pos", "prompt", "grpo_reward_breakdown.*")
    return scoring.group_runs(rows, ["run_id"], "pos", "prompt")


_STD = "CASE WHEN max({0}) = min({0}) THEN 0.0 ELSE coalesce(stddev_samp({0}), 0.0) END"
_GROUPED = f"{sql.GROUPS}, grouped AS (SELECT run_id, group_no, count(*) AS size, avg(total) AS mean, {_STD.format('total')} AS std, min(total) AS min, max(total) AS max, {', '.join(f'{_STD.format(c)} AS std_{c}' for c in rw.COMPONENTS)} FROM numbered GROUP BY 1, 2)"


@query(f"WITH {_GROUPED} SELECT run_id, group_no, size, round(mean, 9) AS mean, round(std, 9) AS std, round(min, 9) AS min, round(max, 9) AS max, {', '.join(f'round(std_{c}, 9) AS std_{c}' for c in rw.COMPONENTS)}, std < 0.01 AS is_dead FROM grouped")
def reward_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(scoring.summarize_groups(_breakdowns(spark, folder), ["run_id", "group_no"]))


@query(f"WITH {sql.GROUPS}, s AS (SELECT *, avg(total) OVER g AS m, stddev_samp(total) OVER g AS sd, max(total) OVER g = min(total) OVER g AS flat FROM numbered WINDOW g AS (PARTITION BY run_id, group_no)) SELECT completion_id, group_no, round(CASE WHEN flat OR sd IS NULL THEN 0.0 ELSE (total - m) / sd END, 9) AS advantage FROM s")
def group_advantage(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(scoring.advantages(_breakdowns(spark, folder), ["run_id", "group_no"]).select("completion_id", "group_no", "advantage"))


_SUMMARY = f"count(*) AS groups, round(avg(std), 9) AS std_mean, round(min(std), 9) AS std_min, round(max(std), 9) AS std_max, round(avg(mean), 9) AS reward_mean, count(*) FILTER (std < 0.01) AS dead_groups, round(count(*) FILTER (std < 0.01) / count(*), 9) AS dead_fraction, {', '.join(f'round(avg(std_{c}), 9) AS spread_{c}' for c in rw.COMPONENTS)}"


@query(f"WITH {_GROUPED} SELECT run_id, {_SUMMARY} FROM grouped GROUP BY 1")
def dead_group_summary(spark: SparkSession, folder: str) -> DataFrame:
    groups = scoring.summarize_groups(_breakdowns(spark, folder), ["run_id", "group_no"])
    return _rounded(scoring.run_summary(groups, ["run_id"]).drop("without_spread"))


_WITHOUT = " UNION ALL ".join(f"SELECT run_id, '{c}' AS component FROM grouped GROUP BY 1 HAVING max(std_{c}) = 0" for c in rw.COMPONENTS)


@query(f"WITH {_GROUPED} {_WITHOUT}")
def components_without_spread(spark: SparkSession, folder: str) -> DataFrame:
    groups = scoring.summarize_groups(_breakdowns(spark, folder), ["run_id", "group_no"])
    return scoring.run_summary(groups, ["run_id"]).select("run_id", F.explode("without_spread").alias("component"))


@query(f"WITH {sql.COMPLETIONS}, b AS (SELECT run_id, floor(pos / 4)::INT AS group_no, grpo_reward_breakdown.total AS total FROM completions WHERE grpo_reward_breakdown IS NOT NULL) SELECT run_id, group_no, count(*) AS size, round(avg(total), 9) AS mean FROM b GROUP BY 1, 2")
def reward_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = _completions(spark, folder, "run_id", "pos", "grpo_reward_breakdown").filter("grpo_reward_breakdown is not null").select("run_id", "pos", "grpo_reward_breakdown.total")
    return _rounded(scoring.group_chunks(rows, "pos", 4).groupBy("run_id", "group_no").agg(F.count(F.lit(1)).alias("size"), F.avg("total").alias("mean")))


# evaluation -------------------------------------------------------------------------------

_GRAMS = f"{sql.COMPLETIONS}, w AS (SELECT run_id, {sql.word_list('lower(grpo_completion)')} AS ws FROM completions WHERE grpo_completion IS NOT NULL)"


@query(f"WITH {_GRAMS}, g1 AS (SELECT run_id, unnest({sql.windows('ws', 1)}) AS g FROM w), g2 AS (SELECT run_id, unnest({sql.windows('ws', 2)}) AS g FROM w) SELECT run_id, round(d1, 9) AS distinct_1, round(d2, 9) AS distinct_2 FROM (SELECT run_id, count(DISTINCT g) / count(*) AS d1 FROM g1 GROUP BY 1) JOIN (SELECT run_id, count(DISTINCT g) / count(*) AS d2 FROM g2 GROUP BY 1) USING (run_id)")
def distinct_n(spark: SparkSession, folder: str) -> DataFrame:
    rows = _completions(spark, folder, "run_id", "grpo_completion").filter("grpo_completion is not null")
    return _rounded(evaluation.distinct_n(rows, "grpo_completion", 1, ["run_id"]).join(evaluation.distinct_n(rows, "grpo_completion", 2, ["run_id"]), "run_id"))


_STYLE_SQL = f"round(avg(grpo_style_score), 9) AS style_score_mean, round(stddev_pop(grpo_style_score), 9) AS style_score_std, min(grpo_style_score) AS style_score_min, max(grpo_style_score) AS style_score_max, round(avg({sql.words('grpo_completion')}), 9) AS avg_words, min({sql.words('grpo_completion')})::INT AS min_words, max({sql.words('grpo_completion')})::INT AS max_words"


@query(f"WITH {sql.COMPLETIONS} SELECT run_id, {_STYLE_SQL} FROM completions GROUP BY 1")
def style_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _completions(spark, folder, "run_id", "grpo_completion", "grpo_style_score")
    return _rounded(evaluation.style_stats(rows, "grpo_style_score", ["run_id"]).join(evaluation.length_stats(rows, "grpo_completion", ["run_id"]), "run_id"))


@query(f"WITH {sql.COMPLETIONS} SELECT {sql.infer_language('prompt')} AS language, {_STYLE_SQL} FROM completions GROUP BY 1")
def metrics_by_language(spark: SparkSession, folder: str) -> DataFrame:
    rows = _completions(spark, folder, "prompt", "grpo_completion", "grpo_style_score").withColumn("language", tx.infer_language(pr.seed_of_prompt(F.col("prompt"))))
    return _rounded(evaluation.style_stats(rows, "grpo_style_score", ["language"]).join(evaluation.length_stats(rows, "grpo_completion", ["language"]), "language"))


_LENGTHS = f"{sql.TEXTS}, r AS (SELECT {sql.detect_language('text')} AS language, {sql.words('text')} AS words, floor(length(text) / 4.0)::BIGINT AS tokens FROM texts WHERE label = 1), l AS (SELECT language, count(*) AS n, round(avg(tokens / words) FILTER (words > 0), 9) AS tokens_per_word, max(tokens) AS max_tokens, round(count(*) FILTER (tokens > 60) / count(*), 9) AS over_budget, list(words) AS ws, list(tokens) AS ts FROM r GROUP BY 1)"


@query(f"WITH {_LENGTHS} SELECT language, n, tokens_per_word, max_tokens, over_budget, {sql.value_at('ws', 'n', 0.5)}::INT AS median_words, {sql.value_at('ts', 'n', 0.5)} AS median_tokens, {sql.value_at('ts', 'n', 0.9)} AS p90_tokens FROM l")
def length_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder, "label").filter("label = 1").select(tx.detect_language(F.col("text")).alias("language"), tx.word_count(F.col("text")).alias("words"), F.floor(F.length("text") / 4).alias("tokens"))
    return _rounded(evaluation.length_report(rows, "language", "words", "tokens", 60))


def _md5_score(key: str) -> Column:
    """A stand-in score from 0 to 1 that any engine can compute."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("double") / 65535


_MD5_SCORE = "('0x' || substring(md5({0}::VARCHAR), 1, 4))::INT / 65535.0"


@query(f"WITH s AS (SELECT category, {_MD5_SCORE.format('id')} AS score FROM probe_texts) SELECT count(*) FILTER (category <> 'control' AND score > 0.4) AS failures, round(max(score) FILTER (category <> 'control'), 9) AS max_ood, round(avg(score) FILTER (category <> 'control'), 9) AS mean_ood, round(avg(score) FILTER (category = 'control'), 9) AS mean_control, round(avg(score) FILTER (category = 'control') - avg(score) FILTER (category <> 'control'), 9) AS margin, count(*) FILTER (category <> 'control' AND score > 0.4) = 0 AS passed FROM s")
def sanity_probe(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.probe_summary(table(spark, folder, "probe_texts").withColumn("score", _md5_score("id")), "category", "score"))


@query(f"WITH s AS (SELECT id, category, {_MD5_SCORE.format('id')} AS score FROM probe_texts) SELECT id, round(score, 9) AS score, CASE WHEN category <> 'control' AND score > 0.4 THEN 'fail' WHEN category = 'control' AND score < 0.5 THEN 'low' ELSE 'ok' END AS verdict FROM s")
def probe_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "probe_texts").withColumn("score", _md5_score("id"))
    return _rounded(evaluation.probe_rows(rows, "category", "score").select("id", "score", "verdict"))


@query(f"WITH {sql.COMPLETIONS} SELECT run_id, round(exp(sum(l * w) / sum(w)), 9) AS perplexity FROM (SELECT run_id, 1 - grpo_style_score AS l, {sql.words('grpo_completion')} AS w FROM completions WHERE grpo_style_score IS NOT NULL AND grpo_completion IS NOT NULL) GROUP BY 1")
def perplexity_agg(spark: SparkSession, folder: str) -> DataFrame:
    rows = _completions(spark, folder, "run_id", "grpo_completion", "grpo_style_score").filter("grpo_style_score is not null and grpo_completion is not null").select("run_id", (1 - F.col("grpo_style_score")).alias("loss"), tx.word_count(F.col("grpo_completion")).alias("tokens"))
    return _rounded(evaluation.perplexity(rows, "loss", "tokens", ["run_id"]))


@query(f"WITH {sql.COMPLETIONS}, r AS (SELECT DISTINCT run_id, model FROM eval_runs) SELECT model, {', '.join(f'round(avg(grpo_reward_breakdown.{c}), 13) AS {c}' for c in _PARTS)} FROM completions JOIN r USING (run_id) GROUP BY 1")
def reward_means(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "eval_runs").select("run_id", "model").distinct()
    rows = _completions(spark, folder, "run_id", "grpo_reward_breakdown").select("run_id", "grpo_reward_breakdown.*").join(runs, "run_id")
    return _rounded(rows.groupBy("model").agg(*(F.avg(c).alias(c) for c in _PARTS)), 13)


# two runs: base and trained completions of the same rows; one of two models per row
_LAST = "SELECT prompt, arg_max({0}, struct_pack(r := run_id, p := pos)) AS {1} FROM (SELECT * FROM completions WHERE ({2})) GROUP BY 1"
_EVEN = "run_id IN (SELECT run_id FROM eval_runs WHERE model LIKE '%s1')"
_ODD = "run_id IN (SELECT run_id FROM eval_runs WHERE model LIKE '%s2')"
_PAIRS = f"""{sql.COMPLETIONS}, e AS (SELECT c.*, model FROM completions c JOIN (SELECT DISTINCT run_id, model FROM eval_runs) USING (run_id)),
last AS (SELECT *, row_number() OVER (PARTITION BY model, prompt ORDER BY run_id DESC, pos DESC) AS k FROM e),
pairs AS (SELECT a.prompt, round(a.grpo_style_score, 9) AS a, round(b.grpo_style_score, 9) AS b, round(b.grpo_style_score - a.grpo_style_score, 9) AS delta, b.grpo_completion AS completion FROM last a JOIN last b USING (prompt) WHERE a.k = 1 AND b.k = 1 AND a.model LIKE '%s1' AND b.model LIKE '%s2' AND a.grpo_style_score IS NOT NULL AND b.grpo_style_score IS NOT NULL)"""


def _model_rows(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    runs = table(spark, folder, "eval_runs").filter(F.col("model").endswith(suffix)).select("run_id").distinct()
    return _completions(spark, folder, "run_id", "pos", "prompt", "grpo_completion", "grpo_style_score").join(runs, "run_id", "left_semi").withColumn("at", F.struct("run_id", "pos"))


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _model_rows(spark, folder, "s1"), _model_rows(spark, folder, "s2")
    return _rounded(evaluation.compare_prompts(a, b, "prompt", "at", "grpo_style_score"))


@query(f"WITH {_PAIRS} SELECT prompt, a, b, delta FROM pairs")
def compare_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _compared(spark, folder)


@query(f"WITH {_PAIRS} SELECT prompt, a, b, delta FROM pairs WHERE delta < 0 ORDER BY delta, prompt LIMIT 10")
def top_regressions(spark: SparkSession, folder: str) -> DataFrame:
    """Ten at most: the limit is the feature."""
    return evaluation.top_regressions(_compared(spark, folder), "prompt", 10)


@query(f"WITH {_PAIRS} SELECT prompt, delta, completion FROM pairs WHERE delta < 0")
def regression_completions(spark: SparkSession, folder: str) -> DataFrame:
    texts = evaluation.last_per_prompt(_model_rows(spark, folder, "s2"), "prompt", "at", ["grpo_completion"])
    worse = _compared(spark, folder).filter("delta < 0")
    return worse.join(texts, "prompt", "left").select("prompt", "delta", F.col("grpo_completion").alias("completion"))


@query(f"WITH {_PAIRS} SELECT count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta < 0) AS regressed, count(*) FILTER (delta = 0) AS unchanged FROM pairs")
def change_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.change_counts(_compared(spark, folder))


_BETTER = sql.listed(evaluation.HIGHER_IS_BETTER)


@query(f"WITH b AS (SELECT run_id, unnest(map_keys(base_metrics)) AS metric, unnest(map_values(base_metrics)) AS base FROM eval_runs), g AS (SELECT run_id, unnest(map_keys(grpo_metrics)) AS metric, unnest(map_values(grpo_metrics)) AS new FROM eval_runs) SELECT run_id, metric, base, new, round(new - base, 9) AS delta, CASE WHEN abs(new - base) < 1e-6 THEN 'same' WHEN (metric IN {_BETTER} AND new > base) OR (metric NOT IN {_BETTER} AND new < base) THEN 'better' ELSE 'worse' END AS verdict FROM b JOIN g USING (run_id, metric) WHERE base IS NOT NULL AND new IS NOT NULL")
def compare_metrics(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "eval_runs")
    return evaluation.metric_deltas(evaluation.unpivot(runs, ["run_id"], "base_metrics"), evaluation.unpivot(runs, ["run_id"], "grpo_metrics"), ["run_id"]).withColumn("delta", F.round("delta", 9))


PAIRS = [("prompt_relevance", "prompt_echo_penalty"), ("prompt_relevance", "reference_copy_penalty"), ("style_score", "length_bonus"), ("prompt_echo_penalty", "repetition_penalty")]


def _correlation_sql(x: str, y: str) -> str:
    return f"""SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, round(avg(x), 9) AS mean_x, round(avg(y), 9) AS mean_y, round(stddev_pop(x), 9) AS std_x, round(stddev_pop(y), 9) AS std_y,
    count(*) FILTER (x > 0 AND y > 0) AS both_active, round(coalesce(count(*) FILTER (x > 0 AND y > 0) / nullif(count(*) FILTER (x > 0 OR y > 0), 0), 0.0), 9) AS co_activation,
    round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman, CASE WHEN greatest(abs(corr(x, y)), abs(corr(rx, ry))) >= 0.7 THEN 'redundant' WHEN greatest(abs(corr(x, y)), abs(corr(rx, ry))) <= 0.3 THEN 'independent' ELSE 'entangled' END AS verdict
    FROM (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT grpo_reward_breakdown.{x} AS x, grpo_reward_breakdown.{y} AS y FROM completions WHERE grpo_reward_breakdown.{x} IS NOT NULL AND grpo_reward_breakdown.{y} IS NOT NULL))"""


@query(f"WITH {sql.COMPLETIONS} " + " UNION ALL ".join(_correlation_sql(x, y) for x, y in PAIRS))
def component_correlation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _completions(spark, folder, "grpo_reward_breakdown").filter("grpo_reward_breakdown is not null").select("grpo_reward_breakdown.*")
    out: DataFrame | None = None
    for x, y in PAIRS:
        one = evaluation.correlate(rows, x, y).select(F.lit(x).alias("x"), F.lit(y).alias("y"), "*")
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


@query(f"WITH {sql.SAMPLES} SELECT sample_id FROM samples WHERE label = 1 AND sample_id NOT IN (SELECT doc_id FROM documents)")
def resume_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "documents").select(F.col("doc_id").alias("sample_id"))
    return corpus.with_unfinished(_samples(spark, folder, "label").filter("label = 1").select("sample_id"), done, "sample_id")


_HUMAN = f"{sql.TEXTS}, {sql.COMPLETIONS}, real AS (SELECT sample_id AS id, {sql.strip('text')} AS text, 'real' AS origin, {sql.hash_order(42, 'sample_id')} AS h FROM texts WHERE label = 1 AND {sql.strip('text')} <> '' ORDER BY h, id LIMIT 20), made AS (SELECT completion_id AS id, {sql.strip('grpo_completion')} AS text, 'generated' AS origin, {sql.hash_order(42, 'completion_id')} AS h FROM completions WHERE {sql.strip('grpo_completion')} <> '' ORDER BY h, id LIMIT 20)"


@query(f"WITH {_HUMAN} SELECT id, origin, text, row_number() OVER (ORDER BY md5('42|' || origin || '|' || id::VARCHAR), id)::INT AS number FROM (SELECT * FROM real UNION ALL SELECT * FROM made)")
def human_eval_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty of each origin, mixed and numbered: sampling is the feature."""
    real = _texts(spark, folder, "label").filter("label = 1").select(F.col("sample_id").alias("id"), tx.strip(F.col("text")).alias("text"), F.lit("real").alias("origin"))
    made = _completions(spark, folder, "grpo_completion").select(F.col("completion_id").alias("id"), tx.strip(F.col("grpo_completion")).alias("text"), F.lit("generated").alias("origin"))
    both = corpus.sample_by_hash(real.filter("text != ''"), "id", 20).unionByName(corpus.sample_by_hash(made.filter("text != ''"), "id", 20))
    return hash_rank(both, [], seeded_hash(42, "origin", "id"), "id", "number").withColumn("number", F.col("number").cast("int"))


@query(f"WITH {sql.COMPLETIONS} SELECT DISTINCT ON (prompt) prompt, run_id, pos FROM completions ORDER BY prompt, run_id, pos")
def first_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Each prompt once, where it first stands."""
    return _completions(spark, folder, "prompt", "run_id", "pos").groupBy("prompt").agg(F.min(F.struct("run_id", "pos")).alias("r")).select("prompt", "r.*")


# features ---------------------------------------------------------------------------------

_LONG = "long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
_FEATURE = f"{_LONG}, stats AS (SELECT dim::INT AS dim, avg(value) AS mean, greatest(coalesce(stddev_samp(value), 0.0), 1e-6) AS std FROM long GROUP BY 1)"


@query(f"WITH {_FEATURE} SELECT dim, round(mean, 5) AS mean, round(std, 5) AS std FROM stats")
def feature_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.feature_stats(table(spark, folder, "embeddings"), "embedding"), 5)


@query(f"WITH {_FEATURE} SELECT vec_id, long.dim::INT AS dim, round((value - mean) / std, 4) AS value FROM long JOIN stats ON long.dim = stats.dim")
def standardize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    scaled = evaluation.standardize(rows, "embedding", evaluation.feature_stats(rows, "embedding"), "z")
    return _rounded(scaled.select("vec_id", F.posexplode("z").alias("dim", "value")), 4)


@query(f"WITH {_LONG}, p AS (SELECT label, dim, avg(value) AS v FROM long WHERE vec_id % 2 = 0 GROUP BY 1, 2) SELECT label, dim::INT AS dim, round(v, 5) AS value FROM p")
def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Pools all vectors of a label; the mask leaves out missing values. The
    oracle pools those with even ids only."""
    return _rounded(evaluation.mean_pool_rows(table(spark, folder, "embeddings"), "embedding", "vec_id", ["label"]), 5)


_SCORED = "s AS (SELECT vec_id, label, label = 0 AS pos, 1 / (1 + exp(-(embedding[1] + embedding[2])::DOUBLE)) AS prob FROM embeddings)"


def _scored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    z = (F.get("embedding", 0) + F.get("embedding", 1)).cast("double")
    return table(spark, folder, "embeddings").select("vec_id", (F.col("label") == 0).alias("pos"), F.when(F.col("label") == 0, 1).otherwise(0).alias("y"), (1 / (1 + F.exp(-z))).alias("prob"))


_BINARY = "count(*) AS n, round(count(*) FILTER ((prob > 0.5) = pos) / count(*), 9) AS accuracy, round(coalesce(count(*) FILTER (prob > 0.5 AND pos) / nullif(count(*) FILTER (prob > 0.5), 0), 0.0), 9) AS precision, round(coalesce(count(*) FILTER (prob > 0.5 AND pos) / nullif(count(*) FILTER (pos), 0), 0.0), 9) AS recall, round(coalesce(2 * count(*) FILTER (prob > 0.5 AND pos) / nullif(count(*) FILTER (prob > 0.5) + count(*) FILTER (pos), 0), 0.0), 9) AS f1"


@query(f"WITH {_SCORED} SELECT {_BINARY} FROM s")
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.binary_metrics(_scored_vectors(spark, folder), "prob", "y"))


_RANKED = "r AS (SELECT *, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rk FROM s)"


@query(f"WITH {_SCORED}, {_RANKED} SELECT round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 9) AS auc FROM r")
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(evaluation.roc_auc(_scored_vectors(spark, folder), "prob", "pos"))


@query(f"WITH {_SCORED}, f AS (SELECT *, (row_number() OVER (PARTITION BY pos ORDER BY {sql.hash_order(42, 'vec_id')}, vec_id) - 1) % 5 AS fold FROM s), m AS (SELECT fold, count(*) FILTER ((prob > 0.5) = pos) / count(*) AS accuracy FROM f GROUP BY 1) SELECT round(avg(accuracy), 9) AS accuracy_mean, round(stddev_pop(accuracy), 9) AS accuracy_std FROM m")
def cv_summary(spark: SparkSession, folder: str) -> DataFrame:
    folds = corpus.kfold(_scored_vectors(spark, folder), "pos", "vec_id")
    return _rounded(evaluation.cv_summary(evaluation.binary_metrics(folds, "prob", "y", keys=["fold"]), ["accuracy"]))


@query()
def logistic_cv(spark: SparkSession, folder: str) -> DataFrame:
    """Folds of a linear model on the embeddings, first label against the rest."""
    rows = table(spark, folder, "embeddings").withColumn("y", F.when(F.col("label") == 0, 1).otherwise(0)).select("vec_id", "y", "embedding")
    folds, _ = models.cross_validate(rows, "embedding", "y", "vec_id")
    return _rounded(folds, 4)
