"""Pieces of oracle SQL (DuckDB) that mirror the column expressions."""

from __future__ import annotations

from ..functions.ngrams import STOPWORDS
from ..functions.prompts import CUE, instruction
from ..functions.text import EN_HINTS, EN_MARKERS, ES_HINTS, ES_MARKERS

SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

SAMPLES = "samples AS (SELECT * FROM writing_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY loaded_at DESC) = 1)"
TEXTS = f"{SAMPLES}, texts AS (SELECT * FROM samples WHERE text IS NOT NULL)"
COMPLETIONS = "completions AS (SELECT * FROM eval_completions QUALIFY row_number() OVER (PARTITION BY completion_id ORDER BY loaded_at DESC) = 1)"


def listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def word_list(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{SPACE}]+')"


def words(x: str) -> str:
    return f"len({word_list(x)})"


def lines(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '{LINE_BREAK}', chr(10), 'g'), chr(10)), lambda q: regexp_matches(q, '[^{SPACE}]'))"


def is_verse(x: str) -> str:
    return f"(len({lines(x)}) >= 3)"


def clean(x: str, limit: int = 2048, share: float = 0.8) -> str:
    a = f"regexp_replace({x}, 'https?://[^{SPACE}]+', '', 'g')"
    a = rf"regexp_replace({a}, '[^{SPACE}]+@[^{SPACE}]+\.[^{SPACE}]+', '', 'g')"
    a = rf"regexp_replace(regexp_replace({a}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    a = rf"regexp_replace({strip(a)}, '([!?.]){{3,}}', '\1\1', 'g')"
    head = f"substring({a}, 1, {limit})"
    space = f"length(regexp_extract({head}, '(?s)^(.*) [^ ]*$', 1))"
    return f"CASE WHEN length({a}) <= {limit} THEN {a} WHEN contains({head}, ' ') AND {space} > {limit * share} THEN substring({head}, 1, {space}) ELSE {head} END"


def infer_language(x: str) -> str:
    tokens = f"regexp_extract_all(lower({x}), '[a-zA-Záéíóúñü]+')"
    hits = lambda hints: f"len(list_filter({tokens}, lambda q: q IN {listed(hints)}))"
    return f"CASE WHEN {hits(EN_HINTS)} > {hits(ES_HINTS)} + CASE WHEN regexp_matches(lower({x}), '[áéíóúñ¿¡]') THEN 2 ELSE 0 END THEN 'en' ELSE 'es' END"


def detect_language(x: str) -> str:
    signs = """[.,;:!?¿¡"''()]+"""
    tokens = f"list_transform({word_list(x)}, lambda q: lower(regexp_replace(q, '^{signs}|{signs}$', '', 'g')))"
    hits = lambda marks: f"len(list_filter({tokens}, lambda q: q IN {listed(marks)}))"
    return f"CASE WHEN {hits(ES_MARKERS)} >= {hits(EN_MARKERS)} THEN 'es' ELSE 'en' END"


def content_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-zA-Záéíóúñü'']+'), lambda q: length(q) > 2 AND q NOT IN {listed(STOPWORDS)})"


def windows(tokens: str, n: int | str) -> str:
    return f"list_transform(range(1, greatest(len({tokens}) - {n} + 2, 1)), lambda w: array_to_string({tokens}[w : w + {n} - 1], ' '))"


def distinct_windows(tokens: str, n: int | str) -> str:
    return f"list_distinct({windows(tokens, n)})"


def copied(tokens: str, other: str, n: str) -> str:
    """Places (from 0) of tokens in runs of n that stand in other."""
    starts = f"list_filter(range(0, greatest(len({tokens}) - {n} + 1, 0)), lambda s: list_contains({windows(other, n)}, array_to_string({tokens}[s + 1 : s + {n}], ' ')))"
    return f"CASE WHEN {n} >= 2 AND len({other}) >= {n} THEN list_distinct(flatten(list_transform({starts}, lambda s: range(s, s + {n})))) ELSE [] END"


def hash_order(seed: int, key: str) -> str:
    return f"md5('{seed}|' || {key}::VARCHAR)"


def value_at(values: str, n: str, fraction: float) -> str:
    """The value at int(n * fraction) of a sorted list, at most the last."""
    return f"list_sort({values})[least(floor({n} * {fraction})::BIGINT, {n} - 1) + 1]"


def edges(source: str, count: str, bins: int = 8) -> str:
    """CTEs ``sorted_counts`` and ``edges`` of a source with a word count."""
    return (
        f"sorted_counts AS (SELECT list_sort(list({count})) AS v, count(*) AS n FROM {source}), "
        f"edges AS (SELECT DISTINCT unnest(list_transform(range(1, {bins}), lambda i: v[floor(n * i / {bins}.0)::BIGINT + 1])) AS edge FROM sorted_counts)"
    )


def first_sentences(x: str, n: int = 2) -> str:
    """Sentence ends get a mark, as RE2 has no lookbehind."""
    marked = rf"regexp_replace({strip(x)}, '([.!?])[{SPACE}]+', '\1' || chr(1), 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({marked}, chr(1))[1:{n}], lambda q: {strip('q')}), lambda q: q <> ''), ' ')"


def control_prompt(seed: str, style: str, language: str) -> str:
    style = f"CASE WHEN {style} IN ('poetic', 'standard') THEN {style} ELSE 'standard' END"
    language = f"CASE WHEN {language} IN ('es', 'en') THEN {language} ELSE 'es' END"
    told = f"CASE WHEN ({language}) = 'es' THEN '{instruction('es')}' ELSE '{instruction('en')}' END"
    nl = "chr(10)"
    return f"'<style:' || ({style}) || '> <lang:' || ({language}) || '> <task:continue>' || {nl} || ({told}) || {nl} || {nl} || 'Seed:' || {nl} || {strip(seed)} || {nl} || {nl} || '{CUE}'"


SEEDS = f"""{TEXTS}, stripped AS (SELECT sample_id, label, style, split, {strip("text")} AS t FROM texts),
firsts AS (SELECT *, {first_sentences("t")} AS s, {lines("t")} AS ls FROM stripped),
rests AS (SELECT *, CASE WHEN starts_with(t, s) THEN {strip("substring(t, length(s) + 1)")} ELSE '' END AS r FROM firsts),
seeds AS (SELECT sample_id, label, style, split, t,
  CASE WHEN r = '' AND len(ls) >= 2 THEN {strip("array_to_string(ls[1 : CASE WHEN len(ls) <= 3 THEN 1 ELSE 2 END], chr(10))")} ELSE s END AS seed,
  CASE WHEN r = '' AND len(ls) >= 2 THEN {strip("array_to_string(ls[CASE WHEN len(ls) <= 3 THEN 2 ELSE 3 END :], chr(10))")} ELSE r END AS continuation FROM rests)"""

#: Reward parts of each completion, with its prompt as seed.
REWARDS = f"""{TEXTS}, {COMPLETIONS},
toks AS (SELECT completion_id, run_id, pos, prompt, grpo_style_score AS prob, coalesce(grpo_completion, '') AS txt, {content_tokens("coalesce(grpo_completion, '')")} AS tt, {content_tokens("prompt")} AS st FROM completions),
reference AS (SELECT DISTINCT unnest({distinct_windows("ct", 8)}) AS gram FROM (SELECT {content_tokens("text")} AS ct FROM texts WHERE label = 1)),
grams AS (SELECT completion_id, unnest({distinct_windows("tt", 8)}) AS gram FROM toks),
copies AS (SELECT g.completion_id, count(r.gram) / count(*) AS ref FROM grams g LEFT JOIN reference r USING (gram) GROUP BY 1),
runs AS (SELECT *, least(2, len(st)) AS n2, least(4, len(st)) AS n4 FROM toks),
raws AS (SELECT r.*, coalesce(c.ref, 0.0) AS ref,
  greatest(0.0, 1 - abs(floor(length(txt) / 4.0) - 60) / 60.0) AS len_raw,
  least(1.0, len(list_filter(list_distinct(list_intersect(st, tt)), lambda q: NOT list_contains(list_transform({copied("tt", "st", "n2")}, lambda p: tt[p + 1]), q))) / 8.0) AS rel_raw,
  CASE WHEN len(tt) >= 4 THEN (len(tt) - 1 - len({distinct_windows("tt", 2)})) / (len(tt) - 1.0) ELSE 0.0 END AS rep_raw,
  CASE WHEN len(st) > 0 THEN greatest(0.0, len({copied("st", "tt", "n4")}) / len(st)::DOUBLE - 0.35) ELSE 0.0 END AS echo_raw,
  CASE WHEN prob IS NOT NULL THEN 1 / (1 + exp(-ln(least(greatest(prob, 1e-5), 1 - 1e-5) / (1 - least(greatest(prob, 1e-5), 1 - 1e-5))))) END AS style_raw
  FROM runs r LEFT JOIN copies c USING (completion_id)),
rewards AS (SELECT completion_id, run_id, pos, prompt, prob AS raw_style_prob, style_raw * 0.65 AS style_score, len_raw * 0.10 AS length_bonus, rel_raw * 0.20 AS prompt_relevance, rep_raw * 0.15 AS repetition_penalty, echo_raw * 0.10 AS prompt_echo_penalty, ref * 0.15 AS reference_copy_penalty,
  CASE WHEN prob IS NOT NULL THEN greatest(-1.0, least(1.0, style_raw * 0.65 + len_raw * 0.10 + rel_raw * 0.20 - rep_raw * 0.15 - echo_raw * 0.10 - ref * 0.15)) END AS total FROM raws)"""

#: Groups of stored breakdowns: contiguous runs of a prompt within a run.
GROUPS = f"""{COMPLETIONS},
b AS (SELECT completion_id, run_id, pos, substring(prompt, 1, 1) AS prompt, grpo_reward_breakdown.* FROM completions WHERE grpo_reward_breakdown IS NOT NULL),
marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR prompt IS DISTINCT FROM lag(prompt) OVER w THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
numbered AS (SELECT *, (sum(fresh) OVER (PARTITION BY run_id ORDER BY pos) - 1)::INT AS group_no FROM marked)"""
