"""Problem 4: the language of texts and of their segments.

Rank-order profiles: a profile is the list of a language's most frequent
character n-grams; a stretch of text is compared by how far its own most
frequent n-grams stand from their place in each profile (out-of-place
distance). Texts are cut into sentences; neighbouring sentences support each
other, so that a change of language needs evidence of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, shuffle_width
from .labels import LANGUAGES, language_code

CODES = list(LANGUAGES)
#: n-grams of 1 to this many characters; ranks kept per profile.
LONGEST = 4
PROFILE = 600
#: n-grams of a sentence that are compared, the most frequent first.
COMPARED = 300
#: Distinct texts per language at most that profiles are fitted on, taken by hash.
SAMPLE_PER_LANGUAGE = 4000
#: A sentence has at least this many words.
SENTENCE_WORDS = 4
#: Weight of the distance per n-gram against the price of a change of language.
SHARPNESS = 1.0
SWITCH = 5.0
#: Price of beginning in another language than the label says.
AGAINST_LABEL = 3.0
#: Times the profiles are fitted again, on the languages that they gave the
#: sampled rows, so that wrong labels lose their weight.
REFITS = 2

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_NOISE = re.compile(r"https?://\S+|www\.\S+|\S+@\S+|[#@]\w+")
_BREAK = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s|$)|\n+|[。！？])")


@lru_cache(maxsize=100_000)
def word_grams(word: str) -> tuple[str, ...]:
    padded = f"_{word}_"
    return tuple(padded[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1) if n > 1 or padded[i] != "_")


def grams(words: list[str]) -> Counter[str]:
    return Counter(chain.from_iterable(map(word_grams, words)))


def content_words(text: str) -> tuple[list[str], int]:
    """Lower-case words, without addresses, tags and capitalised names inside
    a sentence (they say nothing of the language), and the number of all words."""
    words = _WORD.findall(_NOISE.sub(" ", text))
    found = [w.lower().replace("’", "'") for i, w in enumerate(words) if i == 0 or not w[0].isupper() or w.isupper()]
    return found, len(words)


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches between sentence ends and line ends."""
    spans, at = [], 0
    for m in _BREAK.finditer(text):
        if text[at : m.end()].strip():
            spans.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        spans.append((at, len(text)))
    return spans


class Profiles:
    def __init__(self, ranks: dict[str, list[str]]) -> None:
        self.codes = [c for c in CODES if ranks.get(c)]
        self.places: dict[str, list[int]] = {}
        for k, code in enumerate(self.codes):
            for r, g in enumerate(ranks[code][:PROFILE]):
                self.places.setdefault(g, [PROFILE] * len(self.codes))[k] = r
        self.row = {g: i for i, g in enumerate(self.places, 1)}
        # row 0 is for n-grams that no profile has
        self.table = np.array([[PROFILE] * len(self.codes), *self.places.values()], np.int64).reshape(-1, max(len(self.codes), 1))
        self.distances = lru_cache(maxsize=20_000)(self._distances)

    def ranks(self) -> dict[str, list[str]]:
        order: list[list[tuple[int, str]]] = [[] for _ in self.codes]
        for gram, places in self.places.items():
            for k, r in enumerate(places):
                if r < PROFILE:
                    order[k].append((r, gram))
        return {code: [g for _, g in sorted(rows)] for code, rows in zip(self.codes, order, strict=True)}

    def _distances(self, words: tuple[str, ...]) -> tuple[int, tuple[float, ...]]:
        """Number of compared n-grams, and per language the mean out-of-place
        distance in units of the profile's length."""
        counts = grams(list(words))
        top = sorted(counts, key=lambda g: (-counts[g], g))[:COMPARED]
        n = max(len(top), 1)
        places = self.table[[self.row.get(g, 0) for g in top]]
        own = (np.arange(len(top)) * (PROFILE / n)).astype(np.int64)[:, None]
        distance = np.where(places == PROFILE, PROFILE, np.abs(places - own))
        return len(top), tuple((distance.sum(axis=0) / n / PROFILE).tolist())

    def label(self, text: str, known: str | None = None) -> list[tuple[int, int, str, float, int]]:
        """(start, end, language, confidence, words) of each sentence, the most
        likely sequence with a price for each change; stretches without a word
        are left out. The confidence is the share of the best language if the
        distances are read as log odds. ``known`` is the text's label, which
        counts a little."""
        spans, costs = [], []
        for a, b in sentences(text) if self.codes else []:
            words, n_words = content_words(text[a:b])
            if not words:
                continue
            n, d = self.distances(tuple(words))
            spans.append((a, b, n_words))
            costs.append([SHARPNESS * n * x for x in d])
        if not spans:
            return []
        prior = AGAINST_LABEL if known in self.codes else 0.0
        best, back = [x + prior * (c != known) for x, c in zip(costs[0], self.codes, strict=True)], []
        for row in costs[1:]:
            low = min(range(len(best)), key=best.__getitem__)
            came = [k if best[k] <= best[low] + SWITCH else low for k in range(len(best))]
            back.append(came)
            best = [row[k] + min(best[k], best[low] + SWITCH) for k in range(len(best))]
        k = min(range(len(best)), key=best.__getitem__)
        path = [k]
        for came in reversed(back):
            path.append(k := came[k])
        path.reverse()
        out = []
        for (a, b, w), row, k in zip(spans, costs, path, strict=True):
            odds = sum(math.exp(max(-50.0, min(50.0, row[k] - x))) for x in row)
            out.append((a, b, self.codes[k], 1 / odds, w))
        return out

    def main(self, text: str | None, known: str | None = None) -> tuple[str | None, float]:
        """The language with the most words, and its confidence: the mean of
        its sentences', by words, times its share of the text."""
        weight: Counter[str] = Counter()
        sure: Counter[str] = Counter()
        for _, _, code, confidence, words in self.label(text or "", known):
            weight[code] += words
            sure[code] += words * confidence
        if not weight:
            return None, 0.0
        code = max(weight, key=lambda c: (weight[c], c))
        return code, sure[code] / sum(weight.values())


def _count_grams(sample: DataFrame, profiles: Profiles | None) -> dict[str, list[str]]:
    """The most frequent n-grams of each language in (text, code); with
    profiles the language is theirs, not the label's."""
    ranks = profiles and profiles.ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Profiles(ranks) if ranks else None
        counts: dict[str, Counter[str]] = {}
        for batch in batches:
            for text, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if judge:
                    for a, b, lang, _, _ in judge.label(text):
                        counts.setdefault(lang, Counter()).update(grams(content_words(text[a:b])[0]))
                else:
                    for a, b in sentences(text):
                        counts.setdefault(code, Counter()).update(grams(content_words(text[a:b])[0]))
        rows = [(c, g, n) for c, found in counts.items() for g, n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["code", "gram", "n"])

    counted = sample.mapInArrow(run, "code string, gram string, n long").groupBy("code", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= PROFILE)
    found: dict[str, list[tuple[int, str]]] = {}
    for r in top.collect():  # languages x PROFILE rows
        found.setdefault(r["code"], []).append((r["r"], r["gram"]))
    return {code: [g for _, g in sorted(rows)] for code, rows in found.items()}


def fit_profiles(labelled: DataFrame, text_col: str, label_col: str, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[str]]:
    """Profiles of the languages that the labels name, from at most about
    ``per_language`` distinct texts each, taken by a hash of the text. Rows without text
    or label are not used."""
    rows = labelled.select(F.col(text_col).alias("text"), language_code(F.col(label_col)).alias("code")).filter("text is not null and code is not null")
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").agg(F.count_distinct(F.xxhash64("text")).alias("count")).collect()}
    if not counts:
        return {}
    part = F.create_map(*(F.lit(x) for code, n in counts.items() for x in (code, min(1.0, per_language / n))))
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.try_element_at(part, F.col("code")) * 1_000_000)
    sample = cut_lineage(sample.dropDuplicates(["text", "code"]).repartition(shuffle_width(rows.sparkSession)))
    ranks = _count_grams(sample, None)
    for _ in range(REFITS):
        # a language that no row is found to have keeps its profile
        ranks |= _count_grams(sample, Profiles(ranks))
    return ranks


def language_segments(df: DataFrame, keys: list[str], text_col: str, label_col: str, ranks: dict[str, list[str]]) -> DataFrame:
    """``keys, label, segment, start_pos, end_pos, lang, confidence, sentences``:
    neighbouring sentences of one language are one segment, numbered from 0;
    ``label`` is the language that the label names, ``sentences`` counts those
    of at least ``SENTENCE_WORDS`` words. A segment's confidence is the mean of
    its sentences', by words.

    A text without a word (null, empty, signs only) has one row without
    language, with confidence 0. Repeated rows are labelled each.
    """
    profiles = df.sparkSession.sparkContext.broadcast(ranks)  # languages x PROFILE n-grams
    kinds = dict(df.dtypes)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Profiles(profiles.value)
        for batch in batches:
            rows, found = [], []
            for row, (text, label) in enumerate(zip(batch.column(n_keys).to_pylist(), batch.column(n_keys + 1).to_pylist(), strict=True)):
                segments: list[list] = []
                for a, b, lang, confidence, words in judge.label(text or "", label):
                    if not segments or segments[-1][3] != lang:
                        segments.append([len(segments), a, b, lang, 0.0, 0, 0])
                    last = segments[-1]
                    last[2] = b
                    last[4] += confidence * words
                    last[5] += words >= SENTENCE_WORDS
                    last[6] += words
                for s in segments or [[0, 0, len(text or ""), None, 0.0, 0, 1]]:
                    rows.append(row)
                    found.append((*s[:4], s[4] / s[6], s[5]))
            index = pa.array(rows, pa.int32())
            columns = list(zip(*found, strict=True)) or [()] * 6
            kinds_out = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(index) for i in range(n_keys)), batch.column(n_keys + 1).take(index), *(pa.array(c, t) for c, t in zip(columns, kinds_out, strict=True))],
                names=[*keys, "label", "segment", "start_pos", "end_pos", "lang", "confidence", "sentences"],
            )

    rows = df.select(*keys, F.col(text_col).alias("__text"), language_code(F.col(label_col)).alias("__label"))
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.mapInArrow(run, f"{fields}, label string, segment int, start_pos int, end_pos int, lang string, confidence double, sentences int")


def text_languages(segments: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lang, confidence, n_languages``: the language that most
    characters of a text are in (the first by code of equals), its confidence
    over the whole text, and in how many languages there are sentences."""
    size = F.col("end_pos") - F.col("start_pos")
    by_lang = segments.groupBy(*keys, "lang").agg(F.sum(size).alias("chars"), F.sum(size * F.col("confidence")).alias("sure"), F.sum("sentences").alias("sentences"))
    best = F.max_by(F.struct("lang", "sure"), F.struct("chars", "lang")).alias("best")
    total = by_lang.groupBy(*keys).agg(best, F.sum("chars").alias("chars"), F.count_if(F.col("lang").isNotNull() & (F.col("sentences") > 0)).alias("n_languages"))
    return total.select(*keys, F.col("best.lang").alias("lang"), F.round(F.coalesce(F.try_divide("best.sure", "chars"), F.lit(0.0)), 6).alias("confidence"), "n_languages")


def unnamed_languages(segments: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lang``: languages of which a text has at least one sentence and
    which its label does not name."""
    named: Column = F.col("label").eqNullSafe(F.col("lang"))
    return segments.filter((F.col("sentences") > 0) & F.col("lang").isNotNull() & ~named).select(*keys, "lang").distinct()
