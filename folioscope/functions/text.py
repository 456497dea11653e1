"""Text expressions: cleaning, words, lines, form and language.

White space and line breaks follow the Unicode sets that Python's ``str``
methods use; Java's ``\\s`` alone would miss most of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line breaks of Python's str.split and splitlines.
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

MAX_LENGTH = 2048
KEEP_WORD_FROM = 0.8
VERSE_LINES = 3

# Hint words of the two languages of the corpus.
ES_HINTS = ["de", "la", "que", "el", "en", "y", "los", "para", "con", "como", "pero", "porque", "una", "del"]
EN_HINTS = ["the", "and", "that", "with", "for", "you", "this", "have", "from", "they", "your", "into", "about", "because"]
# Function words of the length report, another set on purpose.
ES_MARKERS = ["de", "la", "el", "que", "y", "en", "los", "un", "una", "para", "con", "por", "es"]
EN_MARKERS = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "on", "a"]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used: a
    repeated expression would be evaluated at each place, in lambdas even for
    each element."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    """Words between Unicode white space; 0 for an empty text."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def remove_urls(text: Column) -> Column:
    return F.when(text.contains("http"), F.regexp_replace(text, f"https?://[^{SPACE}]+", "")).otherwise(text)


def remove_emails(text: Column) -> Column:
    # the pattern tries every character as a start: only texts that can match pay for it
    return F.when(text.contains("@"), F.regexp_replace(text, rf"[^{SPACE}]+@[^{SPACE}]+\.[^{SPACE}]+", "")).otherwise(text)


def normalize_space(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def collapse_punctuation(text: Column) -> Column:
    """Three or more of ``!?.`` become the last of them, twice."""
    return F.regexp_replace(text, r"([!?.]){3,}", "$1$1")


def truncate(text: Column, limit: int = MAX_LENGTH, share: float = KEEP_WORD_FROM) -> Column:
    """At most ``limit`` characters, ending before the last space if that lies
    beyond ``share`` of the limit."""

    def cut(head: Column) -> Column:
        space = F.lit(limit) - F.instr(F.reverse(head), " ")
        return F.when(head.contains(" ") & (space > limit * share), F.substring(head, F.lit(1), space)).otherwise(head)

    return bind(text, lambda t: F.when(F.length(t) > limit, bind(F.substring(t, 1, limit), cut)).otherwise(t))


def clean(text: Column, urls: bool = True, emails: bool = True, spaces: bool = True, limit: int = MAX_LENGTH) -> Column:
    """The cleaning steps in their fixed order; null stays null."""
    if urls:
        text = bind(text, remove_urls)
    if emails:
        text = bind(text, remove_emails)
    if spaces:
        text = normalize_space(text)
    return truncate(collapse_punctuation(text), limit)


def is_verse(text: Column, lines: int = VERSE_LINES) -> Column:
    """At least ``lines`` lines that are not blank."""
    full = F.filter(F.split(text, LINE_BREAK), lambda x: F.regexp_count(x, F.lit(f"[^{SPACE}]")) > 0)
    return F.size(full) >= lines


def infer_language(text: Column) -> Column:
    """``en`` if English hints outnumber Spanish ones (an accent or inverted
    sign counts as two), else ``es``; other languages fall to either."""

    def judge(low: Column) -> Column:
        tokens = F.regexp_extract_all(low, F.lit("([a-zA-Záéíóúñü]+)"), F.lit(1))
        accent = F.when(low.rlike("[áéíóúñ¿¡]"), 2).otherwise(0)
        score = lambda t: F.when(t.isin(EN_HINTS), 1).when(t.isin(ES_HINTS), -1).otherwise(0)
        lead = F.aggregate(tokens, F.lit(0), lambda total, t: total + score(t))
        return F.when(lead > accent, "en").otherwise("es")

    return bind(F.lower(text), judge)


def detect_language(text: Column) -> Column:
    """By function words alone, punctuation at word ends aside; ties are Spanish."""
    tokens = F.transform(word_list(text), lambda w: F.lower(F.regexp_replace(w, r"""^[.,;:!?¿¡"'()]+|[.,;:!?¿¡"'()]+$""", "")))
    count = lambda t: F.when(t.isin(ES_MARKERS), 1).otherwise(0) - F.when(t.isin(EN_MARKERS), 1).otherwise(0)
    lead = F.aggregate(tokens, F.lit(0), lambda total, t: total + count(t))
    return F.when(lead >= 0, "es").otherwise("en")


def display(text: Column, width: int = 80) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def shuffled_sentences(text: Column, seed: int = 42, variant: Column | None = None) -> Column:
    """Sentences in an order that depends on the seed and the number of the
    ``variant`` (0 by default) only; a text of one sentence has its words turned
    round at the middle, in every variant. Null stays null."""
    variant = F.lit(0) if variant is None else variant
    sentences = F.filter(F.split(strip(text), rf"(?<=[.!?])[{SPACE}]+"), lambda s: s != "")
    keyed = F.transform(sentences, lambda s, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), variant, i, s)).alias("k"), s.alias("s")))
    mixed = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), " ")

    def turned(words: Column) -> Column:
        half = F.floor(F.size(words) / 2).cast("int")
        return F.array_join(F.concat(F.slice(words, half + 1, F.size(words)), F.slice(words, F.lit(1), half)), " ")

    return F.when(F.size(sentences) > 1, mixed).otherwise(bind(word_list(text), turned))
