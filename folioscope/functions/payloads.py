"""Chat payloads, prompt lists, class probabilities and other small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: Requests that ask a model to say a text again; the model itself is out of scope.
REPHRASE = [
    "Rewrite the following text in a plain, neutral style:",
    "Say the same in other words, without any personal style:",
    "Reescribe el siguiente texto con un estilo neutro:",
]


def payload_text(payload: Column) -> Column:
    """The text of a chat payload in JSON: a list of messages gives the first
    one's content, an object its content, a JSON string itself; anything else
    is taken as plain text. Null stays null."""
    first = F.get_json_object(payload, "$[0].content")
    single = F.get_json_object(payload, "$.content")
    quoted = F.when(strip(payload).startswith('"'), F.from_json(F.concat(F.lit("["), payload, F.lit("]")), "array<string>")[0])
    return F.coalesce(first, single, quoted, payload)


def or_placeholder(text: Column, placeholder: str = "empty") -> Column:
    """Blank and null completions become the placeholder."""
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", placeholder).otherwise(text)


def rephrase_request(text: Column, variant: Column) -> Column:
    """A request by variant number (from 0, taken round), followed by the text."""
    chosen = F.element_at(F.array(*(F.lit(x) for x in REPHRASE)), (F.pmod(variant, F.lit(len(REPHRASE))) + 1).cast("int"))
    return F.concat(chosen, F.lit("\n\n"), text)


def opening_sentence(text: Column, least: int = 10, most: int = 200) -> Column:
    """The text up to its first sentence sign, where it is longer than ``least``
    and shorter than ``most`` characters; else null."""
    found = strip(F.regexp_extract(strip(text), r"(?s)^(.+?[.!?])(?=\s|$)", 1))
    return F.when((F.length(found) > least) & (F.length(found) < most), found)


def second_class_probability(logits: Column) -> Column:
    """Softmax of two logits, the second class's share."""
    return 1 / (1 + F.exp(F.get(logits, 0) - F.get(logits, 1)))


def fit_prompts(prompts: DataFrame, pos: str, expected: int) -> DataFrame:
    """Prompts brought to ``expected`` rows: as they are, one for all, each
    repeated alike where they divide it, else the first ones. ``pos`` counts
    from 0 without gaps."""
    n = prompts.count()
    if n == 0 or n == expected:
        return prompts
    each = expected // n if expected % n == 0 else 1
    rows = prompts.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).withColumn(pos, F.col(pos) * each + F.col("__k")).drop("__k")
    return rows.filter(F.col(pos) < expected)


def zip_by_position(left: DataFrame, right: DataFrame, pos: str) -> DataFrame:
    """Rows of both sides with the same position; positions of only one side
    drop out, as with lists of unequal length."""
    return left.join(right, pos)
