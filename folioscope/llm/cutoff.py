"""Problem 5: text cut off by field limits or in transfer.

Each text is read once by a stack automaton that tells how it ends: with a
terminator, with a mark put after the end, with a sign of a cut, inside an
open quote, bracket or tag, in a broken character or escape, or just so. What
counts as a missing end is judged against the text's own lines, against its
source (limits show as lengths at which a source's texts pile up; a source
that never ends its sentences proves nothing) and against the words of the
corpus (parts of words, words that never end a sentence).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Texts of a source at its limit, at least and as a share of those near or
#: above half of it.
AT_LIMIT, AT_LIMIT_SHARE = 4, 0.25
#: A word is known from so many places; one that is found in MANY places and
#: ends a sentence or line in less than RARE_END of them does not end a text.
KNOWN, MANY, RARE_END = 2, 40, 0.01
#: The last word is part of a word if words that begin with it are so many
#: times as frequent as the word itself.
PART = 30
#: A source's texts of one length band (tenths of its longest text) are cut
#: if so many, and this share, show it by themselves.
BAND, BAND_SHARE = 8, 0.8
#: Unterminated share from which a source's missing terminators prove nothing.
LOOSE_SOURCE, LOOSE_LEAST = 0.5, 10

#: Endings are looked for in so many characters, or the whole last line if longer.
TAIL = 400
#: So few words after the last sentence are no unfinished sentence by themselves.
SHORT_TAIL = 3
#: A line of verse is shorter than this.
LINE = 80

_STOP = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+")
_LINKED = re.compile(r"[^.!?…]*https?://\S+[^.!?…]*[.!?…]\s*")
_INSIDE = re.compile(r"[.!?]\s+[\"'“«¿¡(]*[^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_AFTER = re.compile(r"\s*(?:[.!?…;:)»”\"]|\n)")
_LAST = re.compile(r"([^\W_]+(?:['’\-][^\W_]+)*)$")
_CLOSERS = "\"'”’»)]}›"
_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "‹": "›"}
# endings that are put after a text's end
_MARKS = re.compile(
    r"""(?:\s*(?:
        https?://\S+ | [#@]\w+ | \S+@\S+\.\w+ |           # links, tags, addresses
        [—–-]\s*\d+\s*[—–-] | \*{3,} | -{3,} | ={3,} | ~{3,} | \#{3,} |   # page numbers, rules
        P\.\s?[SD]\.[^\n]{0,60} | PS:[^\n]{0,60} |           # postscripts
        \(\d{1,4}\) | \[\d+\] | \[(?:fin|end|fine|ende|fim)\] | (?:FIN|THE\ END) |
        [←-⯿️‍\U0001f000-\U0001faff]+ )\s*)+$""",
    re.VERBOSE | re.IGNORECASE,
)
_SIGN = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|<\s*(?:\.\.\.|…)\s*>|\[(?:truncated|cut|continued|continúa|sigue)\]|\(cont\.?\))$", re.IGNORECASE)
_DOTS = re.compile(r"\s*(?:\.{3,}|…)$")
_BROKEN = re.compile(r"(?:�+|&#?\w{1,6}|%[0-9A-Fa-f]?|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|<[/a-zA-Z!][^<>]{0,60})$")
_TERMINATED = re.compile(r"[.!?。！？:][\"'”’»)\]}›\s]*$")
_BREAK = re.compile(r"\n|\r|\u2028|\u2029|\x85")


ENDING_FIELDS = "n_chars int, n_bytes int, state string, word string, verse boolean, styled boolean, unclosed boolean"


@dataclass
class Ending:
    """How a text ends: ``state`` is terminated, mark, sign, dots, broken, open,
    tail (open within few words) or empty; ``word`` its last word, lower case."""

    state: str
    word: str
    verse: bool
    styled: bool
    unclosed: bool
    lines: int


def unclosed(text: str) -> bool:
    """Whether a bracket, a paired quote or a tag is open at the end. Closers
    without opener are skipped; a line break closes nothing."""
    stack: list[str] = []
    tags: list[str] = []
    for m in re.finditer(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>|[()\[\]{}“”«»‹›]", text):
        c = m.group()
        if m.group(2):
            if m.group(1):
                if m.group(2) in tags:
                    del tags[tags.index(m.group(2)) :]
            elif not m.group(3) and m.group(2).lower() not in ("br", "hr", "img", "p", "li"):
                tags.append(m.group(2))
        elif c in _PAIRS:
            stack.append(_PAIRS[c])
        elif c in stack:
            while stack.pop() != c:
                pass
    return bool(stack or tags)


def ending(text: str) -> Ending:
    body = text.rstrip()
    if not body:
        return Ending("empty", "", False, False, False, 0)
    lines = [x.strip() for x in _BREAK.split(body) if x.strip()]
    # judged by the last lines: a text may begin otherwise
    near = lines[-4:-1]
    loose = sum(len(x) < LINE and x[-1] not in ".!?" and not _INSIDE.search(x) for x in near)
    last = _STOP.split(_LINKED.sub("", lines[-1]) if "http" in lines[-1] else lines[-1])[-1]
    verse = loose * 2 > len(near) and len(last) < LINE
    # a text of verse throughout that ends lines with signs would end the last with one
    styled = verse and len(lines) > 1 and all(len(x) < LINE and not _INSIDE.search(x) for x in lines) and sum(x[-1] in ".!?" for x in lines[:-1]) * 3 < len(lines) and any(x[-1] in ",;:…" for x in lines[:-1])
    is_open = unclosed(body)
    # what stands at the end is looked for from the last long line on
    whole, body = body, body[max(0, len(body) - TAIL) :] if len(lines[-1]) < TAIL else lines[-1]
    core, state = body, "open"
    if m := _SIGN.search(body):
        core, state = body[: m.start()], "sign"
    elif _BROKEN.search(body) and not _TERMINATED.search(body):
        core, state = body[: _BROKEN.search(body).start()], "broken"
        if not core.endswith("�") and body[len(core)] == "&" and ";" in body[len(core) :]:
            state = "open"
    elif body[-1] not in ".!?" and (m := _MARKS.search(body)):
        core, state = body[: m.start()], "mark"
    elif re.search(r"(?:^|\s)[—–-]\s*[^\W\d_][^\n]{1,40}$", body) and re.search(r"\n[—–-]\s*[^\W\d_][^\n.!?]{1,40}$", body):
        state = "mark"  # a signature on a line of its own
    elif m := _DOTS.search(body.rstrip(_CLOSERS + " ")):
        core, state = body[: m.start()], "dots"
    elif _TERMINATED.search(body):
        state = "terminated"
    elif body[-1] in _CLOSERS:
        state = "mark"
    if state == "open" and not verse and len(last.split()) <= SHORT_TAIL and _STOP.search(whole):
        state = "tail"
    # longer words than this are not looked up
    found = _LAST.search(core.rstrip(_CLOSERS + ".!?…,;: ")[-100:])
    return Ending(state, found.group(1).lower() if found and len(found.group(1)) <= 60 else "", verse, styled, is_open, len(lines))


def read_endings(records: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, origin, ...) with how each record ends; a record that
    is delivered several times counts once."""
    kinds = dict(records.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            ends = [ending(t) for t in texts]
            columns = [[len(t) for t in texts], [len(t.encode("utf-8", "surrogatepass")) for t in texts], *([getattr(e, f) for e in ends] for f in ("state", "word", "verse", "styled", "unclosed"))]
            types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["rec_kind", "rec_id", "origin", *(f.split()[0] for f in ENDING_FIELDS.split(", "))])

    rows = records.select("rec_kind", "rec_id", "origin", "text").filter("text is not null")
    ends = rows.mapInArrow(run, f"rec_kind string, rec_id {kinds['rec_id']}, origin string, {ENDING_FIELDS}")
    columns = [c for c in ends.columns if c not in ("rec_kind", "rec_id")]
    return ends.groupBy("rec_kind", "rec_id").agg(F.max(F.struct(*columns)).alias("r")).select("rec_kind", "rec_id", "r.*")


def count_words(records: DataFrame) -> DataFrame:
    """(word, n, n_end) over all texts but for each text's last word: places,
    and places before a sentence end, closing sign or line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter[str] = Counter()
            n_end: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                before = None
                for m in _WORD.finditer(text):
                    if before:
                        word = before.group().lower()[:60]
                        n[word] += 1
                        if _AFTER.match(text, before.end()):
                            n_end[word] += 1
                    before = m
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([n_end[w] for w in n], pa.int64())], names=["word", "n", "n_end"])

    return records.select("text").filter("text is not null").mapInArrow(run, "word string, n long, n_end long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"))


def judge_words(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(word, partial, dangling) for the distinct words asked."""
    starts = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))
    longer = words.filter((F.length("word") > 1) & (F.col("n") >= KNOWN)).select(F.explode(starts).alias("word"), "n").join(asked, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n_longer"))
    known = asked.join(words, "word", "left").join(longer, "word", "left").select("word", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "n_end", "n_longer")))
    number = F.col("word").rlike(r"^\d+$")
    partial = ~number & (F.col("n_longer") >= KNOWN) & (F.col("n_longer") >= PART * F.col("n"))
    dangling = ((F.col("n") >= MANY) & (F.col("n_end") < RARE_END * F.col("n"))) | F.col("word").rlike(r"^\p{L}$")
    return known.select("word", partial.alias("partial"), (dangling & ~number).alias("dangling"))


def hard_limits(ends: DataFrame, unit: str) -> DataFrame:
    """(rec_kind, origin, limit) of the sources whose longest texts, in
    ``unit``, are many of exactly one length."""
    lengths = ends.filter("origin is not null").groupBy("rec_kind", "origin", unit).agg(F.count(F.lit(1)).alias("n"))
    longest = lengths.groupBy("rec_kind", "origin").agg(F.max(unit).alias("limit"), F.max_by("n", unit).alias("at"))
    half = lengths.join(longest, ["rec_kind", "origin"]).filter(F.col(unit) * 2 >= F.col("limit")).groupBy("rec_kind", "origin", "limit", "at").agg(F.sum("n").alias("half"))
    return half.filter((F.col("at") >= AT_LIMIT) & (F.col("at") >= AT_LIMIT_SHARE * F.col("half"))).select("rec_kind", "origin", "limit")


def cut_records(records: DataFrame) -> DataFrame:
    """``rec_kind, rec_id, origin, cut, reason`` of every record with a text,
    from (rec_kind, rec_id, origin, text); ``origin`` is the source whose
    baseline counts, null for none.

    A record is cut if it ends in a sign of a cut or a broken character or
    escape; in part of a word or a word that does not end sentences, also
    before dots; at its source's limit; without a terminator in prose, unless
    its source leaves them out; in verse, without the sign that its lines end
    in, with something open, or in a length band in which its source, if it
    has no exact limit, cuts its texts. Endings put after the end (links, tags, emoji, page numbers,
    rules, years, signatures) show that the text is whole. Null, empty and
    blank texts are not cut.
    """
    ends = cut_lineage(read_endings(records))
    asked = ends.filter(F.col("state").isin("open", "tail", "dots") & (F.col("word") != "")).select("word").distinct()
    judged = judge_words(asked, cut_lineage(count_words(records)))
    rows = ends.join(judged, "word", "left")
    for unit, slack in (("n_chars", 0), ("n_bytes", 3)):
        limit = hard_limits(ends, unit).withColumnRenamed("limit", f"{unit}_limit")
        # bytes may stop up to three short of the limit, before a character that does not fit
        rows = rows.join(limit, ["rec_kind", "origin"], "left").withColumn(f"{unit}_at", F.coalesce(F.col(unit) >= F.col(f"{unit}_limit") - slack, F.lit(False)))
        rows = rows.withColumn(f"{unit}_full", F.coalesce(F.col(unit) == F.col(f"{unit}_limit"), F.lit(False)))
    partial, dangling = F.coalesce("partial", F.lit(False)), F.coalesce("dangling", F.lit(False))
    at, full = F.col("n_chars_at") | F.col("n_bytes_at"), F.col("n_chars_full") | F.col("n_bytes_full")
    state = F.col("state")
    prose_open = (state == "open") & ~F.col("verse")
    first = (
        F.when(state.isin("sign", "broken"), state)
        .when(state.isin("open", "tail", "dots") & partial, F.lit("part of a word"))
        .when(state.isin("open", "tail", "dots") & dangling, F.lit("inside a phrase"))
        .when(state.isin("open", "tail", "dots") & at, F.lit("limit of the source"))
        .when((state == "terminated") & full, F.lit("limit of the source"))
        .when(prose_open, F.lit("no terminator"))
    )
    rows = cut_lineage(rows.select("rec_kind", "rec_id", "origin", "n_chars", "state", "verse", "styled", "unclosed", first.alias("first"), F.coalesce("n_chars_limit", "n_bytes_limit").isNotNull().alias("limited")))
    longest = rows.groupBy("rec_kind", "origin").agg(F.max("n_chars").alias("longest"), F.count_if(~F.col("verse")).alias("prose"), F.count_if(F.col("first") == "no terminator").alias("loose"))
    longest = longest.filter("origin is not null").withColumn("is_loose", (F.col("prose") >= LOOSE_LEAST) & (F.col("loose") >= LOOSE_SOURCE * F.col("prose")))
    banded = rows.join(longest.select("rec_kind", "origin", "longest", "is_loose"), ["rec_kind", "origin"], "left").withColumn("band", F.floor(F.col("n_chars") * 10 / (F.col("longest") + 1)).cast("int"))
    shown = F.col("first").isNotNull() & (F.col("state") != "terminated")
    counted = banded.filter(F.col("origin").isNotNull() & ~F.col("limited") & (shown | ~(F.col("verse") & (F.col("state") == "open")))).groupBy("rec_kind", "origin", "band")
    bands = counted.agg(F.count(F.lit(1)).alias("n"), F.count_if(shown).alias("c")).filter((F.col("c") >= BAND) & (F.col("c") >= BAND_SHARE * F.col("n"))).select("rec_kind", "origin", "band", F.lit(True).alias("cut_band"))
    rows = banded.join(bands, ["rec_kind", "origin", "band"], "left")
    in_band = F.coalesce("cut_band", F.lit(False))
    open_verse = (F.col("state") == "open") & F.col("verse")
    reason = (
        F.when((F.col("first") == "no terminator") & F.coalesce("is_loose", F.lit(False)) & ~F.col("unclosed") & ~in_band, F.lit(None))
        .when(F.col("first").isNotNull(), F.col("first"))
        .when(open_verse & F.col("styled"), F.lit("no sign at the end of the verse"))
        .when(open_verse & F.col("unclosed"), F.lit("something left open"))
        .when(F.col("state").isin("open", "tail") & in_band, F.lit("length band of the source"))
    )
    return rows.select("rec_kind", "rec_id", "origin", reason.isNotNull().alias("cut"), reason.alias("reason"))


def cut_rates(cut: DataFrame) -> DataFrame:
    """``rec_kind, origin, n_records, n_cut, rate``: how often each source cuts."""
    return cut.groupBy("rec_kind", "origin").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("cut").alias("n_cut")).withColumn("rate", F.round(F.col("n_cut") / F.col("n_records"), 6))
