"""Problem 9: text read in a wrong character encoding.

A garbling is a chain: text written in one encoding and read in another, once
or twice. A multinomial classifier over hashed byte bigrams tells which chain
a word went through; it is trained on clean words of the corpus, garbled here
by every chain. The predicted chain is inverted, and the inversion must decode
strictly and give a word that the classifier takes for clean.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bits of the hash of a byte bigram.
HASH_BITS = 14
#: The classifier is fitted on at most about so many texts, taken by hash.
SAMPLE_TEXTS = 6000
#: Words whose readings a worker remembers.
MEMO = 100_000
#: Log odds lost by each character of a word that a chain leaves as it was.
RESIDUE = 5.0
#: Distinct words kept of the sample.
MAX_WORDS = 300_000
#: Share of words that are taken to be garbled before looking.
PRIOR = 0.002
#: Log odds that a text's words must reach together against all being clean.
EVIDENCE = 3.0
#: How much rarer a question mark between letters is than one after a word.
INNER_MARK = 0.01
CLEAN = "clean"
LOST = "lost"

# Single-byte encodings that texts are mistaken for, and those
# that texts are written in.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251"]
CHAINS = (
    {f"utf-8>{r}": [("utf-8", r)] for r in READ_AS}
    | {f"utf-8>{r} twice": [("utf-8", r), ("utf-8", r)] for r in ("cp1252", "latin-1")}
    | {f"cp1252>{r}": [("cp1252", r)] for r in ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "latin-1")}
    | {f"{w}>cp1252": [(w, "cp1252")] for w in ("mac_roman", "cp850")}
)
_WORD = re.compile(r"[^ \t\r\n]*[^\x00-\x7f \t\r\n][^ \t\r\n]*")
_SPACE = re.compile(r"[ \t\r\n]+")
_RUN = re.compile(r"[^\x00-\x7f]+")
_MARKED = re.compile(r"[a-z?'-]+")


@lru_cache(maxsize=None)
def _table(encoding: str) -> tuple[list[str], dict[str, int]]:
    """Characters of a single-byte encoding and back; bytes without one stand
    for the control character of the same number, as readers do."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back: dict[str, int] = {}
    for b, c in enumerate(chars):
        back.setdefault(c, b)
    return chars, back


def _encode(text: str, encoding: str) -> bytes | None:
    if encoding == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    back = _table(encoding)[1]
    try:
        return bytes(back[c] for c in text)
    except KeyError:
        return None


def _decode(raw: bytes, encoding: str) -> str | None:
    if encoding == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    chars = _table(encoding)[0]
    return "".join(chars[b] for b in raw)


def garble(text: str, chain: str) -> str | None:
    for written, read in CHAINS[chain]:
        raw = _encode(text, written)
        if raw is None:
            return None
        text = _decode(raw, read)
    return text


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, or None where it can't have gone through it."""
    for written, read in reversed(CHAINS[chain]):
        raw = _encode(text, read)
        if raw is None or (text := _decode(raw, written)) is None:
            return None
    return text


def _undo(text: str, written: str, read: str) -> tuple[str, int, int]:
    """One step back wherever it is possible, and the numbers of characters
    restored and of those above 127 left, in one pass: what can't have come
    from the step stays."""
    back = _table(read)[1]
    out: list[str] = []
    done = left = i = 0
    while i < len(text):
        c = text[i]
        byte = back.get(c) if c > "\x7f" else None
        size = 1
        if byte is not None:
            if written == "utf-8":
                size = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if 0xF0 <= byte < 0xF5 else 0
                raw = [back.get(x, 0) for x in text[i : i + size]]
                made = _decode(bytes(raw), "utf-8") if size and len(raw) == size else None
            else:
                made = _table(written)[0][byte]
            if made is not None and made != text[i : i + size]:
                out.append(made)
                done += 1
                i += size
                continue
        out.append(c)
        left += c > "\x7f"
        i += 1
    return "".join(out), done, left


def _invert_runs(word: str, chain: str) -> tuple[str | None, int]:
    """The word with every stretch inverted that can be, and the characters
    above 127 that could not; None if there is nothing to invert."""
    most = 0
    for written, read in reversed(CHAINS[chain]):
        word, done, left = _undo(word, written, read)
        most = max(most, left)
        if not done:
            return None, left
    return word, most


def bigrams(word: str) -> tuple[int, ...]:
    return _short_bigrams(word) if len(word) <= 100 else _bigrams(word)


def _bigrams(word: str) -> tuple[int, ...]:
    """Hashed byte bigrams of the word with a space on both sides, each with
    the byte class two on, that touch a byte above 127."""
    raw = b" " + word.encode("utf-8", "surrogatepass") + b" "
    kinds = bytes(0 if b > 127 else 1 if 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 for b in raw)
    out = []
    for i in range(len(raw) - 1):
        if raw[i] > 127 or raw[i + 1] > 127:
            out.append(xxhash.xxh3_64_intdigest(raw[i : i + 2]) >> (64 - HASH_BITS))
            out.append(xxhash.xxh3_64_intdigest(raw[i : i + 2] + bytes([kinds[i - 1] if i else 3, kinds[min(i + 2, len(raw) - 1)], 7])) >> (64 - HASH_BITS))
    return tuple(out)


_short_bigrams = lru_cache(maxsize=100_000)(_bigrams)


def lexical_key(word: str) -> str:
    """The word in lower case without punctuation at its ends; a word of
    punctuation only stands as it is."""
    a, b = 0, len(word)
    while a < b and unicodedata.category(word[a])[0] == "P":
        a += 1
    while a < b and unicodedata.category(word[b - 1])[0] == "P":
        b -= 1
    return word[a:b].lower() or word


def marked_word(word: str) -> str | None:
    """A word of ASCII letters and question marks in lower case, without other
    punctuation at its ends, or at least three question marks that stand alone;
    None for other words."""
    if len(word) > 2 and not word.strip("?"):
        return word
    core = word.strip("!\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~").lower()
    return core if "?" in core and _MARKED.fullmatch(core) and any("a" <= c <= "z" for c in core) else None


def fillings(core: str) -> tuple[list[str], list[str], list[str]]:
    """What may have been lost in a :func:`marked_word`, what it is if nothing
    was, and what lost sign it shows by its place: its forms with any of the
    question marks at its ends set aside, the words between the question marks,
    and two or more before a word (with a star) or three or more alone."""
    inner = core.strip("?")
    if not inner:
        return [], [], [core]
    lead, tail = len(core) - len(core.lstrip("?")), len(core) - len(core.rstrip("?"))
    forms = {"?" * a + inner + "?" * b for a in range(min(lead, 4) + 1) for b in range(min(tail, 4) + 1)}
    return sorted(f for f in forms if "?" in f), [x for x in inner.split("?") if x], ["?" * lead + "*"] if lead > 1 else []


def opening(word: str) -> str | None:
    """A question mark for each byte of the signs before a word, if ASCII lacks
    all of them, and a star."""
    k = next((i for i, c in enumerate(word) if unicodedata.category(c)[0] != "P"), 0)
    return "?" * len(word[:k].encode()) + "*" if k and all(c > "\x7f" for c in word[:k]) else None


def masked(word: str) -> set[str]:
    """The word with a question mark for each byte, or each character, that
    ASCII lacks."""
    return {"".join(c if c < "\x80" else "?" * k for c, k in zip(word, sizes, strict=True)) for sizes in ([len(c.encode("utf-8", "surrogatepass")) for c in word], [1] * len(word))}


def odd_words(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words with a character above 127."""
    return [m.span() for m in _WORD.finditer(text)]


@dataclass
class Classifier:
    """Multinomial naive Bayes over hashed bigrams; ``weights`` has a row of log
    likelihoods per class, the first for clean words."""

    chains: list[str]
    weights: np.ndarray
    known: frozenset[str]
    lexicon: dict[str, int]
    lost: frozenset[str] = frozenset()
    memo: dict[str, list[tuple[float, str, str]]] = field(default_factory=dict, repr=False)

    def scores(self, word: str) -> np.ndarray:
        """Log odds of each chain against the word being clean."""
        total = self.weights[:, list(bigrams(word))].sum(axis=1)
        return total[1:] - total[0]

    def marks(self, text: str) -> int:
        """Replacement characters, and words in which question marks stand for
        lost letters."""
        n = text.count("\ufffd")
        if self.lost and "?" in text:
            n += sum(marked_word(w) in self.lost for w in _SPACE.split(text) if "?" in w)
        return n

    def lexical_odds(self, word: str, back: str) -> float:
        seen, restored = (self.lexicon.get(lexical_key(x), 0) + 0.1 for x in (word, back))
        return float(np.clip(np.log(restored / seen), -8, 8))

    def readings(self, word: str) -> list[tuple[float, str, str]]:
        """:meth:`_readings`, remembered: words come again and again."""
        known = self.memo.get(word)
        if known is None:
            known = self._readings(word)
            if len(word) <= 60:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[word] = known
        return known

    def _readings(self, word: str) -> list[tuple[float, str, str]]:
        """(log odds, chain, restored word) of the chains that can be inverted,
        the likeliest first. All characters restored must be ones that clean
        words have. To the classifier's odds come those of the two words in
        the lexicon. As any bytes decode in a single-byte encoding, a word that
        is not much rarer than what it would be restored to is left alone
        there, an unknown restored word that itself seems garbled counts
        against, and an unknown word of under three letters says little."""
        scores = self.scores(word)
        found = []
        for k in np.argsort(-scores):
            chain = self.chains[k]
            back, left = _invert_runs(word, chain)
            if back is None or any(c not in self.known for c in back if c > "\x7f" and c not in word):
                continue
            odds = float(scores[k]) + self.lexical_odds(word, back) - RESIDUE * left
            if not chain.startswith("utf-8"):
                seen, restored = (self.lexicon.get(lexical_key(x), 0) for x in (word, back))
                if seen * 4 > restored and seen:
                    continue
                if not restored and not back.isascii():
                    odds -= max(0.0, float(self.scores(back).max()))
                if sum(c.isalpha() for c in back) < 3 and (seen or restored < 3):
                    odds = min(odds, 1.0)
            found.append((odds, chain, back))
        return sorted(found, key=lambda x: -x[0])


def _utf8_read_wrong(word: str) -> bool:
    return any((b := invert(r, c)) is not None and b != r for r in _RUN.findall(word) for c in CHAINS if c.startswith("utf-8"))


def fit(words: Counter[str], rounds: int = 2) -> Classifier:
    """From words (with counts) of which most are clean; those of ASCII serve
    the lexicon only. Words that a UTF-8 chain decodes are left out; so are, from the second round on, words that
    the classifier of the round before takes for garbled."""
    clean = {w: n for w, n in words.items() if "�" not in w and not _utf8_read_wrong(w)}
    chains = list(CHAINS)
    model = None
    known: set[str] = set()
    for _ in range(rounds):
        if model is not None:
            clean = {w: n for w, n in clean.items() if w.isascii() or not (found := model.readings(w)) or found[0][0] < EVIDENCE}
        counts = np.full((len(chains) + 1, 1 << HASH_BITS), 0.1)
        letters: Counter[str] = Counter()
        lexicon: Counter[str] = Counter()
        for word, n in clean.items():
            lexicon[lexical_key(word)] += n
            if word.isascii():
                continue
            weight = min(n, 20)
            letters.update(dict.fromkeys(word, n))
            np.add.at(counts[0], list(bigrams(word)), weight)
            for k, chain in enumerate(chains, 1):
                bad = garble(word, chain)
                if bad is not None and bad != word:
                    np.add.at(counts[k], list(bigrams(bad)), weight)
        weights = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
        known |= {c for c, n in letters.items() if n > 1}
        model = Classifier(chains, weights.astype(np.float32), frozenset(known), {w: n for w, n in lexicon.items() if n > 1})
    return model


def judge(model: Classifier, text: str, rounds: int = 3) -> tuple[str | None, str, int, float]:
    """(chain, restored text, garbled words, log odds). The chain is null for a
    text without a garbled stretch, and ``lost`` where only replacement
    characters or question marks show it. A text may hold stretches of several chains; the one
    with the most words is named."""
    lost = model.marks(text)
    spans = odd_words(text)
    prior = float(np.log(PRIOR / (1 - PRIOR)))
    readings = [(a, b, model.readings(text[a:b])) for a, b in spans]
    support: Counter[str] = Counter()
    for _, _, found in readings:
        for score, chain, _ in found:
            support[chain] += max(-6.0, min(score, 12.0))
    # chains that the whole text speaks for
    chosen = {c for c, s in support.items() if s + prior >= EVIDENCE}
    words: Counter[str] = Counter()
    total = 0.0
    out, at = [], 0
    for a, b, found in readings:
        best = next(((s, c, w) for s, c, w in found if c in chosen), None)
        if best and best[0] > 0:
            out += [text[at:a], best[2]]
            at = b
            words[best[1]] += 1
            total += best[0]
    out.append(text[at:])
    if words and total + prior >= EVIDENCE:
        chain = max(words, key=lambda c: (words[c], c))
        restored = "".join(out)
        # what was garbled more than once needs more than one step back
        if rounds > 1:
            more, further, _, odds = judge(model, restored, rounds - 1)
            if more not in (None, LOST):
                restored, total = further, total + odds
        return chain, restored, words.total() + lost, total
    return (LOST, text, lost, 0.0) if lost else (None, text, 0, 0.0)


def sample_words(df: DataFrame, text_col: str, texts: int = SAMPLE_TEXTS) -> Counter[str]:
    """Words with their counts of at most about ``texts`` texts, the
    ``MAX_WORDS`` most frequent: what the classifier is fitted on."""
    rows = df.select(F.col(text_col).alias("text")).filter("text is not null")
    total = rows.count()
    part = min(1.0, texts / max(total, 1))
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(part * 1_000_000))
    counted = count_words(sample)
    return Counter({r["word"]: r["n"] for r in counted.orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()})


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(w for w in _SPACE.split(text) if 0 < len(w) <= 200)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def with_lexicon(model: Classifier, counted: DataFrame) -> Classifier:
    """The classifier with lexicon and characters of all words, from
    :func:`count_words` of all texts, without those that it takes for garbled.
    Of the lexicon it keeps the words that it can ask for: those with a
    character above 127 and what they may be restored to."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge_words = shared.value
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not w.isascii():
                    backs = (_invert_runs(w, c)[0] for c in judge_words.chains)
                    found.update({("asked", lexical_key(x)): 0 for x in (w, *backs) if x})
                    if "\ufffd" in w or _utf8_read_wrong(w) or ((r := judge_words.readings(w)) and r[0][0] >= EVIDENCE):
                        continue
                    found.update({("letter", c): n for c in set(w)})
                found[("word", lexical_key(w))] += n
            kinds, keys = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(list(found.values()), pa.int64())], names=["kind", "key", "n"])

    sums = cut_lineage(counted.mapInArrow(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = sums.filter("kind = 'word' and n > 1").join(sums.filter("kind = 'asked'").select("key"), "key", "left_semi")
    known = {r["key"] for r in sums.filter("kind = 'letter' and n > 1").collect()}
    return Classifier(model.chains, model.weights, model.known | known, {r["key"]: r["n"] for r in words.collect()})


def lost_words(counted: DataFrame) -> frozenset[str]:
    """The words (see :func:`marked_word`) of which question marks are taken for
    lost letters or signs: filled, the word is one that stands at least twice,
    and more than four times as often as what it is with nothing lost; or signs
    of so many bytes stand before words, or alone, at least twice. From
    :func:`count_words` of all texts; what comes back is as many words as are
    lost, not the lexicon."""

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cores = {c for w in batch.column(0).to_pylist() if (c := marked_word(w))}
            rows = [{"core": c, "form": x, "kind": kind} for c in cores for kind, xs in zip(("fill", "part", "sign"), fillings(c), strict=True) for x in set(xs)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(name, pa.string()) for name in ("core", "form", "kind")]))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms: Counter[str] = Counter()
            for w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = lexical_key(w)
                for form in [key] if key.isascii() else masked(key):
                    forms[form] += n
                if sign := opening(w):
                    forms[sign] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(forms), pa.string()), pa.array(list(forms.values()), pa.int64())], names=["form", "n"])

    words = counted.filter(F.contains("word", F.lit("?"))).select("word").mapInArrow(wanted, "core string, form string, kind string").distinct()
    forms = counted.filter(~F.contains("word", F.lit("?"))).mapInArrow(known, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    by = words.join(forms, "form", "left").groupBy("core").agg(F.max(F.when(F.col("kind") == "fill", F.col("n"))).alias("restored"), F.min(F.when(F.col("kind") == "part", F.coalesce("n", F.lit(0)))).alias("seen"), F.max(F.when(F.col("kind") == "sign", F.col("n"))).alias("sign"))
    inner = F.contains(F.trim(F.lit("?"), F.col("core")), F.lit("?"))
    filled = (F.col("restored") > 1) & (F.col("restored") > 4 * F.col("seen") * F.when(inner, INNER_MARK).otherwise(1.0))
    found = by.filter((F.col("sign") > 1) | filled)
    return frozenset(r["core"] for r in found.select("core").collect())


def garbled_texts(df: DataFrame, id_col: str, text_col: str, model: Classifier) -> DataFrame:
    """``id, chain, restored, garbled_words, log_odds`` of the rows of which at
    least one stretch was read in a wrong encoding.

    ``chain`` names the encodings (``lost`` where only replacement characters
    or question marks are left); ``restored`` has the original text where each garbled word
    could be inverted, else null. A narrow map over whole texts; null and
    empty texts give no row, nor do ASCII texts without lost letters; repeated
    rows one each.
    """
    model.memo.clear()
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: weights and a lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text or (text.isascii() and "?" not in text):
                    continue
                chain, restored, words, odds = judge(shared.value, text)
                if chain:
                    rows.append(row)
                    found.append((chain, None if shared.value.marks(restored) else restored, words, odds))
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "chain", "restored", "garbled_words", "log_odds"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, chain string, restored string, garbled_words int, log_odds double")
    return out.withColumnRenamed("id", id_col)


def find_garbled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fits the classifier's weights on a sample of ``df``, takes lexicon,
    characters and lost letters from the words of all rows and applies them to
    all rows."""
    counted = cut_lineage(count_words(df.select(F.col(text_col).alias("text")).filter("text is not null")))
    model = with_lexicon(fit(sample_words(df, text_col)), counted)
    model.lost = lost_words(counted)
    return garbled_texts(df, id_col, text_col, model)
