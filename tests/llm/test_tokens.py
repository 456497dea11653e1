"""Problems 6, 7 and 8 against the tokenizer itself and one-by-one packing."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm.corpus_ids import count_tokens, decode_corpus, encode_corpus
from folioscope.llm.packing import TightestFit, container_fill, pack, plan
from folioscope.llm.token_budget import PrefixStates, document_tokens, token_budget
from folioscope.llm.tokenizer import BYTE_BPE, byte_strings

TEXTS = [
    None, "", " ", "\n\n\t ", "hello hello world", "<|endoftext|> stays text <|endoftext|>", "a" * 5000, "ñandú — “¿qué?” 🧑🏽‍🚀✨🇲🇽",
    "desván    x​y   z", "日本語のメモ 第三 １２３", "é decomposed ñ", "def f(x):\n    return x**2  # code\n", "1234567890 3.14 don't we'll I'VE",
    "Xqzvblat " * 300, "\x00\x1c\x85 odd", "it's it's it's", "ﷺ" * 40,
]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "k long, text string, ids string, n_tokens string").repartition(3)


def truth(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(spark, texts, tokenizer):
    got = {r.k: r.ids for r in encode_corpus(texts, "k", "text").collect()}
    assert got == {i: truth(tokenizer, t) for i, t in enumerate(TEXTS)}
    assert got[0] == got[1] == [] and 50256 not in got[5]


def test_round_trip_and_split_characters(spark, texts, tokenizer):
    back = {r.k: r.text for r in decode_corpus(encode_corpus(texts, "k", "text"), "k", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    emoji = truth(tokenizer, "🚀")
    assert len(emoji) > 1
    cut = spark.createDataFrame([(1, emoji[:1]), (2, emoji), (3, []), (4, None)], "k long, ids array<int>")
    got = {r.k: r.text for r in decode_corpus(cut, "k", "ids").collect()}
    assert "�" in got[1] and got[2] == "🚀" and got[3] == "" and got[4] is None


def test_offsets_cover_the_text(spark, texts, tokenizer):
    for r in encode_corpus(texts, "k", "text", offsets=True).collect():
        text = TEXTS[r.k] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert all(0 <= a < b <= len(text) for a, b in zip(r.starts, r.ends, strict=True))
        assert set().union(*(range(a, b) for a, b in zip(r.starts, r.ends, strict=True))) == set(range(len(text)))


def test_every_entry_is_one_token(tokenizer):
    """What the budget relies on: a piece that is an entry is that one token."""
    vocabulary = [v for v in tokenizer.get_vocab(with_added_tokens=False) if v != "<|endoftext|>"]
    assert all(len(tokenizer.model.tokenize(v)) == 1 for v in random.Random(1).sample(vocabulary, 5000))
    assert len(byte_strings(tokenizer)) == tokenizer.get_vocab_size()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdeéñ你 hstrin'0🚀", min_size=1, max_size=24), min_size=1, max_size=12))
def test_prefix_states_are_exact(words):
    t = Tokenizer.from_file(BYTE_BPE)
    states = PrefixStates(t)
    pieces = sorted({p for w in words for p, _ in t.pre_tokenizer.pre_tokenize_str(w)})
    assert [states.tokens(p) for p in pieces] == [len(t.model.tokenize(p)) for p in pieces]


def test_document_tokens_are_exact(spark, texts, tokenizer):
    want = {i: len(truth(tokenizer, t)) for i, t in enumerate(TEXTS)}
    assert {r.k: r.n_tokens for r in document_tokens(texts, "k", "text").collect()} == want
    assert {r.k: r.n_tokens for r in count_tokens(texts, "k", "text").collect()} == want
    assert document_tokens(texts.limit(0), "k", "text").count() == 0


def test_budget_keeps_unlabelled_rows(spark):
    rows = [(1, "hello", "Dev Notes", "en_GB"), (2, "hello", "dev-notes ", "English"), (3, None, None, None), (4, "x", "other", "xx")]
    df = spark.createDataFrame(rows, "blog_id long, text string, source string, language string")
    domains = spark.createDataFrame([("dev_notes", "engineering"), ("Dev-Notes", "zz"), (None, "q")], "source string, domain string")
    got = {(r.source, r.language, r.domain): (r.n_docs, r.n_with_text, r.n_tokens) for r in token_budget(df, domains, "blog_id", "text", "source", "language").collect()}
    assert got == {("dev_notes", "en", "engineering"): (2, 2, 2), ("(no source)", "(unlabelled)", "(unmapped)"): (1, 0, 0), ("other", "(unlabelled)", "(unmapped)"): (1, 1, 1)}


def one_by_one(sizes, capacity):
    """Best fit decreasing, item by item."""
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda i: (room[i], i))] -= s
        else:
            room.append(capacity - s)
    return Counter(room)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 40))
def test_plan_equals_one_by_one(sizes, capacity):
    counts = Counter(sizes)
    steps, made = plan(counts, capacity)
    used, placed = Counter(), Counter()
    for size, a, b, first, each in steps:
        for rank in range(a, b + 1):
            used[first + (rank - a) // each] += size
            placed[size, rank] += 1
    assert placed == {(s, r): 1 for s, n in counts.items() for r in range(n)}
    assert len(used) == made
    assert Counter(capacity - u for u in used.values()) == one_by_one(sizes, capacity)


def test_tightest_fit():
    tree = TightestFit(20)
    for i in (3, 7, 20):
        tree.set(i, True)
    assert [tree.least(i) for i in (0, 3, 4, 8, 20)] == [3, 3, 7, 20, 20]
    tree.set(20, False)
    assert tree.least(8) is None


def test_pack_rows(spark):
    rnd = random.Random(3)
    sizes = [7] * 400 + [rnd.randint(1, 60) for _ in range(300)] + [0, None, -2, 250, 100]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n long").repartition(5)
    got = pack(df, "k", "n", 100)
    rows = got.collect()
    whole = Counter()
    for r in rows:
        whole[r.k] += r.size
    assert whole == {k: max(0, n or 0) for k, n in enumerate(sizes)}
    assert {r.k for r in rows if r.part > 0} == {len(sizes) - 2}
    assert all((r.container is None) == (r.size == 0) for r in rows)
    fill = {r.container: r.used for r in container_fill(got).collect()}
    assert max(fill.values()) <= 100 and set(fill) == set(range(len(fill)))
    parts = [min(100, n - p) for n in sizes if n and n > 0 for p in range(0, n, 100)]
    assert Counter(100 - u for u in fill.values()) == one_by_one(parts, 100)
    assert sorted(pack(df.repartition(2), "k", "n", 100).collect()) == sorted(rows)
    assert pack(df.filter(F.lit(False)), "k", "n", 100).count() == 0
