"""Problems 1, 2 and 3 against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm.components import author_key, choose, connected, file_key, grouped_splits, plan_splits, record_keys, related_groups, tied_records
from folioscope.llm.cross_split import alike, candidate_classes, common_words, cross_split_pairs, cross_split_report, shared_grams, text_classes
from folioscope.llm.long_spans import _covers, difference_cover, shared_part, shared_stretches
from folioscope.llm.words import canonical_words

VOCABULARY = "the a quiet engineer lighthouse counts borrowed map over canal río café under bridge señal opens closes slowly after rain Nubiyaz Torasil Dagri 1999 x".split()


def edited(words, rnd, part):
    out = list(words)
    for _ in range(int(len(words) * part)):
        i = rnd.randrange(len(out))
        out[i : i + 1] = rnd.choice([[], [rnd.choice(VOCABULARY)], [out[i], rnd.choice(VOCABULARY)]])
    return out


@pytest.fixture(scope="module")
def samples():
    rnd = random.Random(5)
    rows, base = [], []
    for i in range(260):
        n = rnd.choice([1, 3, 6, 12, 15, 16, 25, 40, 70])
        words = edited(rnd.choice(base), rnd, rnd.choice([0, 0.05, 0.1, 0.2, 0.3])) if base and rnd.random() < 0.5 else [rnd.choice(VOCABULARY) + rnd.choice(["", "", str(rnd.randrange(30))]) for _ in range(n)]
        base.append(words)
        text = rnd.choice([" ", "  ", ", "]).join(words)
        rows.append((i, rnd.choice([text, text.upper(), text + "!"]), rnd.choice(["train", "train", "val", "test", None]), "s"))
    rows += [(900, None, "train", "s"), (901, None, "val", None), (902, "", "test", "s"), (903, "?!", "train", "s"), (904, " . ", "val", "s"), (905, "same text here", "train", "s"), (905, "same text here", "train", "s"), (906, "Same—text  HERE", "val", None), (907, "word " * 3000, "train", "s"), (908, "word " * 2990, "test", "s")]
    return rows


def test_pairs_equal_brute_force(spark, samples):
    df = spark.createDataFrame(samples, "sample_id long, text string, split string, words string").repartition(4)
    got = [tuple(r) for r in cross_split_pairs(df, "sample_id", "text", "split").collect()]
    words = [(i, canonical_words(t), s) for i, t, s, _ in samples]
    want = {tuple(sorted((a[0], b[0]))) for a, b in combinations(words, 2) if a[0] != b[0] and {a[2], b[2]} in ({"train", "val"}, {"train", "test"}) and alike(a[1], b[1])}
    assert len(got) == len(set(got))
    assert set(got) == want and (905, 906) in want and (907, 908) in want
    assert cross_split_pairs(df.filter(F.lit(False)), "sample_id", "text", "split").count() == 0


@pytest.mark.parametrize("n", [16, 18, 24, 29, 40, 100])
def test_pairs_with_words_dropped_and_inserted(spark, n):
    """Every fifth word dropped from one text and others put in elsewhere."""
    rnd, rows, want = random.Random(n), [], set()
    for k in range(40):
        words = [f"w{k}x{i}" if rnd.random() < 0.3 else rnd.choice(VOCABULARY[:12]) for i in range(n)]
        changes = n // 5
        gone = set(rnd.sample(range(n), changes)) if k else {i * 5 for i in range(changes)}
        other = [w for i, w in enumerate(words) if i not in gone]
        for i in sorted(rnd.sample(range(len(other)), changes) if k else range(2, 4 * changes, 4), reverse=True):
            other.insert(i, f"new{i}")
        if alike(canonical_words(" ".join(words)), canonical_words(" ".join(other))):
            want.add((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(words), "train"), (2 * k + 1, " ".join(other), "test")]
    got = cross_split_pairs(spark.createDataFrame(rows, "sample_id long, text string, split string"), "sample_id", "text", "split")
    assert len(want) == 40 and want <= {tuple(r) for r in got.collect()}


def test_texts_of_the_same_phrases_are_few_candidates(spark):
    """Texts made of the same 34 phrases share rare words, but few are alike."""
    rnd = random.Random(3)
    phrases = [[f"p{k}w{i}" for i in range(4)] for k in range(34)]
    texts = [" ".join(w for k in rnd.sample(range(34), 18) for w in phrases[k]) for _ in range(200)]
    texts[100:110] = [t + " end" for t in texts[:10]]
    df = spark.createDataFrame([(i, t, "train" if i < 100 else "test") for i, t in enumerate(texts)], "sample_id long, text string, split string")
    classes = text_classes(df, "sample_id", "text", "split", "train", ["test"])[1]
    assert 10 <= candidate_classes(classes).count() <= 100
    assert sorted(tuple(r) for r in cross_split_pairs(df, "sample_id", "text", "split").collect()) == [(i, 100 + i) for i in range(10)]


def test_report(spark, samples):
    df = spark.createDataFrame(samples, "sample_id long, text string, split string, words string")
    manifest = spark.sql("select named_struct('train', named_struct('positive', 7, 'negative', 1)) as counts_per_class union all select null")
    rows = cross_split_report(df, manifest, "sample_id", "text", "split", F.col("words")).collect()
    assert sum(r.n_records for r in rows) == len({i for i, _, s, _ in samples if s in ("val", "test")})
    assert {r.train_positive for r in rows} == {7}
    assert [(r.n_hit, r.n_exact) for r in rows if r.source is None] == [(1, 1)]
    assert all(r.n_exact <= r.n_hit <= min(r.n_links, r.n_records) for r in rows)


@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_common_words(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert common_words(a, b) == rows[-1][-1]


def test_shared_grams_bound():
    """Words changed at the places that hurt most still leave what is counted on."""
    assert all(shared_grams(n, 4, 0.8) >= 1 for n in range(16, 3000))
    for n in (16, 33, 70, 200):
        k = n // 5
        changed = {round((i + 0.5) * n / k - 0.5) for i in range(k)}
        kept = sum(not changed & set(range(i, i + 4)) for i in range(n - 3))
        assert kept >= shared_grams(n, 4, 0.8)


def test_keys_of_names_and_files():
    assert len({author_key(x) for x in ["Inés Daloben", "DALOBEN, Inés", " Ines  Daloben", "inés daloben", "Inés Daloben", "Daloben, Inés"]}) == 1
    assert len({file_key(x) for x in ["data/raw/a/00120c_the.txt", "00120c_the.TXT", "data\\raw\\00120C_THE.txt", " ./x//00120c_the", "/mnt/00120c_the.txt "]}) == 1
    assert author_key(None) is author_key(" ") is file_key(None) is file_key("  ") is None
    assert file_key("a/.txt") and author_key("Cher") == "cher" and author_key(",") is None


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("shape", ["chain", "random", "star", "loops"])
def test_components(spark, shape):
    rnd = random.Random(shape)
    if shape == "chain":
        names = [f"n{i:03d}" for i in range(120)]
        rnd.shuffle(names)
        edges = list(zip(names, names[1:], strict=False))
    elif shape == "star":
        edges = [("m", f"{i}") for i in range(200)]
    elif shape == "loops":
        edges = [("a", "a"), ("b", "c"), ("c", "b"), ("b", "c")]
    else:
        edges = [(f"{rnd.randrange(300)}", f"{rnd.randrange(300)}") for _ in range(170)]
    got = connected(spark.createDataFrame([*edges, (None, "q")], "u string, v string"))
    assert {r.node: r.label for r in got.collect()} == union_find(edges)


def test_groups_and_splits(spark):
    rnd = random.Random(2)
    entities = spark.createDataFrame([(1, "Puerto Quifarál", "La Vat"), (2, "Casa Numa", None), (3, None, " "), (4, "Numa", "La Vat")], "entity_id int, name string, alias string")
    texts = ["Al puerto  QUIFARAL fui", "puertoquifaral no", "la vat, casa", "nothing", None, "", "Casa—Numa!", "Numancia"]
    rows = [(i, rnd.choice(texts[3:6]) if i > 7 else texts[i], f"d/f{rnd.randrange(60)}.txt" if i > 7 and rnd.random() < 0.8 else None, f"A B{rnd.randrange(90)}" if i > 20 and rnd.random() < 0.5 else " ", "z") for i in range(150)]
    rows += [rows[40], rows[41], (None, "x", "d/f1.txt", None, "z")]
    df = spark.createDataFrame(rows, "sample_id long, text string, source string, author string, keys string")
    keys = record_keys(df, "sample_id", "source", "author", "text", entities)
    by = {r.sample_id: r["keys"] for r in keys.collect()}
    assert [x for x in by[0] if x[0] == "e"] == ["e:1"] and by[1] == by[3] == by[4] == by[5] == by[7] == []
    assert by[2] == ["e:1", "e:4"] and by[6] == ["e:2", "e:4"]
    groups = related_groups(keys, "sample_id")
    want = union_find([(f"{i:05d}", k) for i, _, _, _, _ in rows if i is not None for k in [f"{i:05d}", *by[i]]])
    label = defaultdict(set)
    for node, root in want.items():
        if node.isdigit():
            label[root].add(int(node))
    expected = {i: min(g) for g in label.values() for i in g}
    assert {r.sample_id: r.group_id for r in groups.collect()} == expected
    tied = {r.sample_id for r in tied_records(groups, "sample_id").collect()}
    assert tied == {i for g in label.values() if len(g) > 1 for i in g}
    splits = grouped_splits(groups, "sample_id").collect()
    assert len(splits) == 150 and all(len({r.split for r in splits if r.group_id == g}) == 1 for g in set(expected.values()))
    sizes = defaultdict(int)
    for r in splits:
        sizes[r.split] += 1
    assert abs(sizes["val"] - 15) <= 1 and abs(sizes["test"] - 15) <= 1
    assert grouped_splits(related_groups(keys.limit(0), "sample_id"), "sample_id").count() == 0


def test_large_name_tables_take_the_join(spark, monkeypatch):
    import folioscope.llm.components as c

    entities = spark.createDataFrame([(1, "Puerto Quifarál", "La Vat"), (2, "Numa", None)], "entity_id int, name string, alias string")
    df = spark.createDataFrame([(1, "a la vat b numa", "f", "x"), (2, "Puerto", None, None), (3, None, None, None)], "sample_id long, text string, source string, author string")
    small = sorted(record_keys(df, "sample_id", "source", "author", "text", entities).collect())
    monkeypatch.setattr(c, "MAX_BROADCAST_NAMES", 1)
    assert sorted(record_keys(df, "sample_id", "source", "author", "text", entities).collect()) == small


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), max_size=5), st.integers(0, 40))
def test_choose_is_optimal(sizes, target):
    flat = [s for s, n in sizes.items() for _ in range(n)]
    sums = {0}
    for s in flat:
        sums |= {x + s for x in sums}
    taken = choose(sizes, target, sum(flat))
    assert all(n <= sizes[s] for s, n in taken.items())
    assert abs(sum(s * n for s, n in taken.items()) - target) == min(abs(x - target) for x in sums)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 90), st.integers(1, 40), max_size=12), st.sampled_from([1 << 22, 64, 300]))
def test_split_plan_covers_all_groups(sizes, limit):
    steps = plan_splits(sizes, max_total=limit)
    ranks = defaultdict(list)
    for size, lo, hi, _ in steps:
        ranks[size] += range(lo, hi + 1)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in sizes.items()}


def test_difference_covers():
    assert difference_cover(73) == sorted(pow(2, k, 73) for k in range(9))
    for period in (1, 2, 7, 20, 50, 73):
        assert _covers(difference_cover(period), period)


def brute_stretches(records, length):
    runs = defaultdict(set)
    for key, text in records:
        for i in range(len(text or "") - length + 1):
            runs[text[i : i + length]].add(key)
    out = set()
    for key, text in records:
        covered = sorted({i for i in range(len(text or "") - length + 1) if len(runs[text[i : i + length]]) > 1})
        a = b = None
        for i in covered:
            if b is not None and i <= b:
                b = i + length
            else:
                if b is not None:
                    out.add((*key, a, b))
                a, b = i, i + length
        if b is not None:
            out.add((*key, a, b))
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, 150), (2, 150), (3, 20), (4, 41), (5, 3)])
def test_stretches_equal_brute_force(spark, seed, length):
    rnd = random.Random(seed)
    alphabet = "abcdé🙂 "
    noise = lambda n: "".join(rnd.choice(alphabet) for _ in range(n))
    pool = [noise(rnd.randint(length // 2, 4 * length)) for _ in range(8)]
    records = []
    for i in range(60):
        text = "".join(rnd.choice([noise(rnd.randint(0, length)), (p := rnd.choice(pool))[rnd.randint(0, 5) :], p[: length + rnd.randint(-2, 2)]]) for _ in range(rnd.randint(0, 4)))
        records.append(((rnd.choice(["sample", "completion"]), i), text))
    records += [(("sample", 100), None), (("sample", 101), ""), (("sample", 102), "a" * (length + 30)), (("completion", 102), "a" * (length + 3)), (("sample", 103), records[3][1]), (("completion", 103), records[3][1]), (("sample", 104), "xy" * 2 * length), (("sample", 105), "y" * 5 + "xy" * length)]
    rows = [(*k, t, "z") for k, t in records] + [(*records[5][0], records[5][1], "w")]
    df = spark.createDataFrame(rows, "rec_kind string, rec_id long, text string, doc string").repartition(5)
    got = shared_stretches(df, length)
    assert {(r.rec_kind, r.rec_id, r.start_pos, r.end_pos) for r in got.collect()} == brute_stretches(records, length)
    assert got.count() == got.distinct().count()
    assert all(0 < r.shared_part <= 1 for r in shared_part(got).collect())
    assert shared_stretches(df.limit(0), length).count() == 0
