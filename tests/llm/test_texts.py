"""Problems 4, 5 and 9 on invented texts, with known answers."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm import encoding_repair
from folioscope.llm.cutoff import count_words, cut_rates, cut_records, ending, hard_limits, judge_words, read_endings, unclosed
from folioscope.llm.encoding_repair import CHAINS, find_garbled, fit, garble, invert, judge, odd_words, with_lexicon
from folioscope.llm.labels import language_code
from folioscope.llm.language import SENTENCE_WORDS, Profiles, fit_profiles, language_segments, sentences, text_languages, unnamed_languages

SPEECH = {
    "en": "the old man walks slowly along the river and thinks about the weather|she has never seen such a large house in this part of the country|we would like to know whether they are coming with us tomorrow|there is nothing in the kitchen that could be used for the dinner|my brother said that his friends were waiting at the station|nobody knows why the lights went out during the night|it was one of those days when everything seems to take forever|they bought bread and cheese before walking through the forest",
    "es": "el hombre viejo camina despacio por la orilla y piensa en el tiempo|ella nunca ha visto una casa tan grande en esta parte del país|queremos saber si mañana van a venir con nosotros al pueblo|no hay nada en la cocina que se pueda usar para la cena|mi hermano dijo que sus amigos estaban esperando en la estación|nadie sabe por qué se apagaron las luces durante la noche|fue uno de esos días en que todo parece durar para siempre|compraron pan y queso antes de caminar por el bosque",
    "de": "der alte Mann geht langsam am Fluss entlang und denkt über das Wetter nach|sie hat noch nie ein so großes Haus in diesem Teil des Landes gesehen|wir möchten wissen ob sie morgen mit uns kommen werden|es gibt nichts in der Küche was man für das Abendessen benutzen könnte|mein Bruder sagte dass seine Freunde am Bahnhof warteten|niemand weiß warum in der Nacht die Lichter ausgegangen sind|es war einer dieser Tage an denen alles ewig zu dauern scheint|sie kauften Brot und Käse bevor sie durch den Wald gingen",
    "it": "il vecchio cammina lentamente lungo il fiume e pensa al tempo che fa|lei non ha mai visto una casa così grande in questa parte del paese|vorremmo sapere se domani verranno con noi fino alla città|non c'è niente nella cucina che si possa usare per la cena|mio fratello ha detto che i suoi amici aspettavano alla stazione|nessuno sa perché le luci si sono spente durante la notte|era uno di quei giorni in cui tutto sembra durare per sempre|hanno comprato pane e formaggio prima di attraversare il bosco",
    "fr": "le vieil homme marche lentement le long de la rivière et pense au temps|elle n'a jamais vu une maison aussi grande dans cette partie du pays|nous voudrions savoir s'ils viennent demain avec nous jusqu'au village|il n'y a rien dans la cuisine qui puisse servir pour le dîner|mon frère a dit que ses amis attendaient à la gare depuis hier|personne ne sait pourquoi les lumières se sont éteintes pendant la nuit|c'était un de ces jours où tout semble durer une éternité|ils ont acheté du pain et du fromage avant de traverser la forêt",
    "pt": "o homem velho caminha devagar ao longo do rio e pensa no tempo|ela nunca viu uma casa tão grande nesta parte do país|nós gostaríamos de saber se amanhã eles vêm conosco até a cidade|não há nada na cozinha que se possa usar para o jantar|o meu irmão disse que os seus amigos estavam esperando na estação|ninguém sabe por que as luzes se apagaram durante a noite|foi um daqueles dias em que tudo parece durar para sempre|eles compraram pão e queijo antes de atravessar a floresta",
}
LINES = {k: [s[0].upper() + s[1:] + "." for s in v.split("|")] for k, v in SPEECH.items()}


@pytest.fixture(scope="module")
def ranks(spark):
    rows = [(" ".join(lines[:6]), code) for code, lines in LINES.items() for _ in range(3)] + [(LINES["en"][0], "es"), (None, "en"), ("x", None)]
    return fit_profiles(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")


def test_labels_name_languages(spark):
    rows = [("es-MX", "es"), (" EN", "en"), ("en_GB", "en"), ("Português", "pt"), ("deu", "de"), ("xx", None), ("", None), (None, None), ("n/a", None), ("und", None), ("Italian", "it"), ("-", None), ("fr", "fr")]
    got = spark.createDataFrame(rows, "label string, code string").select("label", "code", language_code(F.col("label")).alias("got")).collect()
    assert all(r.got == r.code for r in got)


def test_held_out_sentences(ranks):
    judge_ = Profiles(ranks)
    assert all(judge_.label(x)[0][2] == code for code, lines in LINES.items() for x in lines[6:])
    assert Profiles(judge_.ranks()).ranks() == judge_.ranks()
    assert Profiles({}).label("any words here") == []


def test_segments_and_cases(spark, ranks):
    en, es, de = LINES["en"], LINES["es"], LINES["de"]
    rows = [
        ("a", f"{en[6]} {en[7]}", "en-US"), ("b", f"{en[6]} {en[7]}\n{es[6]} {es[7]}", "English"), ("c", de[6], None), ("d", None, "en"), ("e", "", "en"), ("f", "404 --- 🙂", "xx"),
        ("g", f"{en[6]} «el buen viento» {en[7]}", "en"), ("h", es[7].upper(), "fr"), ("i", f"{en[7]} " * 400 + de[7], "en"), ("a", f"{en[6]} {en[7]}", "en-US"), (None, es[6], "es"),
    ]
    df = spark.createDataFrame(rows, "rec_key string, text string, lang string").withColumn("label", F.lit("clash"))
    segments = language_segments(df, ["rec_key"], "text", "lang", ranks)
    got = segments.collect()
    assert {(r.rec_key, r.lang) for r in unnamed_languages(segments, ["rec_key"]).collect()} == {("b", "es"), ("c", "de"), ("h", "es"), ("i", "de")}
    b = sorted((r for r in got if r.rec_key == "b"), key=lambda r: r.segment)
    assert [r.lang for r in b] == ["en", "es"] and b[0].end_pos <= b[1].start_pos == len(f"{en[6]} {en[7]}\n")
    assert all(0 <= r.confidence <= 1 for r in got)
    assert [(r.lang, r.confidence, r.sentences) for r in got if r.rec_key in ("d", "e", "f")] == [(None, 0.0, 0)] * 3
    whole = {r.rec_key: r for r in text_languages(segments, ["rec_key"]).collect()}
    assert whole["i"].lang == "en" and whole["i"].n_languages == 2 and whole["d"].lang is None and whole[None].lang == "es"
    assert language_segments(df.limit(0), ["rec_key"], "text", "lang", ranks).count() == 0
    assert SENTENCE_WORDS == 4 and sentences("A b. C d!\n\ne") == [(0, 4), (4, 9), (11, 12)]


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("All is said.", "terminated"), ("All is said.”", "terminated"), ("Is it so?)", "terminated"), ("It ends here. (2023)", "mark"), ("It ends here. 🙂", "mark"), ("It ends here.\n— 3 —", "mark"),
        ("It ends. #tag #other", "mark"), ("It ends.\nhttps://a.example/p/1", "mark"), ("It ends here. ***", "mark"), ("It ends here. [fin]", "mark"), ("Begins. The second sentence goes on and then [...]", "sign"),
        ("Begins. The second sentence goes on and th…", "dots"), ("Begins. The second...", "dots"), ("Begins. The second sentence goes on and th", "open"), ("Begins. Broken ch�", "broken"), ("Begins. Broken &am", "broken"),
        ("Begins. Broken \\u00", "broken"), ("Begins. Broken <a href=", "broken"), ("", "empty"), (" \n ", "empty"), ("A line,\nanother line\nthe third line", "open"), ("All is said. P. S. I am here", "mark"),
    ],
)
def test_endings(text, state):
    assert ending(text).state == state


def test_automaton():
    assert unclosed("a (b [c") and unclosed("“a") and unclosed("<b>a") and unclosed("«x» «y")
    assert not unclosed("a (b) [c]") and not unclosed("a) b") and not unclosed("<b>a</b> <br> 1 < 2") and not unclosed("“a”")


def test_cut_records(spark):
    rnd = random.Random(4)
    words = "engineer lighthouse remember borrowed canal promise kettle harbour winter sentence mountain travel quiet morning garden".split()
    sentence = lambda: " ".join(rnd.choice(["the", "a", "every", ""]) + " " + rnd.choice(words) for _ in range(7)).strip().capitalize() + "."
    whole = lambda n: " ".join(sentence() for _ in range(n))
    rows, truth = [], {}

    def add(origin, text, cut):
        truth[len(rows)] = cut
        rows.append(("sample", len(rows), origin, text))

    for _ in range(150):
        add("free", whole(rnd.randint(2, 8)), False)
    for _ in range(40):
        text = whole(8)
        add("limited", text[:200], True)
    for _ in range(10):
        add("limited", whole(2), False)
    for _ in range(12):
        add("free", whole(2)[:-9], True)
        add("marked", whole(2) + rnd.choice([" 🙂", "\n***", " (2023)", "\nhttps://x.example/1", "..."]), False)
        add("bytes", ("é" + whole(8)).encode()[:150].decode("utf-8", "ignore"), True)
        add("verse", "\n".join(f"The {rnd.choice(words)} and {rnd.choice(words)}" for _ in range(4)), False)
        add("never", whole(1)[:-1], False)
    for text in ("", "  ", "Ends in a broken charact�", whole(3) + " And then some more of [...]"):
        add(None, text, len(text) > 3)
    rows += [("sample", 9001, "free", None), rows[0], ("completion", 1, None, "One sentence of words. Another without en")]
    df = spark.createDataFrame(rows, "rec_kind string, rec_id long, origin string, text string").withColumn("n_chars", F.lit("clash")).repartition(3)
    got = cut_records(df)
    by = {(r.rec_kind, r.rec_id): r for r in got.collect()}
    wrong = [(rows[i][2], rows[i][3][-40:], by["sample", i].reason) for i, cut in truth.items() if by["sample", i].cut != cut]
    assert len(wrong) <= 2, wrong
    assert ("sample", 9001) not in by and len(by) == len(truth) + 1 == got.count()
    rates = {(r.rec_kind, r.origin): (r.n_records, r.n_cut) for r in cut_rates(got).collect()}
    assert rates["sample", "bytes"] == (12, 12) and rates["sample", "never"][1] == 0
    assert {(r.origin, r.limit) for r in hard_limits(read_endings(df), "n_chars").collect()} >= {("limited", 200)}
    assert cut_records(df.limit(0)).count() == 0


def test_word_judgement(spark):
    texts = ["the canal remembers the canal. so the canal.\n"] * 50
    words = count_words(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string"))
    got = {r.word: (r.partial, r.dangling) for r in judge_words(spark.createDataFrame([("the",), ("canal",), ("can",), ("zzz",), ("196",), ("t",)], "word string"), words).collect()}
    assert got == {"the": (False, True), "canal": (False, False), "can": (True, False), "zzz": (False, False), "196": (False, False), "t": (True, True)}


SPANISH = "La razón más simple del jardín acompaña la canción después de la estación y el corazón del niño también enseñó lección número según compás".split()


@pytest.fixture(scope="module")
def model():
    words = Counter()
    for code in LINES:
        for line in LINES[code]:
            words.update({w: 6 for w in line.split()})
    words.update({w: 12 for w in SPANISH})
    words.update({"“hola”": 3, "«bien»": 3, "—": 9, "CHÂTEAU,": 3, "½": 3, "café…": 3, "¿qué": 3, "©": 4})
    return fit(words)


@pytest.mark.parametrize("chain", sorted(CHAINS))
def test_chains_round_trip(chain, model):
    """Every chain is inverted exactly; what it did to a text is found and undone."""
    text = " ".join(SPANISH)
    bad = garble(text, chain)
    if bad is None or bad == text:
        pytest.skip("the chain leaves this text alone")
    assert invert(bad, chain) == text
    changed = sum(a != b for a, b in zip(bad.split(" "), text.split(" "), strict=True))
    found, restored, n, _ = judge(model, bad)
    assert found is not None and n >= 0.8 * changed
    same = sum(a == b for a, b in zip(restored.split(" "), text.split(" "), strict=True))
    assert same >= len(SPANISH) - 0.2 * changed


def test_clean_texts_stay(model):
    for text in [*(x for lines in LINES.values() for x in lines), "CHÂTEAU, ÂGE, NÃO", "x² + y² = ½", "Что это? Привет", "日本語のメモ", "├── notas │ └──", "© 2023 25 °C ± 2", "🙂✨", "", "plain ascii", "RIVIÈRE À CÔTÉ"]:
        assert judge(model, text)[:2] == (None, text)


def test_garbled_rows(spark):
    rnd = random.Random(8)
    plain = [" ".join(rnd.choice(SPANISH) for _ in range(25)) for _ in range(300)]
    rows = list(enumerate(plain))
    bad = {}
    for k, chain in enumerate(sorted(c for c in CHAINS if c.startswith("utf-8"))):
        bad[1000 + k] = garble(plain[k], chain)
        half = plain[k].split(" ")
        bad[2000 + k] = " ".join(half[:20] + [garble("corazón", chain) or garble("razón", chain)] + half[20:])
    bad[3000] = "raz�n perdida"
    rows += list(bad.items()) + [(5000, None), (5001, ""), (5002, " "), (5003, "é" * 30_000), (3000, "raz�n perdida")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chain", F.lit("clash")).repartition(4)
    got = find_garbled(df, "doc_id", "text").collect()
    assert {r.doc_id for r in got} == set(bad) and len(got) == len(bad) + 1
    restored = {r.doc_id: r.restored for r in got}
    assert restored[3000] is None
    right = sum(restored[1000 + k] == plain[k] for k in range(len(bad) // 2))
    assert right >= 0.9 * (len(bad) // 2)
    assert find_garbled(df.limit(0), "doc_id", "text").count() == 0
    assert odd_words("a ñb c—d") == [(2, 4), (5, 8)]


def test_letters_lost_to_question_marks(spark):
    plain = " ".join(SPANISH)
    clean = ["Is this the end? What?? No!", "page?id=3 x??y", "el niño? la razón?", "¿qué razón? la estación??", "simple? jardin?", "a ? b ?? c", "casa?", "No!!!???"]
    rows = [(k, plain + " — “hola”") for k in range(4)] + list(enumerate(clean, 10))
    utf8 = lambda t: t.encode().decode("ascii", "replace").replace("\ufffd", "?")
    bad = {100: utf8("la razón"), 101: "la raz?n perdida", 102: utf8("“Canción? número!”"), 103: utf8("también, corazón y niño"), 104: utf8("enseñó") + " lección", 105: utf8("lección según?"), 106: utf8("the end — “so”"), 107: utf8("by “Anna”"), 108: utf8("here — there")}
    df = spark.createDataFrame(rows + list(bad.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in find_garbled(df, "doc_id", "text").collect()}
    assert set(got) == set(bad)
    assert all(r.chain == "lost" and r.restored is None and r.garbled_words > 0 for r in got.values())


def test_lexicon_counts_all_texts(spark, model):
    """A word and a character that the sample lacks are known from the rest."""
    texts = ["el río yağmur"] * 3 + [garble("yağmur", "utf-8>cp1252")] * 9 + ["plain words"]
    whole = with_lexicon(model, encoding_repair.count_words(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert "ğ" not in model.known and {"ğ", "í"} <= whole.known
    assert whole.lexicon["yağmur"] == 3 and "plain" not in whole.lexicon
    bad = " ".join([garble("yağmur", "utf-8>cp1252")] * 4)
    assert judge(model, bad)[0] is None and judge(whole, bad)[1] == "yağmur yağmur yağmur yağmur"


@pytest.mark.parametrize("most", [4, 1000])
def test_profiles_do_not_count_copies(spark, most):
    rows = [(f"{line} {i}", code) for code in LINES for line in LINES[code] for i in range(6)]
    plain = fit_profiles(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", most)
    copies = fit_profiles(spark.createDataFrame(rows + rows[:1] * 200, "text string, lang string"), "text", "lang", most)
    assert plain == copies
