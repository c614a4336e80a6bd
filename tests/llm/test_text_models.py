import random

from tests.llm.data import DOCS, FETCH, fetch_rows, odd_documents, odd_fetches
from tests.llm.test_pages import sentence
from webstrata.llm import abuse as A
from webstrata.llm import language as L
from webstrata.llm import residue as R

TEXTS = {
    "en": "The house near the river was sold again last week. We could not find out who had bought it, and nobody in the street knew.",
    "de": "Das Haus am Fluss wurde letzte Woche wieder verkauft. Wir konnten nicht herausfinden, wer es gekauft hatte, und niemand in der Straße wusste es.",
    "fr": "La maison près de la rivière a encore été vendue la semaine dernière. Nous n'avons pas pu savoir qui l'avait achetée, et personne dans la rue ne le savait.",
    "es": "La casa cerca del río se vendió otra vez la semana pasada. No pudimos averiguar quién la había comprado, y nadie en la calle lo sabía.",
    "pt": "A casa perto do rio foi vendida outra vez na semana passada. Não conseguimos descobrir quem a tinha comprado, e ninguém na rua sabia.",
    "it": "La casa vicino al fiume è stata venduta di nuovo la settimana scorsa. Non siamo riusciti a sapere chi l'avesse comprata, e nessuno nella via lo sapeva.",
    "ru": "Дом у реки снова продали на прошлой неделе. Мы не смогли узнать, кто его купил, и никто на улице этого не знал.",
}


def test_languages_held_out():
    model = L.Model(*L.train([]))
    for lang, text in TEXTS.items():
        main, sure, words, _ = L.read_record(model, f"{text}\n\n{text}")
        assert (main, words >= 40) == (lang, True) and sure > 0.2, lang


def test_long_runs_are_read_whole():
    vectors, rng = L.Vectors(256), random.Random(8)
    word = "".join(rng.choice("abcdeé") for _ in range(5000))
    total = sum(vectors.letter(a)[2].astype(int) * vectors.letter(b)[1] * vectors.letter(c)[0] for a, b, c in zip(f" {word} ", f"{word} ", word[1:] + " "))
    assert (vectors.word(word) == total).all()
    short = "abcde" * 12
    assert (vectors.word(short) == vectors.long_word(f" {short} ")).all()


def test_short_lines_count():
    assert [n for n, *_ in L.sentence_lines("He is ill.\nno end\n* He is ill.")] == [1]


def test_labels():
    assert [L.label_language(x) for x in ("EN", "en_GB", "eng", "English", "Português", "x-default", "und", "", None, "nl", "zxx")] == ["en", "en", "en", "en", "pt", None, None, None, None, "nl", None]


def test_label_faults(spark):
    pages = []
    for i, (lang, text) in enumerate(TEXTS.items()):
        other = TEXTS["ru" if lang != "ru" else "en"]
        pages.append((i, None, None, f"# Title\n\n{text} {text}\n\n{other}\n\nshort line.", None, "en", 200))
        pages.append((50 + i, None, None, text + "\n" + text, None, lang.upper(), 200))
    got = {(r.fetch_id, r.line_no): r.lang for r in L.label_faults(spark.createDataFrame(fetch_rows(pages) * 2, FETCH)).collect()}
    want = {(i, 0): lang for i, lang in enumerate(TEXTS) if lang != "en"} | {(i, 5): "en" if lang == "ru" else "ru" for i, lang in enumerate(TEXTS)}
    assert got == want


def test_odd_languages(spark):
    df = odd_fetches(spark)
    heads = {r.fetch_id: (r.lang, r.confidence) for r in L.language_segments(df).where("line_no = 0").collect()}
    assert heads[1] == heads[2] == heads[3] == (None, 0.0) and heads[4][0] == "en"
    assert L.label_faults(df.limit(0)).count() == 0


RESIDUE = [
    "# {{ page.name }}\n\n${cityTitle} / [object Object]", "Lorem ipsum dolor sit amet consectetur elit sed.", "# Page not found\n\nThe page you asked for has moved or no longer exists.",
    "Please turn on JavaScript in your browser.", "# Accès refusé\n\nVotre trafic semble automatique.", "Real start. " + "This is a long text about rivers. " * 30 + "It costs %%price_NAME%% euros.",
]
CONTENT = [
    "Use it so:\n```\n<p>{{ name }}</p>\n```\n" + "This is a long text about rivers. " * 30,
    "“Page not found”, “Access denied”: " + "the words of the day were read by many people. " * 25,
    "The template `{{ name }}` is filled by the server. " + "This is a long text about rivers. " * 30,
]


def test_residue(spark):
    rng = random.Random(1)
    good = [(i, f"https://{'abcdef'[i % 6]}.test/{i}", "t", "\n\n".join(" ".join(sentence(rng) for _ in range(5)) for _ in range(5)), None, "en", 200) for i in range(120)]
    bad = [(200 + i, f"https://{'abcdef'[i % 6]}.test/b{i}", None, t, None, "en", 404) for i, t in enumerate((RESIDUE * 8)[:45])]
    new = [(300 + i, "https://new.test", None, t, None, None, 200) for i, t in enumerate(RESIDUE)] + [(400 + i, "https://new.test", None, t, None, None, 200) for i, t in enumerate(CONTENT)]
    df = spark.createDataFrame(fetch_rows(good + bad + new), FETCH)
    got = {r.fetch_id for r in R.residue_records(df).collect()}
    assert got == {i for i, *_ in bad} | {300 + i for i in range(len(RESIDUE))}


def test_long_residue(spark):
    rng = random.Random(1)
    good = [(i, f"https://{'abcdef'[i % 6]}.test/{i}", "t", "\n\n".join(" ".join(sentence(rng) for _ in range(5)) for _ in range(5)), None, "en", 200) for i in range(120)]
    bad = [(200 + i, f"https://{'abcdef'[i % 6]}.test/b{i}", None, t, None, "en", 404) for i, t in enumerate((RESIDUE * 8)[:45])]
    menu = "[Home](/) | [About us](/a) | [Contact](/c) | [Press](/p) | [Help](/h) | [Jobs](/j)\n" * 12
    trace = "".join(f"Page not found. The page you asked for has moved or no longer exists, request {k}.\n" for k in range(20))
    pages = [menu + "\nPage not found. The page you asked for has moved or no longer exists.", trace]
    assert min(map(len, pages)) >= 900
    new = [(300 + i, "https://new.test", None, t, None, None, 200) for i, t in enumerate(pages)]
    df = spark.createDataFrame(fetch_rows(good + bad + new), FETCH)
    assert {r.fetch_id for r in R.residue_records(df).collect()} == {i for i, *_ in bad} | {300, 301}


def test_words_strung_together_are_no_residue():
    rng = random.Random(6)
    assert R.is_strung(" ".join(rng.choice(["patch", "river", "cable", "lamp", "data"]) for _ in range(16)))
    assert not R.is_strung("Your text goes here. " * 4) and not R.is_strung("Lorem ipsum dolor sit amet consectetur elit sed.")


def test_title_and_reason_are_read():
    assert R.page_features("Page 404", None) != R.page_features("Page", None) != R.page_features("Page", "not_found")
    rows = [("h", f"Sentence {w} stands here.", False, ("Broken", "timeout"), "error") for w in TEXTS] + [("h", f"Sentence {w} stands here.", True, ("Fine", None), "content") for w in TEXTS]
    judge = R.Judge(R.fit_sentences(rows))
    bad, good = (judge.sentence("Another sentence is here.", False, judge.page(*p))[1] for p in (("Broken", "timeout"), ("Fine", None)))
    assert bad > good


def test_odd_residue(spark):
    df = odd_fetches(spark)
    assert {r.fetch_id: r.residue for r in R.score_residue(df).collect()}[1] is False
    assert R.residue_records(df.limit(0)).count() == 0
    weights, report = R.fit_classifier(df.limit(0)), R.held_out_report(df.limit(0))
    assert report["held_out_sentences"] == report["unseen_wording_sentences"] == 0 and R.Judge(weights).record("fine")[1] is False


CASES = [
    ("You are a worthless idiot, shut your mouth.", {"abusive"}),
    ("You are a w0rthl3$$ 1d10t, shut your mouth.", {"abusive"}),
    ("You are a w.o.r.t.h.l.e.s.s i.d.i.o.t, shut up.", {"abusive"}),
    ("What a w o r t h l e s s idiot you are.", {"abusive"}),
    ("You pathetic m****n, get lost.", {"abusive"}),
    ("Shut your stuuuupid mouth, you pathetic moron.", {"abusive"}),
    ("Du bist ein elendes Arsch​loch.", {"abusive"}),
    ("Refugees are vermin and should be driven out of town.", {"hateful"}),
    ("Women do not deserve the same rights as men.", {"hateful"}),
    ("They fucked naked until she moaned.", {"sexual"}),
    ("The moderators delete posts that call refugees vermin.", set()),
    ("The clinic offers breast cancer screening and sexual health advice.", set()),
    ("If the parent process hangs, kill the child process.", set()),
    ("The rooster is a proud cock on the farm.", set()),
    ("Women and their neighbours say that the house was sold.", set()),
    ("A calm text about rivers and bridges.", set()),
    ("", set()),
    (None, set()),
]


def test_scores():
    scorer = A.Scorer()
    for text, want in CASES:
        got = {k for k, s in zip(A.KINDS, scorer.texts([text])[0]) if s >= A.THRESHOLDS[k]}
        assert got == want, text


def test_many_weak_terms_add_up():
    scorer = A.Scorer()
    text = "Never let immigrants back, keep them out of this shop."
    assert max(w for token in text.split() for _, role, w in scorer.weights(token.strip(",.")) if role == "ht") < 0.4
    assert scorer.texts([text, f"The river is calm.\n{text} It rained."]) == [(0.0, 1.9, 0.0)] * 2


def test_no_sentence_is_skipped():
    scorer, rng = A.Scorer(), random.Random(3)
    words = [*rng.sample(sorted(scorer.terms), 400), "river", "house", "straße", "река"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    for text, scores in zip(texts, scorer.texts(texts)):
        assert scores == tuple(round(scorer.sentence(scorer.plain(text))[k], 4) for k in A.KINDS), text


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[j - 1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_against_edit_distance():
    rng = random.Random(2)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 8))) for _ in range(40)]
    trie = A.Trie(terms)
    for _ in range(300):
        token = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 9)))
        for k in (0, 1, 2):
            near = {t: distance(token[1:], t[1:]) for t in terms if t[0] == token[0]}
            least = min(near.values(), default=9)
            want = {t for t, d in near.items() if d == least and d <= k}
            assert set(trie.near(token, k)) == want


def swapped_distance(a, b):
    """Edit distance with neighbouring letters in the wrong order as one edit."""
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 1] + b[j - 2]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_with_swaps():
    rng = random.Random(4)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 8))) for _ in range(40)]
    trie = A.Trie(terms)
    for _ in range(300):
        token = "".join(rng.choice("abc") for _ in range(rng.randrange(3, 9)))
        for k in (0, 1, 2):
            near = {t: swapped_distance(token[1:], t[1:]) for t in terms if t[0] == token[0]}
            least = min(near.values(), default=9)
            want = {t for t, d in near.items() if d == least and d <= k}
            assert set(trie.near(token, k, swaps=True)) == want


def test_misspelled_terms():
    scorer = A.Scorer()
    for word, term in [("idoit", "idiot"), ("Idoit", "idiot"), ("IDOIT", "idiot"), ("biitch", "bitch"), ("whroe", "whore"), ("moorn", "moron"), ("slutt", "slut"), ("bastrad", "bastard"), ("Arschlcoh", "arschloch"), ("сукка", "сука")]:
        want = {(lang, role): round(w * A.FUZZY_SHARE, 4) for lang, role, w in scorer.terms[term]}
        assert {(lang, role): round(w, 4) for lang, role, w in scorer.weights(word)} == want, word
    for word in ("where", "Count", "clock", "PORTO", "lasten", "batch", "whole", "donde", "права"):
        assert scorer.weights(word) == [], word
    assert scorer.texts(["You worthless IDOIT."])[0][0] >= A.THRESHOLDS["abusive"]


def test_reported_words_count_for_less():
    scorer = A.Scorer()
    reported = [
        "The quoted post read “you are an idiot, you moron”.",
        'She wrote: "you are an idiot and a moron" and was punished by the court',
        "«Tu es un connard, ferme ta gueule», a écrit le voisin.",
        "Er rief „du bist ein Arschloch, verrecke“ über die Straße.",
    ]
    for text in reported:
        assert max(scorer.texts([text])[0]) < 1.2, text
    for text in ["You are an idiot, you “genius” moron.", "You idiot, you moron, who wrote “a fine book”!", '"You are an idiot, you moron."']:
        assert scorer.texts([text])[0][0] >= 1.2, text
    assert list(A.said_parts("a “b” c\nd")) == [("a “b” c", 1.0), ("d", 1.0)]


def test_rated_agreement(spark):
    docs = spark.createDataFrame([(1, "You worthless idiot, shut your mouth.", "a"), (2, "Calm.", "a"), (3, "Calm.", None)], "doc_id LONG, text STRING, source STRING")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, None), (9, 1)], "doc_id LONG, toxic INT")
    assert [tuple(r) for r in A.rated_agreement(docs, labels).collect()] == [("a", 2, 1, 1, 0)]


def test_odd_documents(spark):
    docs = odd_documents(spark)
    scores = A.score_documents(docs).collect()
    assert len(scores) == 8 and all(r.abusive == r.hateful == r.sexual == 0 for r in scores)
    assert A.abusive_documents(docs).count() == 0
    assert A.score_documents(spark.createDataFrame([], DOCS)).count() == 0
    rates = A.source_rates(docs.where("doc_id < 6")).collect()
    assert len(rates) == 1 and rates[0].source is None and rates[0].n_documents == 5
