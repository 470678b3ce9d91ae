"""The operators' cores against brute force, round trips and held-out cases."""

import difflib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bookloom.llm import encodings, lookalikes, scans, sentences, spam, split, subjects, tokenize


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n,。é、क्", min_size=0, max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = split.split(text, limit, overlap)
    assert all(e - s <= limit for s, e in pieces) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b[0] <= a[1] and b[1] > a[1] and a[1] - b[0] <= overlap for a, b in zip(pieces, pieces[1:]))
    assert (len(pieces) > 1) == (len(text) > limit)


def test_cuts_prefer_sentences():
    text = "Ein kurzer Satz steht hier. " * 20
    assert all(text[e - 1] == " " and text[e - 2] == "." for _, e in split.split(text, 100, 0)[:-1])


def test_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    coder = tokenize.Encoder(tokenize.tokenizer_path())
    library = Tokenizer.from_file(tokenize.tokenizer_path())
    library.encode_special_tokens = True
    texts = ["", "Hello world  \n\n x", "một hai <|endoftext|>", "a" * 7000, "=-=-==" * 300, "ไทย" * 500, "日本語の文。" * 50, "🎧📚👩‍🚀", "\x00\x07 don't we'll", "áà" * 4000]
    assert coder.encode(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.encode([None]) == [[]]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_tokenizer_round_trip(text):
    coder = tokenize.encoder(tokenize.tokenizer_path())
    letters = {c: b for b, c in enumerate(tokenize.byte_letters())}
    import json

    words = getattr(test_tokenizer_round_trip, "words", None)
    if words is None:
        with open(tokenize.tokenizer_path(), encoding="utf-8") as f:
            words = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
        test_tokenizer_round_trip.words = words
    ids = coder.encode([text])[0]
    assert bytes(letters[c] for i in ids for c in words[i]).decode("utf-8") == text


def counts(text):
    out = {}
    for c in text:
        out[c] = out.get(c, 0) + 1
    return out


VI = "Một ví dụ ngắn sẽ làm rõ hơn. Điền viết một chữ, gạch đi rồi viết lại. Ở chợ Đò không có gì động đậy ngoài những lá cờ. "
RU = "Снег падал беззвучно. Кто оставил письмо под подушкой? Ничто не двигалось, кроме флагов. И стало тихо… "


def test_garbled_text_is_found_and_restored():
    for lang, text, pairs in (("vi", VI, [("utf_8", "cp1252"), ("utf_8", "mac_roman"), ("tcvn3", "cp1252"), ("cp1258", "cp1252")]), ("ru", RU, [("utf_8", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "cp1252")])):
        model = encodings.Model(counts(text * 200), lang)
        assert encodings.label([text, None, ""], model) == [None, None, None]
        for pair in pairs:
            bad = encodings.garble(text, *pair)
            path = encodings.label([bad], model)[0]
            got = encodings.repaired(bad, path, model)
            same = difflib.SequenceMatcher(None, got.lower(), text.lower(), autojunk=False).ratio()
            assert same > 0.9, (pair, got)


def test_settled_texts_are_those_that_viterbi_leaves_clean():
    model = encodings.Model(counts(VI * 200), "vi")
    rng = np.random.default_rng(3)
    alphabet = list("aăâ óÃ©º»đĐ.–�ƒ√")
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(400)]
    parts = [model.index(encodings.codes(t)) for t in texts]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    chosen = {i for i, _, _ in model.candidates(np.concatenate(parts), starts)}
    assert chosen == {i for i, p in enumerate(model.paths(parts)) if p.any()}


def test_forms():
    form = lookalikes.form
    assert form("ｈｅｒｅ", "en") == "here" and form("tһe саt", "en") == "the cat" and form("été", "fr") == "été"
    assert form("a b​c­", "de") == "a bc" and form("wavelength λ, да", "en") == "wavelength λ, да"
    assert form("лeс API", "ru") == "лес API" and form("باران‌ي", "fa") == "باران‌ی" and form("第２章！？", "zh") == "第2章！？"
    assert form("⼈", "zh") == "人" and form("℃ № …", "zh") == "℃ № …" and form("", "en") == ""
    assert lookalikes.skeleton("ｈеre") == lookalikes.skeleton("here") != lookalikes.skeleton("hare")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60), st.sampled_from(["vi", "en", "ru", "zh", "ja", "th", "hi", "fa", "other"]))
def test_forms_are_fixed_points(text, lang):
    once = lookalikes.form(text, lang)
    assert lookalikes.form(once, lang) == once


def test_scan_helpers():
    assert scans.numbers("– 12 –") == ({12}, True) and scans.numbers("[l]")[0] >= {1} and scans.numbers("iv")[0] == {4} and scans.numbers("Kapitel 3") is None
    assert scans.fold("COUNTING THE sta!rs") == scans.fold("Counting the Stairs")
    assert {"modern", "again"} <= scans.variants("rnodern") | scans.variants("a9ain")
    text = "The court of the\n– 3 –\nyoung king. See No.\n3 for it."
    assert [text[s:e] for s, e in scans.paragraph_furniture(text, 3, 3, [])] == ["– 3 –"]
    assert scans._hyphens("con-\nsacré x - y ten¬\r\nnis", "fr")[0][2:] == ("con", "sacré", "-")


def test_sentence_places():
    ends = lambda t, lang: [p for p, kind, *_ in sentences.places(t, lang)[0]]
    assert ends("“Stop! Wait for me,” said Tobin. He left.", "en") == [32]
    assert ends("“Did you hear?” asked Wren. “We leave.” Old habits.", "en")[-1] == 39
    assert ends("「待って！行かないで。」と灯が叫んだ。雪が降った。", "ja") == [19]
    assert ends("Petra paused... and went on", "en") == [] and ends("", "en") == [] and ends("No mark", "en") == []


def test_spam_lines():
    assert spam.lines("") == [] and "".join(spam.lines("ab. " * 500)).replace(" ", "") == "ab." * 500
    model = spam.Tables(form_only=True)

    def kinds(t):
        codes = np.array([spam.features(x)[0] for x in spam.lines(t)])
        return [spam.STATES[s] for s in model.paths(codes, np.array([len(codes)]))]

    assert set(kinds("https://a.test/1\nhttps://b.test/2\nhttp://c.test")) == {"link"}
    assert len(model.paths(np.zeros(0, int), np.zeros(2, int))) == 0
    assert set(kinds("#buy #cheap #best_price #online #buy")) == {"tag"}
    assert set(kinds("fish sauce, fish sauce! FISH SAUCE fish s@uce fish sauce fishsauce fish sauce fish sauce")) == {"refrain"}
    assert set(kinds("The old clock had stopped again. Nobody in town had ever asked about it.\nShe closed the door.")) == {"prose"}
    assert set(kinds("1. The Ferry ........ 5\n2. The Lamp ....... 12\n3. The Cat ...... 40")) == {"apparatus"}


def test_chain_learns_and_holds_out():
    rng = np.random.default_rng(1)
    words = {"law": "court judge trial".split(), "sport": "ball goal match".split(), "cooking": "salt pan oven".split()}
    order = list(words)
    texts, y = [], []
    for _ in range(300):
        s = rng.integers(3)
        texts.append(" ".join([*rng.choice(words[order[s]], 3), *rng.choice("the old clock had stopped again".split(), 5)]))
        y.append(np.eye(3)[s])
    bags = [subjects.terms(t) for t in texts]
    chain = subjects.Chain(order).fit(bags[:200], np.array(y[:200]), np.ones(200))
    got = chain.decode(chain.bag_scores(bags[200:]))
    assert np.mean(got == [1 << int(v.argmax()) for v in y[200:]]) > 0.95
    assert (chain.decode(chain.bag_scores([set()])) > 0).all()
    known = subjects.Chain(order).fit(bags, np.array(y), np.ones(300))
    assert np.allclose(known.text_scores(texts[:20], [None] * 20), known.bag_scores([subjects.terms(t) | subjects.structure(t, None) for t in texts[:20]]), atol=1e-5)


def test_words_of_keyword_lines_are_learned_in_any_language():
    import pandas as pd

    rows = pd.DataFrame([(-1, 100, 900), (5, 80, 4), (6, 90, 700), (7, 2, 0)], columns=["bucket", "a", "b"])
    flags = spam.tied_to_spam(rows)
    assert flags[5] and not flags[6] and flags.sum() == 1
    for text in ("รองเท้า ราคาถูก ซื้อ", "जूते सस्ते खरीदें", "scarpe economiche online", "کفش ارزان خرید"):
        assert len(set(spam.features(text)[2])) >= 3, text
    # digits for letters and free signs are read whatever stands around them
    assert spam.features("buy&cheap deals/online shoes")[2] == [spam._buckets[w] for w in ("buy", "cheap", "deals", "online", "shoes")]


def test_books_come_out_with_the_subjects_that_meet():
    order = ["law", "sport", "cooking", "fiction"]
    confusion = np.full((4, 4), 0.02) + 0.92 * np.eye(4)
    confusion /= confusion.sum(axis=1, keepdims=True)
    meet = np.diag([60.0, 60, 60, 60])
    meet[0, 1] = 80
    touched = np.zeros((4, 4))
    touched[:, 3] = 0.1
    chain = subjects.BookChain(order).fit_drawn(confusion, np.stack([meet, touched]), np.array([20, 30, 60]))
    books = np.array([[30, 0, 0, 0], [18, 12, 0, 0], [0, 0, 27, 3], [0, 20, 0, 10], [15, 1, 14, 0]], float)
    got = chain.decode(chain.scores(chain.features(books, confusion)), most=2)
    assert got.tolist()[:4] == [1, 3, 4, 10] and all(1 <= bin(m).count("1") <= 2 for m in got)
    # subjects that meet support each other
    assert max(chain.links[1, 0], chain.links[0, 1]) > chain.links[2, 0]


def test_mixtures_are_recovered_from_confused_labels():
    confusion = np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.15, 0.15, 0.7]])
    truth = np.array([[1, 0, 0], [0.5, 0.5, 0], [0.3, 0, 0.7]])
    assert np.allclose(subjects.unmixed(1000 * truth @ confusion, confusion, 2000), truth, atol=0.05)


def test_tokens_of_lines_are_worked_on_once(monkeypatch):
    class Counted:
        asked = []

        def match(self, token):
            self.asked.append(token)
            return pattern.match(token)

    pattern = spam.WORD
    monkeypatch.setattr(spam, "WORD", Counted())
    for line in ("Wanderschuhe Winterjacken %% ##% Wanderschuhe", "Winterjacken %% ##% Wanderschuhe %%"):
        spam.features(line)
    assert sorted(Counted.asked) == sorted(set(Counted.asked)) and "Wanderschuhe" in Counted.asked


def test_words_of_tokens_are_the_words_of_the_line():
    for line in ("Kaufen_Sie 'jetzt' ΑΣ ΣΟΣ. fr33_st@ff for $5\u2003x_", "it’s क्या कि ภาษาไทย_ดี -- ab-cd", "_ __a 0 @x ſ K"):
        low = line.lower()
        for words, text in ((spam._words_of, low.replace("_", " ")), (spam._words_of_leeted, low.translate(str.maketrans("03@1$5_", "oeaiss ")))):
            assert [w for x in line.split() for w in words[x]] == spam.TOKEN.findall(text)
    model = spam.Tables()
    codes = np.arange(0, spam.CODES, 7)
    assert (model.emissions(codes) == model._emissions(codes)).all()
    assert spam.lines("a\rb\r\n\n c</li>d") == ["a", "b", "c</li>", "d"] and spam.lines("a\rb\r\n\n c") == ["a", "b", "c"]
