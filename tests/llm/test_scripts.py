"""Words that mix scripts, in every language."""

import pytest

from bookloom.llm import lookalikes


@pytest.mark.parametrize("lang", ["zh", "ja", "th", "hi", "fa", "other"])
def test_mixed_words_outside_latin_languages(lang):
    form = lookalikes.form
    assert form("tаblе", lang) == "table" and form("ΡDF", lang) == "PDF" and form("Мoсквa", lang) == "Москва"
    for same in ("table", "сор", "Москва", "λ", "kΩ", "μm", "ΔT"):
        assert form(same, lang) == same
    assert lookalikes.skeleton(form("tаblе", lang)) == lookalikes.skeleton("tаblе")


def test_greek_letters_in_russian_words():
    assert lookalikes.form("Μοсква", "ru") == "Москва" and lookalikes.form("угол α", "ru") == "угол α"


def test_hiragana_in_katakana_words():
    form = lookalikes.form
    assert form("アルファべット", "ja") == "アルファベット" and form("モへンジョ", "ja") == "モヘンジョ" and form("アりー", "ja") == "アリー"
    for same in ("ロンドンへバスで", "へえ", "サボり", "エンジン力", "ビル一つ"):
        assert form(same, "ja") == same
