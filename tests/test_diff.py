import pytest

from quillspark.operators.diff import analyze, broken_terms

DOC = '<html lang="en"><head><title>T</title></head><body><h1>Head</h1><p>One <em>two</em> three.</p><p class="x">{}</p></body></html>'.format("word " * 30)


def kinds(trad, cfg=None, orig=DOC):
    return [d.kind for d in analyze(orig, trad, cfg)]


def test_itself_is_clean():
    assert kinds(DOC) == []
    assert kinds(DOC.replace('lang="en"', 'lang="it"')) == []


@pytest.mark.parametrize(
    "change,kind",
    [
        (("</em>", ""), "missing_tag"),
        (("<p>One <em>two</em> three.</p>", ""), "missing_block"),
        (("three.", "three.<br/>"), "extra_tag"),
        (('class="x"', 'class="y"'), "attr"),
        (("word " * 30, "word " * 5), "short_text"),
        (("Head", "Head…"), "ellipsis"),
        (('<html lang="en">', '<html lang="en" id="q">'), "prologue"),
    ],
)
def test_each_change_has_its_kind(change, kind):
    assert kind in kinds(DOC.replace(*change))


def test_moved_inline_is_fine_but_not_if_changed():
    assert kinds(DOC.replace("One <em>two</em>", "<em>two</em> One")) == []
    assert kinds(DOC.replace("One <em>two</em>", "<em id='a'>two</em> One")) != []


@pytest.mark.parametrize(
    "orig,trad,bad",
    [
        ("the trine here", "il trigono", False),
        ("the trine here", "trigoni", False),
        ("the trine here", "il trine", True),
        ("doctrines", "dottrine", False),
        ("the trine", "altro", True),
    ],
)
def test_terms(orig, trad, bad):
    assert bool(broken_terms(orig, trad, {"trine": "trigono"})) == bad


def test_terms_kept_and_cognate():
    assert not broken_terms("a quintile", "un quintile", {"quintile": "quintile"})
    assert not broken_terms("quadrature", "le quadrature", {"quadrature": "quadratura"})
    assert not broken_terms("the Trine Review", "the Trine Review", {"trine": "trigono"}, {"trine": ["Trine Review"]})
