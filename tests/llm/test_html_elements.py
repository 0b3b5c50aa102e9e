"""Elements that must not swallow the text behind or within them."""

import pytest

from factloom.llm import html_text

FIRST, SECOND = "The first paragraph of the article has a good many words in it.", "The second paragraph of it has as many words as the first one had."


def page(between):
    return f"<html><body><nav><a href=x>Home</a></nav><article><p>{FIRST}</p>{between}<p>{SECOND}</p></article><footer>(c) me</footer></body></html>"


@pytest.mark.parametrize("tag", ["svg", "math", "select", "object", "canvas", "noscript", "template"])
def test_unclosed_and_self_closed(tag):
    for start in (f"<{tag}>", f"<{tag} class='a>b'/>", f"<{tag.upper()} />"):
        for more in ("", f"<{tag}>x</{tag}>"):
            got = html_text.main_text(page(start) + more)
            assert got.startswith(f"{FIRST}\n") and got.endswith(SECOND), (start, more, got)


@pytest.mark.parametrize("tag", ["xmp", "noscript", "object"])
def test_text_within_reaches_the_cut(tag):
    _, blocks = html_text.parse(page(f"<{tag}>Some text &amp; more</{tag}>"))
    assert [b.text for b in blocks] == ["Home", FIRST, "Some text & more" if tag != "xmp" else "Some text &amp; more", SECOND, "(c) me"]


def test_formulas_and_graphics_in_paragraphs():
    formula = "<math><semantics><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='TeX'>a = 2</annotation></semantics></math>"
    assert html_text.main_text(page(f"<p>In this paragraph {formula} is a formula <svg><title>icon</title><svg></svg><path d='x'/></svg>that stays.</p>")) == f"{FIRST}\nIn this paragraph a=2 is a formula that stays.\n{SECOND}"


def test_fallbacks_are_not_the_text():
    between = "<noscript><p>Please switch on scripts to see this page as it is meant.</p></noscript><select><option>Alpha<option>Beta</select><template><template>x</template><p>Never shown as it is, it is a template.</p></template>"
    assert html_text.main_text(page(between)) == f"{FIRST}\n{SECOND}"
