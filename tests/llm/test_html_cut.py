"""The whole labelling against brute force, pages on which the cut corrects single blocks, and hard pages in linear time."""

import itertools
import random
import time

import numpy as np
import pytest

from factloom.llm import html_text as H

LONG = "This is a paragraph of the text that goes on for quite a while, as the paragraphs of a text do."


def signs(page, model=None):
    nodes, blocks = H.parse(page)
    return "\n".join(b.text for b, s in zip(blocks, H.scores(nodes, blocks, model), strict=True) if s > 0)


def test_a_link_between_paragraphs_stays():
    page = f"<div><p>{LONG}</p><p><a href=x>More of it here</a></p><p>{LONG}</p></div>"
    assert signs(page) == f"{LONG}\n{LONG}"
    assert H.main_text(page) == f"{LONG}\nMore of it here\n{LONG}"


def test_a_sentence_between_links_goes():
    links = "".join(f"<li><a href=x>Part {i}</a></li>" for i in range(4))
    page = f"<div><ul>{links}<li>Get our letter each week.</li>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div>"
    assert signs(page) == f"Get our letter each week.\n{LONG}\n{LONG}"
    assert H.main_text(page) == f"{LONG}\n{LONG}"


def test_labels_are_the_cheapest():
    random_ = random.Random(7)
    pieces = ["<p>", "</p>", "<div>", "</div>", "<li>", "<a href=x>", "</a>", "<article>", "<nav>", "</nav>", "<h2>", "</h2>", "a few words.", LONG, "one"]
    differ = 0
    for _ in range(300):
        page = "".join(random_.choice(pieces) for _ in range(random_.randint(5, 25)))
        nodes, blocks = H.parse(page)
        if len(blocks) > 9:
            continue
        score, edges = H.scores(nodes, blocks), H.smoothness(nodes, blocks)
        cost = lambda keep: sum(abs(s) for s, k in zip(score, keep, strict=True) if (s > 0) != k) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        best = min(itertools.product([True, False], repeat=len(blocks)), key=cost)
        got = H.min_cut(score, edges)
        assert cost(got) == pytest.approx(cost(best))
        assert H.main_text(page) == "\n".join(b.text for b, k in zip(blocks, got, strict=True) if k)
        differ += got != [s > 0 for s in score]
    assert differ > 30


def test_the_classifier_learns_from_pages_that_name_their_text():
    """Here the text is in short list items and the boilerplate in long linked sentences, against the starting weights."""
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(rng.choice(list("abcde"), 4)) for _ in range(n))
    named = [f"<div><p><a href=x>{word(12)}</a>.</p></div><main><ul>{''.join(f'<li>{word(2)}</li>' for _ in range(5))}</ul></main>" for _ in range(60)]
    counts = {}
    for page in named:
        for kind in H.seeds(page):
            counts[kind] = counts.get(kind, 0) + 1
    weights = H.fitted(sorted((*k, n) for k, n in counts.items()))
    of_item = lambda w: w[0] + w[1] * 4 / 4 + w[5]  # noqa: E731  two words without a mark or link
    assert of_item(weights) > 0 > of_item(H.PRIOR)
    assert H.fitted([]) == H.PRIOR
    # Few blocks move the weights a little only.
    assert np.abs(np.array(H.fitted([(1, 4, 0, 0, 0, 1, 1)])) - H.PRIOR).max() < 0.3


def test_names_learn_from_pages_that_name_their_text(spark):
    """A box that only stands outside the main text elsewhere goes where no element names the main text, and one from within stays."""
    named = [f"<div class='kasten x{i}'><p>{LONG}</p></div><main><div class='zeilen y{i}'><p>{LONG}</p></div></main>" for i in range(80)]
    bare = f"<div class='kasten'><p>{LONG}</p></div><div class='zeilen'><p>One.</p></div>"
    pages = spark.createDataFrame(list(enumerate(named)), "page_id long, html string")
    model = H.fit(pages)
    nodes, blocks = H.parse(bare)
    before, after = H.scores(nodes, blocks), H.scores(nodes, blocks, model)
    assert after[0] - before[0] < -1 and after[1] - before[1] > 1
    places = [H._name_places(n)[0] for n in nodes if n.names]
    assert model.names[places[0]] < -1 < 1 < model.names[places[1]]
    assert H.Model() == H.fit(pages.limit(0)) and H.name_scores([(1, None, 5)]) == ()


@pytest.mark.parametrize("junk", ["<a ", "<!", "<!--", '<a "', "<a ='", '<a x="<b>" ', "<div>", "<div><p>x</div>", "<article>", "<svg>", "<script>", "<xmp>", "<select>", "<a href=x>y", "<p>x", "&amp", "<li>x<ul>"])
def test_hard_pages_take_linear_time(junk):
    began = time.process_time()
    H.main_text(junk * (400_000 // len(junk)) + "end")
    assert time.process_time() - began < 8
